"""Operators' general interfaces, kernels and the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.llm import fingerprints, kernels, licenses, mixing, quality, shared, urls, warc


def test_word_and_shingle_hashes():
    text = "Ab  cd\tef\x0bgh AB cd ef\n\ngh ab zz"
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    hashes = kernels.word_hashes(text)
    assert [words.index(w) for w in words] == [list(hashes).index(h) for h in hashes]
    assert len(kernels.shingle_set(text)) == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    assert len(kernels.shingle_set("a b")) == 1 and len(kernels.shingle_set(" ")) == len(kernels.shingle_set(None)) == 0
    long = "w " * 200_000
    assert len(kernels.word_hashes(long)) == 200_000 and len(set(kernels.word_hashes(long))) == 1


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000 + k) for k in range(1, 200)]
    root = {x: x for e in edges for x in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 1), (7, None)], "a long, b long")
    got = {r.node: r.component for r in shared.connected_components(df).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert shared.connected_components(df.where("1 = 0")).count() == 0


def test_drop_ids(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    gone = spark.range(0, 1000, 3)
    assert {r.id for r in shared.drop_ids(df, gone.select("id"), "id").collect()} == {k for k in range(1000) if k % 3}


def test_aliases_and_precedence(spark):
    pages = [
        (1, "http://a.net/x", '<link rel="canonical" href="http://b.net/y">'),
        (2, "http://b.net/y#f", '<meta http-equiv="refresh" content="0; url=http://Example.org/es/1">'),
        (3, "http://c.org/z", "<link href=http://b.net/y rel=canonical>"), (4, "http://d.net/", "<link rel=canonical href=/q>"),
        (5, "http://e.net/1", None), (6, "http://org", None), (7, "http://e.net/2", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    log = spark.createDataFrame([("http://e.net/1", "http://x.com/de/"), ("http://e.net/1", None)], "from_url string, to_url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, redirects=log).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: ("org/", "allow"), 4: (None, "allow"), 5: (None, "block"), 6: (None, "allow"), 7: (None, "allow")}


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted((rng.randrange(50), i) for i in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


def test_capture_histories_are_in_global_order(spark, sf_dir):
    rows = warc.captures(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    rows.sort(key=lambda r: (r.range, r.position))
    keys = [(r.key, r.at, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_runs_of_few_records(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = warc.captures(pages, run_records=7).collect()
    runs = {}
    for r in rows:
        runs.setdefault(r.run, []).append(r.seq)
    assert len(rows) == pages.count() and all(sorted(x) == list(range(len(x))) and len(x) <= 7 for x in runs.values())
    keys = [(r.key, r.at, r.page_id) for r in sorted(rows, key=lambda r: (r.range, r.position))]
    assert keys == sorted(keys)


ODD_URLS = ["http://a.org/x\ny", "http://a.org/x!z", "http://a.org/x%0Az", "http://a.org/x\r\n", "http://\u0130.org/\u0130", "HTTP://\u00c9.org/A", "http://\u00e9.org/b", "ftp://b", "nohost", "", None, "http://a.org/ x ", "http://a.org/x#y"]


def test_odd_urls_in_one_run(spark):
    rows = [(k, u, f"<p>{k % 4}") for k, u in enumerate(ODD_URLS)] + [(3, "http://a.org/x\r\n", "<p>3"), (None, "http://a.org/", "<p>1"), (None, None, "only null"), (None, None, "only null")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.captures(df).collect()
    assert len(got) == len(rows) and len({r.run for r in got}) == 1
    for r in got:
        head, block = warc.read_record(r.run, r.offset, r.length)
        assert head[b"warc-type"].decode() == r.record_type and len(block.partition(b"\r\n\r\n")[2]) == (r.payload_bytes if r.record_type == "response" else 0)
    assert len({warc.read_record(r.run, r.offset, r.length)[0][b"warc-record-id"] for r in got}) == len(rows)
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {
        *((k, "response", None) for k in range(4)), *((k, "revisit", k % 4) for k in range(4, len(ODD_URLS))), (None, "revisit", 1), (None, "response", None),
    }


def test_many_repeated_payloads_move_alone(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    sent = sorted(map(tuple, warc.captures(pages).select(*columns).collect()))
    monkeypatch.setattr(warc, "SENT_ROWS", 0)
    assert sorted(map(tuple, warc.captures(pages, run_bytes=5_000).select(*columns).collect())) == sent


def test_a_run_out_of_order_is_an_error(spark):
    df = spark.createDataFrame([(k, f"http://h{k}/", "x") for k in range(5)], "page_id long, url string, html string").coalesce(1)
    index = shared.materialise(warc.captures(df).drop("range", "position"), "cdx")
    wrong = index.withColumn("seq", 10 - F.col("seq"))
    with pytest.raises(Exception, match="isn't sorted"):
        warc.merge_index(wrong, 1).count()


def test_small_payloads_are_never_revisits(spark):
    df = spark.createDataFrame([(1, "http://a/", "xy"), (2, "http://b/", "xy"), (3, "http://c/", "long enough"), (4, "http://d/", "long enough")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.captures(df, min_bytes=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_targets_and_takes_are_near(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = mixing.mix(docs).collect()
    assert all(r.taken <= 3 * r.size for r in rows)
    longest = max(r.size for r in rows)
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= longest / 2 + 1
    assert rows and sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    weights = spark.createDataFrame([("src0", 1000.0), ("src1", 1.0)], "source string, weight double")
    capped = {r.source: (r.target, r.source_size) for r in mixing.mix(docs.where("source IN ('src0', 'src1')"), weights).collect()}
    assert capped["src0"][0] == min(3 * capped["src0"][1], capped["src0"][0]) and sum(t for t, _ in capped.values()) <= 2e9


def test_sketches_merge_and_contain(spark):
    w = [f"w{k}" for k in range(3000)]
    df = spark.createDataFrame([(" ".join(w), " ".join(w[:600]), "tiny one")], "a string, b string, c string")
    r = df.select(*(fingerprints.sketch(F.col(x)).alias(x) for x in "abc")).select(
        "*", fingerprints.containment(F.col("b"), F.col("a")).alias("ba"), fingerprints.containment(F.col("a"), F.col("b")).alias("ab")
    ).head()
    assert r.ba == 1.0 and abs(r.ab - 0.2) < 0.06 and set(r.b) <= set(r.a) and len(r.c) <= 1


def test_only_hashes_below_the_fraction_are_kept(spark):
    """By definition, for texts of any length; sketches of two sets merge to that of their union."""
    import hashlib

    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "B", "c", "dd", "e"]) for _ in range(n)) for n in (0, 1, 3, 4, 5, 6, 7, 9, 20, 60, 400) for _ in range(6)]

    def kept(*texts):
        grams = set()
        for t in texts:
            w = t.lower().split()
            grams |= {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        return sorted(h for h in {hashlib.md5(g.encode()).hexdigest()[:16] for g in grams} if h < fingerprints.BELOW)

    df = spark.createDataFrame(list(zip(texts, texts[1:], strict=False)), "a string, b string").select("a", "b", *(fingerprints.sketch(F.col(x)).alias(f"s{x}") for x in "ab"))
    for r in df.withColumn("m", fingerprints.merged(F.col("sa"), F.col("sb"))).collect():
        assert r.sa == kept(r.a) and r.m == kept(r.a, r.b)


def test_slices_of_the_order(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(None, "null"), *((rng.choice([-(2**62), 2**62, k, k * k, 7]), f"text {k}") for k in range(300))]
    df = spark.createDataFrame(rows, "i long, t string").repartition(5)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    order = sorted(rows, key=key)
    for size in (20, 1000, 8 << 20):
        monkeypatch.setattr(fingerprints, "TASK_BYTES", size)
        monkeypatch.setattr(fingerprints, "QUANTILES", 8)
        monkeypatch.setattr(fingerprints, "SENT_SLICES", size)
        got = sorted(((r.id, r.text, r.next_text) for r in fingerprints.with_next(df, "i", "t").collect()), key=key)
        assert got == [(*a, b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)]


def test_licence_sequences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of it. The above copyright notice and this permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    texts = [(1, mit), (2, "Licensed under the Apache License, Version 2.0."), (3, "see licence"), (4, "words only"), (5, None), (6, "Under the MIT License. " + mit)]
    got = {r.doc_id: (r.licenses, r.status) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "known"), 2: ("Apache-2.0", "known"), 3: ("", "unknown"), 4: ("", "none"), 5: ("", "none"), 6: ("MIT", "known")}


def test_resampling_ranks_quality(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.resample(docs, labels, share=0.5)
    assert rows.where("selected").count() == round(0.5 * docs.count())
    label = {r.doc_id: r.quality for r in labels.collect()}
    score = {r.doc_id: r.log_weight / max(1, r.n_grams) for r in rows.collect()}
    good, bad = ([score[i] for i, q in label.items() if q == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(quality.kth_greatest(rows, "key", k) == sorted((r.key for r in rows.collect()), reverse=True)[k - 1] for k in (1, 17, 200))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns and 0.8 * n < docs.count() <= n
    assert docs.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")).count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_creative_commons_without_another_cue(spark):
    texts = {1: "Photo: Jane Doe, CC BY-SA 4.0.", 2: "Creative Commons Attribution 4.0", 3: "Released under CC0 1.0", 4: "At your option any later version"}
    got = {r.doc_id: (r.licenses, r.sequence) for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: ("CC-BY-SA", "cc-by-sa-grant"), 2: ("CC-BY", "cc-by-grant"), 3: ("CC0-1.0", "cc0-grant"), 4: ("", "gpl-or-later")}


MIT = """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
"""


def test_wrapped_notices_and_sentences_of_many_identifiers(spark):
    texts = {
        1: MIT, 2: MIT.replace("\n", "\r\n"), 3: BSD_2, 4: BSD_3, 5: GPL, 6: "Under the MIT License or under the Apache License, Version 2.0, at your choice.",
        7: "Photo: Jane Doe, CC BY-SA 4.0.", 8: "Creative\nCommons Attribution 4.0", 9: "Released under CC0 1.0",
        10: "All rights reserved\nCopyright 2020 A\nAll rights reserved",
    }
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {k: r.licenses for k, r in got.items()} == {
        1: "MIT", 2: "MIT", 3: "BSD-2-Clause", 4: "BSD-3-Clause", 5: "GPL-2.0-or-later", 6: "Apache-2.0,MIT", 7: "CC-BY-SA", 8: "CC-BY", 9: "CC0-1.0", 10: "Proprietary",
    }
    assert got[5].sequence == "gpl-redistribute;gpl-2.0-grant;gpl-or-later" and got[5].n_sentences == 1
    assert got[6].sequence == "mit-grant;apache-2.0-grant" and got[10].sequence == "all-rights-reserved;copyright-line;all-rights-reserved"


NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "MIT": MIT,
    "BSD-2-Clause": BSD_2,
    "BSD-3-Clause": BSD_3,
    "BSD-4-Clause": BSD_2 + """
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement: This product includes software.

4. Neither the name of the organization nor the names of its
   contributors may be used to endorse or promote products derived from it.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. 1. The origin of this software must not be misrepresented; you must not
claim that you wrote it. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented.""",
    "GPL-2.0-or-later": GPL,
    "GPL-3.0-or-later": GPL.replace("version 2", "version 3"),
    "GPL-3.0-only": "This program is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": "This program is made available under the terms of the Eclipse Public License 2.0",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary.""",
    "GPL-2.0-or-later,MIT": "SPDX-License-Identifier: (MIT OR GPL-2.0+)",
    "CC-BY-NC-SA": "See https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "Proprietary": "Copyright (c) 2020 A. Smith. All rights reserved.",
}


def test_published_notices(spark):
    """As published, in comments of three kinds, with CRLF, and on one line."""
    forms = (
        str, lambda t: t.replace("\n", "\r\n"), lambda t: t.replace("\n", " "), lambda t: "".join(f"# {x}\n" for x in t.split("\n")),
        lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */", lambda t: "".join(f"// {x}\n" for x in t.split("\n")),
    )
    rows = [(f"{name}|{k}", f"Some code.\n\n{form(text)}\n\nint main;") for name, text in NOTICES.items() for k, form in enumerate(forms)]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {i: x for i, x in got.items() if x != i.split("|")[0]} == {}


def _sample(wording):
    """A text that the wording matches, of each of its alternatives."""
    for x in licenses._openings(wording):
        while "(?:" in x:
            x = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\??)", lambda m: "" if m[2] else m[1], x, count=1)
        x = re.sub(r"\.\{[^}]*\}\??", "any ", x).replace("[ -]", " ").replace("[sc]", "s").replace("[0-9]{4}", "2020").replace("[0-9]", "4")
        yield x.replace(" ?-?v?", " ").replace(r"v\.?", "v").replace(r"\.", ".").replace("?", "")


def test_every_known_sentence_alone(spark):
    rows, names = [], {}
    for name, wording in licenses.SENTENCES:
        for text in _sample(wording):
            assert re.fullmatch(wording, text), (wording, text)
            for form in (text, text.replace(" ", "\n * "), f"X_{text.upper()}; words"):
                names[len(rows)] = name, wording
                rows.append((len(rows), form))
    got = {r.doc_id: r.sequence.split(";") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = lambda k: next(n for n, w in licenses.SENTENCES if re.match(rf"(?:{w})\b", rows[3 * (k // 3)][1]))
    assert [(rows[k], got[k]) for k in names if first(k) not in got[k]] == []
    assert sum(first(k) == names[k][0] for k in names) > 0.9 * len(names)


def test_licence_rules_equal_sql_on_hand_made_texts(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    parts = [t for _, w in licenses.SENTENCES for t in _sample(w)] + list(NOTICES.values()) + ["plain words.", "a licence.", "\n\n", "v. 2.0", "ünïcode. ", "SPDX-License-Identifier: ISC"]
    rows = [(k, "".join(rng.choice(parts) + rng.choice([" ", "\n", ". ", "\n# \n", ".\n", ") or "]) for _ in range(rng.randrange(12)))) for k in range(300)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([*rows, (900, None), (900, None)], "doc_id long, text string").write.parquet(path)
    got = sorted(map(tuple, licenses.scan(spark.read.parquet(path)).collect()))
    want = duckdb.sql(re.sub(r"\bFROM documents\b", f"FROM '{path}/*.parquet'", licenses.OP3_SQL)).fetchall()
    assert got == sorted(want) and len({r[3] for r in got}) > 30


def test_components_of_stars_take_no_round(spark, monkeypatch):
    written = []
    plain = shared.materialise
    monkeypatch.setattr(shared, "materialise", lambda df, what="table": written.append(what) or plain(df, what))
    stars = spark.createDataFrame([(5, 1), (1, 6), (6, 1), (7, 7), (9, 2), (None, 3)], "a long, b long")
    assert {r.node: r.component for r in shared.connected_components(stars).collect()} == {1: 1, 5: 1, 6: 1, 2: 2, 9: 2}
    assert written == ["cc"]
    written.clear()
    joined = stars.unionByName(spark.createDataFrame([(9, 6)], "a long, b long"))
    assert {r.node: r.component for r in shared.connected_components(joined).collect()} == {k: 1 for k in (1, 2, 5, 6, 9)}
    path = spark.range(64).selectExpr("id a", "id + 1 b")
    assert {r.component for r in shared.connected_components(path).collect()} == {0}


def test_forest_joins_what_one_task_finds(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, size=(300, 2))]
    for most in (10, 10_000):
        forest, rows = shared.Forest(most), []
        for a, b in links:
            forest.link(a, b)
            if forest.full():
                rows += forest.stars().to_pylist()
        rows += forest.stars().to_pylist()
        assert forest.stars().num_rows == 0
        assert all(r["a"] > r["b"] for r in rows)
        least = {k: k for pair in links for k in pair}
        for _ in least:
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(rows)).collect()}
        alone = {a for a, b in links if a == b} - set(got)
        assert got == {k: v for k, v in least.items() if k not in alone}
