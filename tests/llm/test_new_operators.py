"""Filter audit, collocations and toxicity against brute force."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.llm import collocations, decontamination, filter_audit, licenses, toxicity, urls
from tesseral.llm.double_array import DoubleArray
from tests.oracle import run_sql


def audit_by_hand(docs, labels):
    least, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    masks = []
    for i, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and i > least[t]
        masks.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                own = [m for m in masks if m[0] == part]
                alive = [m for m in own if not m[1] & set(order[:k])]
                gone = [m for m in alive if f in m[1]]
                shapley[f] += len(gone)
                out[part, order, k + 1] = (
                    len(alive) - len(gone), len(gone), sum(f in m[1] for m in own) - len(gone), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)
                )
        for part_, order, step in list(out):
            if part_ == part:
                out[part, order, step] += (shapley[order[step - 1]],)
    return out


def test_audit_of_ids_in_any_order_equals_brute_force(spark, tmp_path, monkeypatch):
    long = "alpha beta " * 40
    texts = [None, "", "A b", "A b", long, long, "x $ y", "word " * 60, " ".join(f"w{k}" for k in range(60)), "ÄÖ Ünder CAPS"]
    docs = [(n, texts[(7 * n) % 10], [None, "", "a", "b"][n % 4]) for n in range(60)]
    docs += [(3, "A b", "a"), (3, "A b", "b"), (None, "A b", "a"), (None, long, None), (2, long, "b")]
    labels = [(n, n % 2, int(n % 3 == 0)) for n in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    top = str(tmp_path)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit("x")).withColumn("digest", F.lit("x"))
    # Greatest ids first, a file each third: every smaller id comes later and retracts.
    frame.repartitionByRange(9, F.desc("doc_id")).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    monkeypatch.setattr(filter_audit, "TEXTS", 4)
    got = filter_audit.op11_filter_audit(spark, top).collect()
    want = audit_by_hand(docs, labels)
    kinds = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(got) == len(want) == 600 * 3
    found = {(r.part, r.filter_order, r.step): tuple(r[k] for k in kinds) for r in got}
    assert [(k, found[k], v) for k, v in want.items() if found[k] != v][:3] == []


def test_labels_of_the_audit_are_never_broadcast(spark, sf_dir, capsys):
    static = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/documents.parquet")
    filter_audit.stream_changes(stream, spark.read.parquet(f"{sf_dir}/labels.parquet"), 3, 5).explain()
    plan = capsys.readouterr().out
    # One exchange of each side, by the given number of tasks.
    assert "Broadcast" not in plan and "SortMergeJoin" in plan and plan.count("REPARTITION_BY_NUM") == 2
    assert plan.count("ENSURE_REQUIREMENTS") == 1  # labels by id


def test_text_masks_in_blocks(monkeypatch):
    text = ("Some Words, é ü Some " * 300 + "endless" * 50).encode()
    whole = filter_audit.text_mask(text)
    monkeypatch.setattr(filter_audit, "BLOCK", 37)
    assert filter_audit.text_mask(text) == whole == filter_audit.text_mask(text + b" ")


def test_earlier_masks_are_retracted():
    texts = filter_audit.Texts()
    texts.see("t", 1, [["a", 0, False, 9, 1, 3]])
    again = filter_audit.Texts(texts.stored())
    again.see("t", 1, [["b", 2, False, 4, 2, 2], ["a", 0, True, None, 0, 1]])
    assert texts.changes == {("a", 1, 0): 1, ("a", 17, 0): 2}
    assert again.changes == {("a", 1, 0): 0, ("a", 17, 0): 1, ("b", 1, 2): 2}


@pytest.mark.parametrize("size", [2, 3, 4])
def test_double_array_counts(size):
    rng = np.random.default_rng(size)
    alphabet = rng.integers(1, 2**63, 60).astype(np.uint64)
    keys = np.unique(alphabet[rng.zipf(1.3, (800, size)) % 60], axis=0)
    text = alphabet[rng.zipf(1.3, 20_000) % 60]
    text[rng.random(len(text)) < 0.05] = 0
    trie = DoubleArray(keys)
    seen = Counter(tuple(text[k : k + size].tolist()) for k in range(len(text) - size + 1))
    assert sorted(map(tuple, trie.keys.tolist())) == sorted(map(tuple, keys.tolist()))
    assert trie.count(text).tolist() == [seen[tuple(k)] for k in trie.keys.tolist()]
    assert trie.count(text[:1]).sum() == 0 == trie.count(text[:0]).sum()


def test_phrases_in_small_blocks_and_shards_equal_sql(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("WORDS", 20), ("HASHES", 50), ("PHRASES", 20), ("SHARD", 7), ("LEAST", 3)):
        monkeypatch.setattr(collocations, name, value)
    words = "the Cat sat on a mat. The cat ran; a DOG sat on\ta mat, é ü\nthe cat sat!"
    texts = [(words * k, lang) for k, lang in ((1, "en"), (3, "en"), (4, None), (2, "und"), (5, "de"))] + [(None, "en"), ("", None), ("?!", "fr"), ("no end " * 100, "fr")]
    docs = spark.createDataFrame(texts, "text string, lang string")
    got = collocations.best(collocations.collocations(docs, least=3)).toPandas()
    sql = collocations.OP12_SQL.replace("n >= 30", "n >= 3")
    want = run_sql(sql, "/root/testdata/sf0.001", {"documents": docs.toPandas()})
    key = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert len(want) > 10 and sorted(got[key].itertuples(index=False, name=None)) == sorted(want[key].itertuples(index=False, name=None))


def test_blocks_end_at_pieces(monkeypatch):
    text = b"one two, three four five six seven. eight" * 5
    for most in (1, 5, 11, 40, 1000):
        blocks = list(collocations._blocks(text, most))
        assert b"".join(blocks) == text and all(not b or b[-1:] in b",." or c[:1] in b",." for b, c in zip(blocks, blocks[1:], strict=False))


def _toxic_rows(n=600, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = {lang: [f"{lang}{k}" for k in range(400)] for lang in ("aa", "bb")}
    rows = []
    for i in range(n):
        lang, y = ("aa", "bb")[i % 2], int(rng.random() < 0.3)
        words = list(rng.choice(vocabulary[lang], int(rng.integers(5, 80))))
        if y:
            words[int(rng.integers(len(words)))] = ("grim", "vile", "foul")[int(rng.integers(3))]
        rows.append((i, " ".join(words), lang, y))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = _toxic_rows()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs.where(~out), labels.where(~out))
    got = {r.doc_id: r.score for r in toxicity.score(docs.where(out), model).collect()}
    right = [(got[r[0]] >= 0.5) == bool(r[3]) for r in rows if r[0] in got]
    assert len(right) > 80 and np.mean(right) > 0.95
    assert all(0 <= v <= 1 for v in got.values())
    again = {r.doc_id: r.score for r in toxicity.score(docs.where(out).withColumn("lang", F.lit("zz")), model).collect()}
    assert again == got


def test_toxicity_is_learned_from_all_rows(spark):
    n = 4300
    ids = spark.range(2 * n).withColumn("key", F.xxhash64(F.lit(13), F.col("id")))
    ranked = [r.id for r in ids.orderBy("key", "id").collect()]
    toxic = [i for i in ranked if i % 2]
    late = set(toxic[4000:])  # a word of these rows alone
    words = lambda i: "vile" if i in late else "grim" if i % 2 else f"w{i % 11}"
    docs = spark.createDataFrame([(i, f"w{i % 7} {words(i)} w{i % 5}", "aa") for i in ranked], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ranked], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    asked = spark.createDataFrame([(1, "w1 vile w2"), (2, "w1 grim w2"), (3, "w1 w3 w2")], "doc_id long, text string")
    assert {r.doc_id: r.score >= 0.5 for r in toxicity.score(asked, model).collect()} == {1: True, 2: True, 3: False}


def test_toxicity_in_parts_of_any_layout(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_WORDS", 5000)
    rows = _toxic_rows(900, 3)
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows if r[0] % 7], "doc_id long, quality int, toxic int")
    got = []
    for own, n in ((rows, 1), (rows[::-1] + rows[:50], 7)):
        docs = spark.createDataFrame([r[:3] for r in own], "doc_id long, text string, lang string").repartition(n)
        parts = toxicity.deal(toxicity.examples(docs, labels))
        assert parts.count() == len({r.part for r in parts.collect()}) > 3
        assert sum(len(r.toxic) for r in parts.collect()) == sum(1 for r in rows if r[0] % 7)
        got.append(toxicity.train(docs, labels))
    assert np.allclose(got[0].thresholds, got[1].thresholds) and np.allclose(got[0].embedding, got[1].embedding)


def _shuffled(spark, work):
    """What work() returns, and the bytes that its stages wrote to shuffles."""
    sc = spark.sparkContext

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before, out = written(), work()
    return out, sum(n for k, n in written().items() if k not in before)


def test_toxicity_moves_words_once_and_sums_in_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_WORDS", 30_000)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50_000, 300)), "aa") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(600)], "doc_id long, quality int, toxic int")
    parts, moved = _shuffled(spark, lambda: toxicity.deal(toxicity.examples(docs, labels)))
    assert moved < 3 * 180_000  # bytes, words
    assert sorted(n for r in parts.collect() for n in r.n) == [300] * 600
    model, state = toxicity.Classifier(), {"t": 0, "seen": np.zeros(toxicity.BUCKETS + 1, dtype=np.float32)}
    model.embedding[:-1] = rng.normal(0, 0.05, (toxicity.BUCKETS, toxicity.DIM))
    sent = (model, state, False, 0, 0)
    found, moved = _shuffled(spark, lambda: toxicity.sums_of(parts)(toxicity._round, sent, toxicity._round_shape(model)))
    own = parts.toArrow().to_batches()
    want = toxicity._round(sent, toxicity._unpacked(own))
    assert np.allclose(found, want, atol=1e-4)  # matrix products may differ in their last bits
    counts = toxicity.sums_of(parts)(toxicity._count, None, (toxicity.BUCKETS + 2, 4))
    assert np.array_equal(counts, toxicity._count(None, toxicity._unpacked(own))) and counts.any()
    changed = np.count_nonzero(found[: toxicity.BUCKETS, toxicity.DIM + 1])
    assert changed > 10_000 and moved < 45 * changed


def test_pressed_words_and_rows_come_back():
    rng = np.random.default_rng(6)
    for n in (0, 1, 3, 4, 5, 1001):
        words = rng.integers(0, toxicity.BUCKETS, n).astype(np.int32)
        assert np.array_equal(toxicity.unpress_words(toxicity.press_words(words), n), words)
    rows = rng.normal(size=(100, 3)) * 10.0 ** rng.integers(-9, 9, (100, 3))
    at = np.sort(rng.choice(toxicity.SLICE, 100, replace=False))
    back_at, back = toxicity.unpress_rows(toxicity.press_rows(at, rows), 100, 3)
    assert np.array_equal(back_at, at) and np.array_equal(back, rows)


def test_pooling_in_blocks_equals_windows(monkeypatch):
    rng = np.random.default_rng(1)
    model = toxicity.Classifier()
    model.embedding[:-1] = rng.normal(size=(toxicity.BUCKETS, toxicity.DIM))
    model.offsets[:] = rng.normal(size=len(model.offsets))
    texts = [rng.integers(0, toxicity.BUCKETS, n).astype(np.int32) for n in (0, 1, 2, 3, 50, 130)]
    want = np.zeros((len(texts), len(model.offsets)))
    for i, words in enumerate(texts):
        e = np.concatenate([model.embedding[words], np.zeros((2, toxicity.DIM))])
        for j, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                answers = [sum(e[p + k] @ model.filters[j][k][:, f] for k in range(w)) + model.offsets[j * toxicity.FILTERS + f] for p in range(len(words))]
                want[i, j * toxicity.FILTERS + f] = max([0, *answers])
    for block in (7, 64, 1 << 16):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert np.allclose(model.pooled(texts), want, atol=1e-4)


def test_training_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    model = toxicity.Classifier()
    model.embedding[:50] = rng.normal(0, 0.5, (50, toxicity.DIM))
    texts, y = [rng.integers(0, 50, 20).astype(np.int32) for _ in range(40)], (rng.random(40) < 0.5).astype(float)
    loss = lambda: float(np.mean(np.logaddexp(0, z := model.logits(texts)) - y * z))
    before, state = loss(), {}
    for _ in range(60):
        toxicity._step(model, texts, y, state)
    assert loss() < 0.6 * before


def test_thresholds_and_single_labels():
    assert toxicity.best_threshold(np.array([3.0, 2.0, -1.0, -2.0]), np.array([1, 1, 0, 0])) == 0.5
    assert toxicity.fit([], np.zeros(0), []).scores([np.zeros(0, dtype=np.int32)]).tolist() == [0.0]
    assert toxicity.fit([np.arange(3, dtype=np.int32)], np.ones(1), ["a"]).scores([np.arange(2, dtype=np.int32)]).tolist() == [1.0]
    assert 0 <= toxicity.fit([np.arange(3, dtype=np.int32)] * 2, np.array([0, 1]), [None] * 2).scores([np.zeros(0, dtype=np.int32)])[0] <= 1


BLOCKED = "http://b.com/de/y"
LINKS = [
    ("http://a.net/x", '<link rel="canonical" href="/go?u=http://b.com/de/y">', "allow"),  # relative, whatever it holds
    ("http://f.net/p?x=1", '<link rel="canonical" href="?y=2">', "allow"),
    ("http://g.net/s", '<link rel="canonical" href="http://f.net/p?y=2"><meta http-equiv="refresh" content="0; url=http://b.com/de/q">', "block"),
    ("http://f.net/p?y=2", "", "block"),
    ("http://h.net/a/b/c", '<link rel="canonical" href="../z">', "block"),
    ("http://h.net/a/./x/../z", '<link rel="canonical" href="http://b.com/de/y">', "block"),
    ("http://i.net/1", '<!-- <link rel="canonical" href="http://b.com/de/y"> -->', "allow"),
    ("http://i.net/2", '<script>"<link rel=canonical href=http://b.com/de/y>"</script>', "allow"),
    ("http://i.net/3", '<!-- open <link rel="canonical" href="http://b.com/de/y">', "allow"),
    ("http://i.net/4", '<link rel="canonical" href="mailto:x?u=http://b.com/de/y">', "allow"),
    ("http://i.net/5", '<link rel="canonical" href="#top">', "allow"),
    ("http://i.net/6", '<link rel="canonical" href="//b.com/de/y">', "block"),
]


def test_links_resolve_as_browsers_do(spark):
    rows = [(k, url, html) for k, (url, html, _) in enumerate(LINKS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages).collect()}
    linked = {k: v for k, (_, _, v) in enumerate(LINKS)} | {1: "block"}  # f.net/p?y=2 is where its own query leads
    assert got == linked
    sql = run_sql(urls.OP7_SQL, "/root/testdata/sf0.001", {"pages": pages.toPandas()})
    assert dict(zip(sql["page_id"], sql["verdict"], strict=True)) == linked


GRANTS = [  # fixed values: openings of published licence notices
    ("BSD-3-Clause", "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.\n\n"
     "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Copyright 2019 The Foo Authors. All rights reserved.\n\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Copyright (c) 2021 Jane Doe. All rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, subject to the following conditions:\n\n"
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."),
    ("Proprietary", "Copyright (c) 2021 Jane Doe. All rights reserved."),
]


def test_open_licences_below_reserved_rights(spark):
    docs = spark.createDataFrame(list(enumerate(t for _, t in GRANTS)), "doc_id long, text string")
    got = {r.doc_id: r.licenses.split(",") for r in licenses.scan(docs).collect()}
    for k, (name, _) in enumerate(GRANTS):
        assert name in got[k] and ("Proprietary" in got[k]) == (name == "Proprietary"), (name, got[k])


def test_short_items_condemn_no_document(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "x y z")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a"), (2, "one two three four five six")], "item_id long, text string")
    assert decontamination.drop_contaminated(docs, bench).count() == 2
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, bench, short_items=True).collect()] == [2]
    assert [r.doc_id for r in decontamination.contaminated_pairs(docs, bench).collect()] == [1]


def test_many_tries_take_one_pass_and_are_built_in_tasks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 6, 40)) for _ in range(30)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(3)
    run = lambda: sorted(map(tuple, collocations.collocations(docs, least=3).collect()))
    want = run()
    monkeypatch.setattr(collocations, "SHARD", 5)
    monkeypatch.setattr(collocations, "_counts", lambda trie: pytest.fail("a pass for each trie"))
    assert len(want) > 100 and run() == want


def test_phrases_are_found_in_tries():
    from tesseral.llm.double_array import DoubleArray

    keys = np.array([[3, 5, 7], [3, 5, 9], [4, 4, 4], [9, 3, 5]], dtype=np.uint64)
    trie = DoubleArray(keys)
    asked = np.array([[4, 4, 4], [3, 5, 8], [3, 5, 9], [7, 7, 7], [9, 3, 7], [3, 5, 7], [5, 5, 7]], dtype=np.uint64)
    assert [trie.keys[k].tolist() if k >= 0 else None for k in trie.find(asked)] == [[4, 4, 4], None, [3, 5, 9], None, None, [3, 5, 7], None]
    assert trie.find(asked[:0]).tolist() == []
