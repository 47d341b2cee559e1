"""Licence recognition by sentence rules.

A text is normalised (A-Z lower-cased, every run of other characters than a-z,
0-9, '.', '+', '/' and '-' one space, marks of comments included) and cut into
sentences at blank lines and behind '.', '!' or '?' before white space, unless
that follows a single character ("v. 2", "1. ").  A single line end only wraps
a sentence.  Each sentence is mapped to the identifiers of all known licence
sentences it holds, from left to right, which gives the document's identifier
sequence.  Ordered rules recognise licences as subsequences of it; a rule of a
whole stands before those of its parts, which are not reported beside it.

DataFrame functions only, over whole texts: sentences never leave their row.
Only texts that may hold a known wording are normalised; the test for that is
made of the same wordings, with any separator between words, so that it lets
every text by that has an identifier.  A null, empty or
wordless text has no sentences and status `none`; `unknown` is a text with a
sentence that speaks of a licence while no rule fits.  A rule is found by one
pass over the sequence, however long it is.  Repeated rows are judged each for
themselves, an empty table gives an empty one, and further columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GNU = r"(?: as published by the free software foundation)?(?: either)?(?: version| v\.?)?"
_UNDER = r"(?:under|subject to|by)(?: the)?(?: terms of)?(?: the)?"

# Identifiers and wordings of known licence sentences, normalised.
# Wordings don't overlap within a sentence; where two start alike the longer one comes first.
SENTENCES = (
    ("apache-2.0-grant", r"(?:under|of) the apache(?: software)? licen[sc]e(?: version| v\.?)? ?2(?:\.0)?|apache licen[sc]e(?: version| v\.?)? ?2(?:\.0)?|apache-2\.0 licen[sc]e|under apache-2\.0"),
    ("apache-compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-copy", r"you may obtain a copy of the licen[sc]e at"),
    ("apache-basis", r"distributed under the licen[sc]e is distributed on an as[ -]is basis"),
    ("apache-limits", r"for the specific language governing permissions and limitations under the licen[sc]e"),
    ("mit-permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-deal", r"to deal in the software without restriction"),
    ("mit-condition", r"(?:the above|this) copyright notice(?:s)? and this permission notice (?:including the next paragraph )?shall be included in all copies"),
    ("as-is-software", r"the software is provided as[ -]is without warranty of any kind"),
    ("mit-grant", r"(?:under|of) (?:the terms of )?the mit(?: x11)? licen[sc]e|released under mit|mit licen[sc]ed"),
    ("mit-title", r"(?:the )?mit licen[sc]e"),
    ("bsd-use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-name", r"neither the name of .{0,200}?may be used to endorse or promote products|the names? of .{0,200}?may not be used to endorse or promote products"),
    ("bsd-disclaimer", r"this software is provided by .{0,120}?as[ -]is and any express or implied warranties"),
    ("bsd-3-grant", r"(?:3-clause|three-clause|modified|new|revised) bsd licen[sc]e|bsd[ -]3-clause licen[sc]e"),
    ("bsd-2-grant", r"(?:2-clause|two-clause|simplified|freebsd) bsd licen[sc]e|bsd[ -]2-clause licen[sc]e"),
    ("bsd-grant", r"(?:under|of) (?:the terms of )?(?:the |a )?bsd(?:-style)? licen[sc]e"),
    ("isc-permission", r"permission to use copy modify and(?:/or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd-permission", r"permission to use copy modify and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-disclaimer", r"the software is provided as[ -]is and the author disclaims all warranties"),
    ("isc-grant", r"(?:under|of) (?:the terms of )?the isc licen[sc]e"),
    ("zlib-warranty", r"this software is provided as[ -]is without any express or implied warranty"),
    ("zlib-origin", r"the origin of this software must not be misrepresented"),
    ("zlib-altered", r"altered source versions must be plainly marked as such"),
    ("boost-permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
    ("boost-grant", r"boost software licen[sc]e(?: -)?(?: version)? 1\.0"),
    ("gpl-redistribute", r"you can redistribute it and/or modify it under the terms of(?: the)?"),
    ("agpl-3.0-grant", rf"gnu affero general public licen[sc]e{_GNU} ?3(?:\.0)?|agpl ?-?v?3(?:\.0)?"),
    ("lgpl-2.1-grant", rf"gnu lesser general public licen[sc]e{_GNU} ?2\.1|lgpl ?-?v?2\.1"),
    ("lgpl-2.0-grant", rf"gnu library general public licen[sc]e{_GNU} ?2(?:\.0)?"),
    ("lgpl-3.0-grant", rf"gnu lesser general public licen[sc]e{_GNU} ?3(?:\.0)?|lgpl ?-?v?3(?:\.0)?"),
    ("lgpl-grant", r"gnu (?:lesser|library) general public licen[sc]e"),
    ("gpl-2.0-grant", rf"gnu general public licen[sc]e{_GNU} ?2(?:\.0)?|gnu gpl(?: version| v\.?)? ?2(?:\.0)?|gplv2"),
    ("gpl-3.0-grant", rf"gnu general public licen[sc]e{_GNU} ?3(?:\.0)?|gnu gpl(?: version| v\.?)? ?3(?:\.0)?|gplv3"),
    ("gfdl-grant", r"gnu free documentation licen[sc]e"),
    ("gpl-grant", r"gnu general public licen[sc]e|gnu gpl"),
    ("gpl-or-later", r"(?:at your option )?any later version"),
    ("gpl-hope", r"distributed in the hope that it will be useful but without any warranty"),
    ("mpl-2.0-grant", r"mozilla public licen[sc]e(?: version| v\.?)? ?2\.0"),
    ("mpl-1.1-grant", r"mozilla public licen[sc]e(?: version| v\.?)? ?1\.1"),
    ("mpl-copy", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-2.0-grant", r"eclipse public licen[sc]e(?: -)?(?: version| v\.?)? ?2\.0"),
    ("epl-1.0-grant", r"eclipse public licen[sc]e(?: -)?(?: version| v\.?)? ?1\.0"),
    ("cddl-grant", r"common development and distribution licen[sc]e"),
    ("eupl-grant", r"european union public licen[sc]e"),
    ("artistic-2.0-grant", r"artistic licen[sc]e(?: version| v\.?)? ?2\.0"),
    ("artistic-grant", r"artistic licen[sc]e"),
    ("ofl-1.1-grant", r"sil open font licen[sc]e(?: version| v\.?)? ?1\.1"),
    ("odbl-grant", r"open (?:data commons open )?database licen[sc]e"),
    ("unlicense-public", r"this is free and unencumbered software released into the public domain"),
    ("unlicense-use", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl-grant", r"do what the fuck you want to public licen[sc]e"),
    ("cc-by-nc-sa-grant", r"cc[ -]by-nc-sa(?:[ -][0-9]\.[0-9])?|creative commons attribution[ -]non-?commercial[ -]share-? ?alike|creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd-grant", r"cc[ -]by-nc-nd(?:[ -][0-9]\.[0-9])?|creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s?|creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-grant", r"cc[ -]by-nc(?:[ -][0-9]\.[0-9])?|creative commons attribution[ -]non-?commercial|creativecommons\.org/licenses/by-nc"),
    ("cc-by-sa-grant", r"cc[ -]by-sa(?:[ -][0-9]\.[0-9])?|creative commons attribution[ -]share-? ?alike|creativecommons\.org/licenses/by-sa"),
    ("cc-by-nd-grant", r"cc[ -]by-nd(?:[ -][0-9]\.[0-9])?|creative commons attribution[ -]no-?deriv(?:ative)?s?|creativecommons\.org/licenses/by-nd"),
    ("cc-by-grant", r"cc[ -]by[ -][0-9]\.[0-9]|creative commons attribution|creativecommons\.org/licenses/by"),
    ("cc0-grant", r"cc0(?:[ -]1\.0)?|creative commons zero|creativecommons\.org/publicdomain/zero"),
    ("public-domain", r"(?:released into|dedicated to|placed in|donated to|in) the public domain"),
    ("copyright-line", r"copyright (?:c )?[0-9]{4}|c copyright [0-9]{4}"),
    ("all-rights-reserved", r"all rights reserved"),
    ("no-permission", r"no part of this .{0,80}?may be reproduced|may not be (?:copied|reproduced|redistributed|distributed)"),
)
#: An SPDX tag with its whole expression; gives an identifier for each known name in it.
SPDX_TAG = r"spdx-license-identifier [a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*"

# SPDX licence names, besides the older forms of the GNU ones.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0",
    "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "OFL-1.1", "Unlicense", "WTFPL", "Zlib",
)
_OLDER = {f"{x.removesuffix('-only')}".lower(): x for x in SPDX if x.endswith("-only")} | {f"{x.removesuffix('-or-later')}+".lower(): x for x in SPDX if x.endswith("-or-later")}
SPDX_NAMES = {x.lower(): x for x in SPDX} | _OLDER

# Fixed values, in order: (licence, identifiers in order, licences of which this one is a part).
RULES = (
    ("Apache-2.0", ("apache-2.0-grant", "apache-compliance", "apache-copy", "apache-basis", "apache-limits"), ()),
    ("Apache-2.0", ("apache-2.0-grant", "apache-compliance", "apache-copy"), ()),
    ("Apache-2.0", ("apache-2.0-grant",), ()),
    ("BSL-1.0", ("boost-permission",), ()),
    ("BSL-1.0", ("boost-grant",), ()),
    ("MIT", ("mit-permission", "mit-deal", "mit-condition", "as-is-software"), ()),
    ("MIT", ("mit-permission", "mit-condition", "as-is-software"), ()),
    ("MIT", ("mit-grant",), ()),
    ("MIT-0", ("mit-permission", "mit-deal", "as-is-software"), ("MIT",)),
    ("MIT", ("mit-title",), ("MIT-0",)),
    ("BSD-4-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name"), ()),
    ("BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-name"), ("BSD-4-Clause",)),
    ("BSD-3-Clause", ("bsd-3-grant",), ("BSD-4-Clause",)),
    ("BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary"), ("BSD-4-Clause", "BSD-3-Clause")),
    ("BSD-2-Clause", ("bsd-2-grant",), ("BSD-4-Clause", "BSD-3-Clause")),
    ("BSD", ("bsd-use", "bsd-disclaimer"), ("BSD-4-Clause", "BSD-3-Clause", "BSD-2-Clause")),
    ("BSD", ("bsd-grant",), ("BSD-4-Clause", "BSD-3-Clause", "BSD-2-Clause")),
    ("ISC", ("isc-permission", "isc-disclaimer"), ()),
    ("ISC", ("isc-grant",), ()),
    ("0BSD", ("0bsd-permission", "isc-disclaimer"), ("ISC",)),
    ("Zlib", ("zlib-warranty", "zlib-origin", "zlib-altered"), ()),
    ("AGPL-3.0-or-later", ("agpl-3.0-grant", "gpl-or-later"), ()),
    ("AGPL-3.0-only", ("agpl-3.0-grant",), ("AGPL-3.0-or-later",)),
    ("LGPL-2.1-or-later", ("lgpl-2.1-grant", "gpl-or-later"), ()),
    ("LGPL-2.1-only", ("lgpl-2.1-grant",), ("LGPL-2.1-or-later",)),
    ("LGPL-2.0-or-later", ("lgpl-2.0-grant", "gpl-or-later"), ()),
    ("LGPL-2.0-only", ("lgpl-2.0-grant",), ("LGPL-2.0-or-later",)),
    ("LGPL-3.0-or-later", ("lgpl-3.0-grant", "gpl-or-later"), ()),
    ("LGPL-3.0-only", ("lgpl-3.0-grant",), ("LGPL-3.0-or-later",)),
    ("LGPL", ("lgpl-grant",), ("LGPL-2.0-or-later", "LGPL-2.0-only", "LGPL-2.1-or-later", "LGPL-2.1-only", "LGPL-3.0-or-later", "LGPL-3.0-only")),
    ("GPL-2.0-or-later", ("gpl-2.0-grant", "gpl-or-later"), ()),
    ("GPL-2.0-only", ("gpl-2.0-grant",), ("GPL-2.0-or-later",)),
    ("GPL-3.0-or-later", ("gpl-3.0-grant", "gpl-or-later"), ()),
    ("GPL-3.0-only", ("gpl-3.0-grant",), ("GPL-3.0-or-later",)),
    ("GPL", ("gpl-grant",), ("GPL-2.0-or-later", "GPL-2.0-only", "GPL-3.0-or-later", "GPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0-only", "LGPL-2.1-or-later", "LGPL-2.1-only", "LGPL-3.0-or-later", "LGPL-3.0-only", "LGPL")),
    ("GFDL", ("gfdl-grant",), ()),
    ("MPL-2.0", ("mpl-2.0-grant", "mpl-copy"), ()),
    ("MPL-2.0", ("mpl-2.0-grant",), ()),
    ("MPL-1.1", ("mpl-1.1-grant",), ()),
    ("EPL-2.0", ("epl-2.0-grant",), ()),
    ("EPL-1.0", ("epl-1.0-grant",), ()),
    ("CDDL", ("cddl-grant",), ()),
    ("EUPL", ("eupl-grant",), ()),
    ("Artistic-2.0", ("artistic-2.0-grant",), ()),
    ("Artistic", ("artistic-grant",), ("Artistic-2.0",)),
    ("OFL-1.1", ("ofl-1.1-grant",), ()),
    ("ODbL", ("odbl-grant",), ()),
    ("Unlicense", ("unlicense-public", "unlicense-use"), ()),
    ("WTFPL", ("wtfpl-grant",), ()),
    ("CC-BY-NC-SA", ("cc-by-nc-sa-grant",), ()),
    ("CC-BY-NC-ND", ("cc-by-nc-nd-grant",), ()),
    ("CC-BY-NC", ("cc-by-nc-grant",), ()),
    ("CC-BY-SA", ("cc-by-sa-grant",), ()),
    ("CC-BY-ND", ("cc-by-nd-grant",), ()),
    ("CC-BY", ("cc-by-grant",), ()),
    ("CC0-1.0", ("cc0-grant",), ()),
    ("Public-Domain", ("unlicense-public",), ("Unlicense",)),
    ("Public-Domain", ("public-domain",), ("Unlicense",)),
    *((name, (f"spdx-{name.lower()}",), ()) for name in SPDX),
    ("Proprietary", ("copyright-line", "all-rights-reserved"), ()),
    ("Proprietary", ("all-rights-reserved", "no-permission"), ()),
    ("Proprietary", ("copyright-line", "no-permission"), ()),
)
# A reserved copyright stands above many open licences: it counts where no other rule fits.
_OTHERS = tuple(dict.fromkeys(name for name, _, _ in RULES if name != "Proprietary"))
RULES = tuple((name, names, _OTHERS if name == "Proprietary" else wholes) for name, names, wholes in RULES)



def _split(pattern: str) -> list[str]:
    """The alternatives of a pattern outside of groups."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _openings(wording: str) -> list[str]:
    """The wording's alternatives, none of which starts with a group."""
    out = []
    for x in _split(wording):
        if not x.startswith("(?:"):
            out.append(x)
            continue
        end = next(k for k in range(3, len(x)) if x[: k + 1].count("(") == x[: k + 1].count(")"))
        rest = x[end + 1 :]
        for lead in [*_split(x[3:end]), ""][: None if rest.startswith("?") else -1]:
            out += _openings(lead + rest.removeprefix("?"))
    return out


def _by_letter(wordings: list[str]) -> str:
    """The wordings as one pattern that looks at a first letter once, in unchanged order under each."""
    groups: dict[str, list[str]] = {}
    for x in (x for w in wordings for x in _openings(w)):
        groups.setdefault(x[0], []).append(x[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items())


#: Everything known, and the words that make a sentence speak of a licence.
KNOWN = rf"\b(?:{SPDX_TAG}|(?:{_by_letter([w for _, w in SENTENCES])})\b)"
TALK = r"\blicen[sc](?:e|es|ed|ing)\b"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[\x20\x09-\x0D]"
_STOP = r"""([^\x20\x09-\x0D]{2}[.!?]["')\x5D]*)[\x20\x09-\x0D]+|\n[\x20\x09*#/;%>-]*\n[\x20\x09-\x0D]*"""
_KEPT = r"a-z0-9.+/\x01-"
_SEPARATOR = rf"[^{_KEPT}]+(?:[.+/-]+[^{_KEPT}]+)*"


def _unnormalised(wording: str) -> str:
    """A pattern that finds the wording in a text before its separators become
    single spaces; of one with a gap (".{0,") only the part before."""
    start = wording.split(".{")[0].replace("[ -]", "\0")
    return start.replace(" ", f"(?:{_SEPARATOR})").replace("\0", f"(?:{_SEPARATOR}|-)")


#: Every lower-cased text with an identifier has a match of this.
MAYBE = rf"licen[sc]|(?<![a-z0-9])(?:{_by_letter([_unnormalised(x) for _, w in SENTENCES for x in _split(w)])})"


def normalised(text: Column) -> Column:
    """The text with one space between words and U+0001 between sentences."""
    lines = F.replace(F.translate(text, _UPPER, _LOWER), F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(lines, _STOP, "$1\x01"), _SEPARATOR, " ")


def identifiers(sentence: Column) -> Column:
    """The identifiers of all known sentences that this one holds, left to right."""

    def name(found: Column) -> Column:
        out = F.lit(None).cast("string")
        for identifier, wording in reversed(SENTENCES):
            out = F.when(found.rlike(rf"^(?:{wording})$"), F.lit(identifier)).otherwise(out)
        return out

    def names(found: Column) -> Column:
        spdx = F.filter(F.transform(F.split(found, " "), lambda x: _spdx_name(x)), lambda x: x.isNotNull())
        return F.when(found.startswith("spdx-license-identifier "), spdx).otherwise(F.array(name(found)))

    return F.flatten(F.transform(F.regexp_extract_all(sentence, F.lit(KNOWN), F.lit(0)), names))


def _spdx_name(word: Column) -> Column:
    out = F.lit(None).cast("string")
    for spelled, name in SPDX_NAMES.items():
        out = F.when(word == spelled, F.lit(f"spdx-{name.lower()}")).otherwise(out)
    return out


def _fits(sequence: Column, names: tuple[str, ...]) -> Column:
    """Whether ';a;b;c;' holds the names in this order: each is searched behind the one before."""
    at = F.lit(1)
    for n in names:
        at = F.call_function("locate", F.lit(f";{n};"), sequence, at)
    return at > 0


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, sequence, licenses, status) of every row.

    n_sentences counts sentences with an identifier, `licence-talk` included,
    which stands for a sentence about a licence that holds nothing known;
    sequence joins the identifiers by ';' and licenses the recognised licences
    by ',' in the order of the rules.
    """
    none = F.array().cast("array<array<string>>")
    maybe = F.translate(text_col, _UPPER, _LOWER).rlike(MAYBE)
    texts = docs.select(F.col(id_col), F.when(maybe, normalised(F.col(text_col))).alias("plain"))
    talk = F.array(F.lit("licence-talk"))
    known = F.transform(F.split("plain", "\x01"), lambda s: F.when(s.rlike(KNOWN), identifiers(s)).when(s.rlike(TALK), talk).otherwise(F.array().cast("array<string>")))
    held = F.filter(known, lambda x: F.size(x) > 0)
    found = texts.select(id_col, F.coalesce(held, none).alias("ids"))
    rows = found.select(id_col, F.size("ids").cast("long").alias("n_sentences"), F.array_join(F.flatten("ids"), ";").alias("sequence"))
    marked = F.concat(F.lit(";"), F.col("sequence"), F.lit(";"))
    fits = F.array_compact(F.array(*(F.when(_fits(marked, names), F.lit(k)) for k, (_, names, _) in enumerate(RULES))))
    rows = rows.withColumn("fits", F.when(F.col("sequence") == "", F.array().cast("array<int>")).otherwise(fits))
    licence = F.array(*(F.lit(name) for name, _, _ in RULES))
    wholes = F.array(*(F.array(*map(F.lit, w)).cast("array<string>") for _, _, w in RULES))
    rows = rows.withColumn("fitting", F.transform("fits", lambda k: F.get(licence, k)))
    kept = F.filter("fits", lambda k: ~F.arrays_overlap(F.get(wholes, k), F.col("fitting")))
    return rows.withColumn("licenses", F.array_join(F.array_distinct(F.transform(kept, lambda k: F.get(licence, k))), ",")).select(
        id_col,
        "n_sentences",
        "sequence",
        "licenses",
        F.when(F.col("licenses") != "", "known").when(F.col("n_sentences") > 0, "unknown").otherwise("none").alias("status"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_fit(names: tuple[str, ...]) -> str:
    pattern = ";" + "".join(f"{n.replace('.', chr(92) + '.')};(?:.*;)?" for n in names[:-1]) + names[-1].replace(".", r"\.") + ";"
    return f"regexp_matches(seq, {_quoted(pattern)})"


def _sql_kept(wholes: tuple[str, ...]) -> str:
    return " OR ".join(f"f{k}" for w in wholes for k, r in enumerate(RULES) if r[0] == w) or "FALSE"


_SQL_NAME = "CASE " + " ".join(f"WHEN regexp_full_match(m, {_quoted(w)}) THEN '{n}'" for n, w in SENTENCES) + " END"
_SQL_SPDX = "CASE " + " ".join(f"WHEN x = '{s}' THEN 'spdx-{n.lower()}'" for s, n in SPDX_NAMES.items()) + " END"
OP3_SQL = rf"""
WITH plain AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(regexp_replace(regexp_replace(replace(translate(text, '{_UPPER}', '{_LOWER}'), chr(13) || chr(10), chr(10)),
    {_quoted(_STOP)}, '\1' || chr(1), 'g'), {_quoted(_SEPARATOR)}, ' ', 'g'), chr(1)) AS parts FROM documents
), sentences AS (
  SELECT r, unnest(parts) AS s, generate_subscripts(parts, 1) AS place FROM plain
), hits AS (
  SELECT r, place, s, regexp_extract_all(s, {_quoted(KNOWN)}) AS found FROM sentences
), named AS (
  SELECT r, place, CASE WHEN len(found) = 0 THEN CASE WHEN regexp_matches(s, {_quoted(TALK)}) THEN ['licence-talk'] ELSE [] END
    ELSE flatten(list_transform(found, lambda m: CASE WHEN starts_with(m, 'spdx-license-identifier ')
      THEN list_filter(list_transform(string_split(m, ' '), lambda x: {_SQL_SPDX}), lambda x: x IS NOT NULL) ELSE [{_SQL_NAME}] END)) END AS names
  FROM hits
), sequences AS (
  SELECT r, count(*)::BIGINT AS n, string_agg(array_to_string(names, ';'), ';' ORDER BY place) AS sequence FROM named WHERE len(names) > 0 GROUP BY r
), joined AS (
  SELECT p.doc_id, coalesce(q.n, 0) AS n_sentences, coalesce(q.sequence, '') AS sequence, ';' || coalesce(q.sequence, '') || ';' AS seq
  FROM plain p LEFT JOIN sequences q USING (r)
), fitted AS (
  SELECT *, {", ".join(f"{_sql_fit(names)} AS f{k}" for k, (_, names, _) in enumerate(RULES))} FROM joined
), ruled AS (
  SELECT *, [{", ".join(f"CASE WHEN f{k} AND NOT ({_sql_kept(w)}) THEN '{name}' END" for k, (name, _, w) in enumerate(RULES))}] AS kept FROM fitted
), told AS (
  SELECT doc_id, n_sentences, sequence, array_to_string(list_filter(kept, lambda x, i: x IS NOT NULL AND list_position(kept, x) = i), ',') AS licenses FROM ruled
)
SELECT doc_id, n_sentences, sequence, licenses,
  CASE WHEN licenses <> '' THEN 'known' WHEN n_sentences > 0 THEN 'unknown' ELSE 'none' END AS status
FROM told
"""
