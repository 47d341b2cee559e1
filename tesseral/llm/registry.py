"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tesseral.llm import collocations, decontamination, filter_audit, fingerprints, language, licenses, mixing, ngram_join, pii, quality, toxicity, urls, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_licenses": licenses.op3_licenses,
    "op4_language": language.op4_language,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_mixing": mixing.op6_mixing,
    "op7_urls": urls.op7_urls,
    "op8_pii": pii.op8_pii,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_warc": warc.op10_warc,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_collocations": collocations.op12_collocations,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op3_licenses": licenses.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_urls": urls.OP7_SQL,
    "op9_fingerprints": fingerprints.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
