"""Corpus pipeline over `documents`.

Five stages, each over all rows that its predecessor kept: language ID drops
documents without a leading language (its models learn from all documents with
one given), of every group of near copies one document of the least id stays, documents holding a benchmark item go, personal data is replaced in
the texts (n_chars follows), and the sources are mixed to their target weights.  The first four
return the columns of documents; the last returns a row for every document with
its source's target and the words that the mix takes of it, 0 where it is left
out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm import decontamination, language, mixing, ngram_join, pii
from tesseral.llm.shared import discard, materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train(docs))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    length = F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))
    return pii.redact(docs).withColumn("n_chars", length)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(sized).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language", identify_language),
    ("near_copies", join_near_copies),
    ("benchmark", remove_benchmark),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the mixture models; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
