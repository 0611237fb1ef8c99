"""The corpus pipeline: each stage reads what its predecessor wrote and passes documents on.

Stages keep the columns of ``documents``; the last one returns token counts and digests. Every stage takes nulls in
any column, empty and very long texts, repeated rows and ids, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm import bpe, decontaminate, langid, line_dedup, near_dedup
from regspark.llm.common import discard, scratch_path, stored, table

#: Language ID and the word-level encoder have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letters (null and empty texts too), or far from every learned
    centroid. Repeated rows go or stay together. Where no row has a language, nothing can be learned and all go."""
    found = langid.predict(docs, langid.fit(docs))
    return found.filter("lang_accepted").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; n_chars follows the text. A null text becomes an empty one; a null id is a document of
    its own, below all others; rows of one id are one document."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, the one of the smallest id; repeated rows of it stay
    together. Null and empty texts are equal texts: one of them stays."""
    return near_dedup.keep_one(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Null and empty texts hold none and stay; repeated
    rows go or stay together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left, row by row; null and empty texts have no tokens."""
    return bpe.digests(docs, pieces=50_000)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("bpe", encode_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages one after the other; what a stage has written is deleted when its successor is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        docs = stored(stage(spark, docs, sf_dir), name, path)
        if last:
            discard(spark, last)
        last = path
    return docs
