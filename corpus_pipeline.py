"""The corpus pipeline: five stages over documents, each written and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the
last return the rows that stay, with the columns of documents. Rows whose language is
rejected go, then all but one of each group of equal texts, then all but one of each
component of near duplicates, then contaminated rows; the last stage encodes what is
left. Nulls, ties and empty tables are as each operator's module says.

The model of the first stage is trained, so no SQL gives the same rows; the stages are
tested against brute force in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import bpe_codec, decontaminate, exact_dedup, language_id, near_dedup
from pulsegrid.llm.common import Scratch

ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model of their own labels recognises."""
    return language_id.drop_rejected(docs, language_id.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, of a similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, similarity=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids."""
    return bpe_codec.encode(docs).select("doc_id", "n_tokens", "token_ids")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", clean),
    ("bpe_encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
