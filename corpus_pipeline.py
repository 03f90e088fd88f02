"""A corpus from raw documents to packed sequences: five operators, each on all that the one before it kept.

    language ID       documents without a language go
    exact dedup       one of equal texts stays
    near dedup        one of each class of near-equal texts stays (5-word shingles, Jaccard 0.8)
    mixing            documents are taken as often as their source's target asks, repeats as rows of their own
    packing           the mix as sequences of 1024 tokens

Every stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame; what it returns is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from cohortspark.llm.common import DOCUMENT_COLUMNS, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*DOCUMENT_COLUMNS)
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs.select(*DOCUMENT_COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_duplicates(docs.select(*DOCUMENT_COLUMNS), words=5, p=8, q=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs.select(*DOCUMENT_COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select(*DOCUMENT_COLUMNS))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Language, near duplicates and packing are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
