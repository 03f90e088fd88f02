"""The dealt operators as queries over the given tables, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm import chat_format, exact_dedup, html_extract, jaccard_join, language_id, mixing, packing, pii, rp_forest, toxicity
from cohortspark.llm import va_file, warc, whitening
from cohortspark.llm.common import table

#: Secret of the pseudonyms; a deployment passes its own.
PII_KEY = "cohortspark-demo-key"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


@query("op1_html_extract")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op3_exact_dedup", exact_dedup.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op4_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), words=3, p=90, q=100)


@query("op5_mixing", mixing.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


@query("op10_embedding_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.embedding_classes(table(spark, sf_dir, "embeddings"))


@query("op7_warc", warc.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op11_centroid_clustering", va_file.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.cluster_table(table(spark, sf_dir, "embeddings"))


@query("op12_chat_format", chat_format.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_and_read(table(spark, sf_dir, "conversations"))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
