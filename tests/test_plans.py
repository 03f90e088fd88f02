"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from helpers import SMALL
from cohortspark.catalog import views as W
from cohortspark.operators import aggregates as A
from cohortspark.operators import dedup as D
from cohortspark.operators import metrics as M
from cohortspark.operators import splits as S
from cohortspark.operators import tfidf as TI
from cohortspark.plans import align as AL
from cohortspark.plans.text_dataset import build_text_dataset

PYTHON = re.compile(r"ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroups|PythonMapInArrow")
ALLOWED_PYTHON = {"strip_accents", "embed_documents"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = [
    "align_merged", "patient_labels", "patient_report", "gene_report", "cohort_report", "error_report", "clinical_summary",
    "clean_text", "text_dataset", "tfidf_vocab", "tfidf_weights", "tokenize_pattern", "word_ngrams", "auc_global",
    "auc_by_group", "roc_curve", "stratified_split", "stratified_folds", "class_distribution", "overlap_summary",
    "masked_mean_pool", "l2_normalize",
]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(driver.queries()[name](spark, SMALL))
    assert not PYTHON.search(text)
    assert "CartesianProduct" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(W.labels(spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_type:string>" in text


def test_dedup_prunes_before_the_shuffle(spark):
    text = plan(D.dedup_longest(W.reports_multi(spark, SMALL), "Patient_ID", "text", "row_order"))
    partial, exchange = text.index(", Partial"), text.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in text and exchange < partial  # plans print top down


def test_gene_sets_are_deduplicated_over_all_tasks_first(spark):
    text = plan(A.patient_gene_sets(W.mutations(spark, SMALL)))
    assert re.search(r"Exchange hashpartitioning\(Patient_ID#\d+, gene#\d+", text)


def test_alignment_joins_one_row_per_patient(spark):
    text = plan(AL.align(W.mutations(spark, SMALL), W.reports(spark, SMALL)))
    join = min(i for i in (text.find("SortMergeJoin"), text.find("BroadcastHashJoin [Patient_ID"), text.find("ShuffledHashJoin")) if i >= 0)
    assert join < text.index("collect_set")


def test_split_joins_measured_cuts_by_broadcast(spark):
    df = W.table(spark, SMALL, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    split = S.stratified_split(df, "o_orderkey", "o_orderstatus")
    split.collect()
    final = plan(split).split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final


def test_tfidf_shuffles_terms_only(spark):
    docs = W.table(spark, SMALL, "documents").select("doc_id", F.lower("text").alias("t"))
    fitted = plan(TI.term_statistics(docs, "t"))
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", fitted) == ["term"]
    assert "Generate" not in fitted and fitted.count("MapInArrow") >= 1
    weights = plan(TI.fit_tfidf(docs, "t").weights(docs, "doc_id", "t"))
    assert "Exchange" not in weights


def test_texts_are_cleaned_once(spark):
    text = build_text_dataset(W.labels(spark, SMALL), W.reports(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("adenoca(?<") == 1


def test_auc_windows_are_split_into_buckets(spark):
    scored = W.scored(spark, SMALL)
    text = plan(M.auc(scored, "label", "score"))
    raw_windows = [line for line in text.splitlines() if " Window [" in line and "score#" in line]
    assert raw_windows and all("_bucket" in line for line in raw_windows)


def test_skewed_semi_join_is_split(spark):
    """A patient with a third of all rows: adaptive execution splits its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = spark.range(200_000, numPartitions=8).select(
            F.col("id").cast("string").alias("Hugo_Symbol"),
            F.lit("v").alias("Variant_Classification"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("Patient_ID"),
        )
        reports = spark.range(150_000).select(F.col("id").cast("string").alias("Patient_ID"))
        reports = reports.unionAll(spark.createDataFrame([("hot",)], "Patient_ID string"))
        matched = AL.mutations_matched(hot, reports)
        assert len(matched.collect()) == 66_667 + 100_000
        assert "skew=true" in plan(matched)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_ties_do_not_gather_scores_in_one_bucket(spark):
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 100 != 0, 0.5).otherwise(F.col("id") / 200_000.0).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label")
    )
    counts = M._bucketed_counts(rows, "label", "score", [], None)
    sizes = [r["count"] for r in counts.groupBy("_bucket").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 4 * sum(sizes) / len(sizes)


def test_thousands_of_classes(spark):
    df = spark.range(9000).select("id", (F.col("id") % 3000).cast("string").alias("class"))
    assert S.stratified_split(df, "id", "class").where("split = 'test'").count() == 3000
    counted = A.class_distribution(df, "class", ["7", "absent"]).collect()
    assert [(r["class"], r.n) for r in counted] == [("7", 3), ("absent", 0)]
    assert A.with_balanced_weight(df, "class").count() == 9000


def test_rows_without_a_class_are_dealt_into_folds_too(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "a") for i in range(20)], "id long, class string")
    assert S.stratified_folds(df, "id", "class", 5).count() == 20
