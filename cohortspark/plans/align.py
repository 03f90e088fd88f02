"""Aligning the mutation table with the report table by patient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import ids as I
from cohortspark.operators import aggregates as A
from cohortspark.operators import overlap as O
from cohortspark.operators.dedup import dedup_first


def with_mutation_patient(mutations: DataFrame) -> DataFrame:
    """Rows with a barcode, keyed by the identifier at its start."""
    return mutations.where(F.col("Tumor_Sample_Barcode").isNotNull()).select(
        "Hugo_Symbol",
        "Variant_Classification",
        I.patient_id_barcode(F.col("Tumor_Sample_Barcode")).alias("Patient_ID"),
    )


def with_report_patient(reports: DataFrame) -> DataFrame:
    """Reports whose file name holds an identifier, keyed by it."""
    keyed = reports.withColumn("Patient_ID", I.patient_id_extract(F.col("patient_filename")))
    return keyed.where(F.col("Patient_ID").isNotNull())


def mutations_matched(mutations: DataFrame, reports: DataFrame) -> DataFrame:
    """Mutation rows of patients that have a report.

    A patient with very many mutation rows makes one join partition large; adaptive
    execution splits it, provided that plain shuffles feed the join. Distinct report
    ids straight below it would be an aggregation instead, so they are made distinct
    per id and part: at most `parts` rows per id reach the join, on a shuffle of its own.
    """
    parts = 32
    ids = reports.select("Patient_ID", (F.spark_partition_id() % parts).alias("_part")).distinct()
    return mutations.join(ids.select("Patient_ID"), "Patient_ID", "left_semi").select(
        "Hugo_Symbol", "Variant_Classification", "Patient_ID"
    )


def align(mutations: DataFrame, reports: DataFrame, order: str = "row_order") -> DataFrame:
    """One row per patient in both tables: first report, mutation summary, cohort.

    The mutation rows are reduced to one row per patient before the join, so the
    join has unique keys on both sides and no skew.
    """
    summary = A.patient_mutation_summary(mutations)
    first = dedup_first(reports, "Patient_ID", order)
    return first.join(summary, "Patient_ID").withColumn("Cohort", I.cohort(F.col("Patient_ID"))).drop(order)


def cohort_counts(merged: DataFrame) -> DataFrame:
    return A.value_counts(merged, "Cohort", "n_patients")


def alignment_summary(mutations: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: rows, patients per source, overlap, and the number of distinct cohorts matched."""
    overlap = O.overlap_summary(mutations, reports)
    common = O.in_both(mutations, reports)
    cohorts = common.agg(F.count_distinct(I.cohort(F.col("Patient_ID"))).alias("n_cohorts"))
    rows = mutations.agg(F.count(F.lit(1)).alias("n_mutation_rows"))
    return overlap.crossJoin(F.broadcast(cohorts)).crossJoin(F.broadcast(rows))


def invariants(features: DataFrame, labels: DataFrame, id_col: str = "Patient_ID") -> DataFrame:
    """One row: rows and distinct ids on both sides, and ids that only one side has."""
    sides = [
        df.agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.count_distinct(id_col).alias(f"{name}_ids"))
        for name, df in (("features", features), ("labels", labels))
    ]
    flags = O.overlap_summary(features.select(id_col), labels.select(id_col), id_col)
    gaps = flags.select(F.col("n_only_a").alias("only_features"), F.col("n_only_b").alias("only_labels"))
    return sides[0].crossJoin(F.broadcast(sides[1])).crossJoin(F.broadcast(gaps))


def check_invariants(features: DataFrame, labels: DataFrame, id_col: str = "Patient_ID") -> None:
    """Raise unless both sides have the same, unique ids."""
    row = invariants(features, labels, id_col).first()
    counts = {row.features_rows, row.features_ids, row.labels_rows, row.labels_ids}
    if len(counts) != 1 or row.only_features or row.only_labels:
        raise ValueError(f"features and labels do not line up: {row.asDict()}")
