"""Labelled, cleaned report texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.functions import text as X
from cohortspark.functions import values as V
from cohortspark.operators.dedup import dedup_longest


def build_text_dataset(labels: DataFrame, reports: DataFrame, order: str = "row_order") -> DataFrame:
    """(Patient_ID, clean_text, Mutation_Status): longest report per labelled patient, cleaned, never blank."""
    longest = dedup_longest(reports.select("Patient_ID", "text", order), "Patient_ID", "text", order)
    merged = labels.select("Patient_ID", "Mutation_Status").join(longest, "Patient_ID")
    # A plain filter on clean_text would be pushed below the projection and clean every
    # text a second time; keeping the non-empty ones of a one-element array does it once.
    cleaned = F.filter(F.array(X.clean_text(F.col("text"))), lambda t: t != "")
    return merged.where(X.is_nonempty_text(F.col("text"))).select(
        "Patient_ID", F.explode(cleaned).alias("clean_text"), "Mutation_Status"
    )


def encode_labels(dataset: DataFrame, status: str = "Mutation_Status") -> DataFrame:
    """Add the three-class and the binary label."""
    return dataset.withColumn("y_3class", V.value_map(F.col(status), C.LABEL_3CLASS)).withColumn(
        "y_binary", V.value_map(F.col(status), C.LABEL_BINARY)
    )
