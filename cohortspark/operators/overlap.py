"""How two tables overlap in their identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).alias("Patient_ID")).where(F.col("Patient_ID").isNotNull()).distinct()


def membership(a: DataFrame, b: DataFrame, col: str = "Patient_ID") -> DataFrame:
    """One row per identifier with flags in_a and in_b.

    One aggregation instead of two distincts and an outer join: the flags merge
    in the map tasks, so a frequent identifier costs one row per task.
    """
    left = a.select(F.col(col).alias("Patient_ID"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    right = b.select(F.col(col).alias("Patient_ID"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    return (
        left.unionAll(right)
        .where(F.col("Patient_ID").isNotNull())
        .groupBy("Patient_ID")
        .agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    )


def overlap_summary(a: DataFrame, b: DataFrame, col: str = "Patient_ID") -> DataFrame:
    """One row: |A|, |B|, |A and B|, |A - B|, |B - A|."""
    flags = membership(a, b, col)
    both = F.col("in_a") * F.col("in_b")
    return flags.agg(
        *[
            F.coalesce(F.sum(value.cast("long")), F.lit(0)).alias(name)
            for name, value in {
                "n_a": F.col("in_a"),
                "n_b": F.col("in_b"),
                "n_common": both,
                "n_only_a": F.col("in_a") - both,
                "n_only_b": F.col("in_b") - both,
            }.items()
        ]
    )


def only_in(a: DataFrame, b: DataFrame, col: str = "Patient_ID") -> DataFrame:
    """Distinct identifiers of `a` that `b` does not have."""
    return membership(a, b, col).where("in_a = 1 AND in_b = 0").select("Patient_ID")


def in_both(a: DataFrame, b: DataFrame, col: str = "Patient_ID") -> DataFrame:
    return membership(a, b, col).where("in_a = 1 AND in_b = 1").select("Patient_ID")


def sample_mismatches(a: DataFrame, b: DataFrame, n: int = 5, col: str = "Patient_ID") -> DataFrame:
    """The first n identifiers, sorted, that only one side has, for each side."""
    flags = membership(a, b, col)
    sides = [
        flags.where(f"{here} = 1 AND {there} = 0")
        .select(F.lit(side).alias("side"), "Patient_ID")
        .orderBy("Patient_ID")
        .limit(n)
        for side, here, there in (("only_a", "in_a", "in_b"), ("only_b", "in_b", "in_a"))
    ]
    return sides[0].unionAll(sides[1])
