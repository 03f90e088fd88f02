"""One row, or the k best rows, per key.

A row_number filter makes Catalyst keep at most k rows of a key in every map
task (WindowGroupLimit) before anything is shuffled, so a key that holds a third
of all rows sends only k rows per task to its reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_per_group(
    df: DataFrame, by: str | Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """The first k rows of every group in the given order; `rank` names an output rank column."""
    keys = [by] if isinstance(by, str) else list(by)
    numbered = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = numbered.where(F.col("_rank") <= k)
    return kept.drop("_rank") if rank is None else kept.withColumnRenamed("_rank", rank)


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key by an explicit order column."""
    return topk_per_group(df, key, [F.col(order).asc_nulls_last()], 1)


def dedup_longest(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The row with the longest text of every key; missing text last, ties by `order`."""
    longest = F.length(text).desc_nulls_last()
    return topk_per_group(df, key, [longest, F.col(order).asc_nulls_last()], 1)


def ranked_limit(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The global top k with a 1-based rank: the rank window sees only the k rows kept."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows picked by the hash of key and seed: the same rows whatever the partitioning."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(digest, F.col(key)).limit(n)
