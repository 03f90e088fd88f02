"""Exact duplicates: group by a 128-bit content hash, compare bytes inside groups, keep one row.

DataFrame functions only. The hash travels with narrow rows; texts are shuffled once, as a
grouping key next to the hash, so the aggregation itself compares bytes and a group of copies
shrinks to one row per map task before the shuffle, however large it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import ascii_lower


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hashed: Callable[[Column], Column] = content_hash,
    keep: str = "max",
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes after lower-casing A-Z. The row with the largest
    (`keep="max"`) or smallest (`keep="min"`) id of a group stays. Null texts count as empty. A null
    id never wins against another id; in a group of null ids only, one row stays. Of rows repeated
    with the same id and text exactly one stays. Other columns are ignored, an empty table gives an
    empty result. `hashed` may be weak: rows of one hash are still told apart by their bytes.
    """
    chosen = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("h", hashed(F.col("norm")))

    by_bytes = rows.groupBy("h", "norm").agg(chosen("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = (
        by_bytes.select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
        .groupBy("h", "text_sha256")
        .agg(
            F.first("keep_id").alias("keep_id"),
            F.first("group_size").alias("group_size"),
            F.count(F.lit(1)).alias("texts"),
        )
    )
    # two texts with both hashes equal cannot be told apart by narrow rows: refuse rather than merge
    both_equal = F.raise_error(F.lit("different texts share the content hash and SHA-256")).cast("long")
    groups = groups.select(
        "h", "text_sha256", "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(both_equal).alias("group_size")
    )

    # equal rows collapse first, so that exactly one of them is marked as kept
    narrow = (
        rows.select("id", "h", F.sha2("norm", 256).alias("text_sha256"))
        .groupBy("id", "h", "text_sha256")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return (
        narrow.join(groups, ["h", "text_sha256"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Of rows with the same id and text one stays."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept")
    kept = kept.select(F.col(id_col).alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"))
    columns = docs.columns
    tagged = docs.withColumn("_sha", F.sha2(ascii_lower(F.col(text_col)), 256))
    chosen = tagged.join(
        kept, F.col(id_col).eqNullSafe(F.col("_keep_id")) & (F.col("_sha") == F.col("_keep_sha")), "left_semi"
    )
    order = [F.col(c) for c in columns if c != id_col]
    first = F.row_number().over(Window.partitionBy(id_col, "_sha").orderBy(*order))
    return chosen.withColumn("_copy", first).where("_copy = 1").select(*columns)


ORACLE = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
  FROM (SELECT doc_id,
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents))
"""
