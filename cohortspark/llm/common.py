"""What several operators share: table access, held-out rows, bounded label samples."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import discard, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Words of a text: everything between ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold(doc_id: Column) -> Column:
    """crc32(id as text) mod 5; a null id counts as empty text, so it lies in fold 0."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def bounded_sample(rows: DataFrame, label: str, rows_per_label: int, seed: str, keys: list[str]) -> DataFrame:
    """About `rows_per_label` rows of each label, chosen by the hash of `keys`; smaller labels whole.

    The share kept of a label is `rows_per_label / its rows`, so the sample has a bound that does not
    grow with the table, and the same rows are chosen on every run. Only the count of each class to be
    learned reaches the driver; rows are filtered where they are read and none is shuffled.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return rows
    shares = F.create_map(*[F.lit(v) for r in counts for v in (r[label], rows_per_label / r["n"])])
    unit = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(unit < F.element_at(shares, F.col(label)))


def release_arrow() -> None:
    """Give back to the system what freed Arrow tables still hold in this process: on the driver, after tables came in."""
    pa.default_memory_pool().release_unused()


__all__ = [
    "ASCII_LOWER",
    "DOCUMENT_COLUMNS",
    "WORD",
    "WORD_PATTERN",
    "ascii_lower",
    "bounded_sample",
    "discard",
    "fold",
    "held_out",
    "release_arrow",
    "stored",
    "table",
]
