"""Delimited text in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark import constants as C
from cohortspark.sources.split_csv import read_split_csv

MUTATION_COLUMNS = ("Hugo_Symbol", "Tumor_Sample_Barcode", "Variant_Classification")
REPORT_COLUMNS = ("patient_filename", "text")
# a line up to the first "#" outside quotes, and the rest of it
COMMENT = r'^((?:[^"#]++|"(?:[^"]++|"")*+")*+)#.*$'


def normalize_na(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn every spelling of a missing value into NULL, in the given (default: all string) columns."""
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    missing = {c: F.when(~F.col(c).isin(list(C.NA_TOKENS)), F.col(c)) for c in columns}
    return df.withColumns(missing)


def read_mutations(
    spark: SparkSession, path: str, columns: Sequence[str] = MUTATION_COLUMNS, inline_comments: bool = True
) -> DataFrame:
    """Tab-separated rows with a header line and "#" comments; only `columns`, as nullable strings.

    With `inline_comments` everything from the first "#" outside quotes on is cut. Spark's
    own comment option drops only whole lines, so the lines are read as text and
    parsed by expression; the file stays splittable and unused columns unparsed.
    """
    if not inline_comments:
        raw = spark.read.csv(path, sep="\t", header=True, comment="#", escape='"')
        return normalize_na(raw.select(*columns))
    lines = spark.read.text(path).select(F.regexp_replace("value", COMMENT, "$1").alias("line")).where("line <> ''")
    first = lines.head()
    if first is None:
        raise ValueError(f"no header line in {path}")
    header = first.line
    names = [name.strip() for name in header.split("\t")]
    lacking = [c for c in columns if c not in names]
    if lacking:
        raise ValueError(f"columns {lacking} not in the header of {path}")
    schema = ", ".join(f"`{name}` string" for name in names)
    parsed = F.from_csv("line", F.lit(schema), {"sep": "\t", "escape": '"', "mode": "PERMISSIVE"})
    rows = lines.where(F.col("line") != header).select(parsed.alias("row"))
    return normalize_na(rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns]))


def read_reports(spark: SparkSession, path: str, columns: Sequence[str] = REPORT_COLUMNS) -> DataFrame:
    """Comma-separated free text with quoted line breaks and doubled quotes, plus `row_order`.

    `row_order` (file, place) follows the files by name and the order in each, whatever files or parts of
    files share a task, for operators that keep a first row. A file is read in ranges (`split_csv`).
    """
    return normalize_na(read_split_csv(spark, path).select(*columns, "row_order"), columns)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Tab-separated table with header: trimmed names, missing values as NULL, columns cast to `schema`."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=False)
    trimmed = raw.toDF(*[c.strip() for c in raw.columns])
    return normalize_na(trimmed).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def write_tsv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Tab-separated with header; missing values as empty fields. One file only on request."""
    out = df.coalesce(1) if single_file else df
    out.write.csv(path, sep="\t", header=True, quote='"', escape='"', nullValue="", emptyValue="")


def write_lines(df: DataFrame, path: str, order: str = "ord", line: str = "line") -> None:
    """A short text report: its lines in order, in one file."""
    df.coalesce(1).sortWithinPartitions(order).select(line).write.text(path)
