"""Quoted CSV with line breaks inside values, read by many tasks a file.

A line break may lie inside a value, so where a range of a file begins nobody can say whether its first line
begins a record. It can only begin one or go on inside quotes, though, and a range read under both assumptions
says what either leads to:

1. Each range is read as lines once. One row a range comes out: whether it ends inside quotes under each
   assumption, the lines before the first record start, and the record left open at its end.
2. Over these rows, file by file, a window finds how each range really begins. That is more than counting
   quotes: a stray quote in an unquoted value opens nothing, so what a range does to the state is a function of it
   and functions are composed. The record left open is joined with the first lines of the ranges after it.
3. The ranges are read again, each from its first true record start, and every record is parsed by Spark's own
   CSV expression.

Lines come from Spark's text source, so the file may lie in any store Spark reads, and its splits are the ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.session import stored

OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n", "mode": "PERMISSIVE"}
_CLOSING = re.compile(rb'(?:[^"]|"")*+"')
RANGES = (
    "file string, block long, from_record boolean, from_quotes boolean, first binary, "
    "open_0 binary, open_1 binary, starts_0 long, starts_1 long"
)


def ends_in_quotes(line: bytes, inside: bool) -> bool:
    """Whether the line break behind `line` lies inside a quoted value, if the one before it did (`inside`)."""
    if b'"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith(b'"', at):
            closing = _CLOSING.match(line, at if inside else at + 1)
            if closing is None:
                return True
            at, inside = closing.end(), False
        # a quote that does not begin a value, or comes after one has closed, means nothing
        at = line.find(b",", at) + 1
        if at == 0:
            return False


class _Reading:
    """A range under one assumption: the records that begin in it, the last of which may stay open."""

    def __init__(self, inside: bool) -> None:
        self.inside = inside
        self.starts = 0
        self.first: list[bytes] = []
        self.record: list[bytes] | None = self.first if inside else None

    def read(self, line: bytes) -> list[bytes] | None:
        """The lines of the record that ends with this line, if it began in the range and one ends."""
        if not self.inside:
            if not line.rstrip(b"\r"):
                return None
            self.record = []
            self.starts += 1
        self.record.append(line)
        self.inside = ends_in_quotes(line, self.inside)
        return None if self.inside or self.record is self.first else self.record

    @property
    def open(self) -> bytes | None:
        return b"\n".join(self.record) if self.inside and self.record is not self.first else None


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[bytes]]]:
    """(file, block, start of the range in its batch, lines): consecutive lines of one range, batch by batch."""
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        lines, start = batch.column("line").to_pylist(), 0
        for at in range(1, len(lines) + 1):
            if at == len(lines) or blocks[at] != blocks[start] or files[at] != files[start]:
                yield files[start], blocks[start], start, lines[start:at]
                start = at


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of `RANGES` for each range."""
    names = [column.split()[0] for column in RANGES.split(", ")]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.binary()] * 3, pa.int64(), pa.int64()]

    def row(place: tuple[str, int], readings: list[_Reading]) -> pa.RecordBatch:
        from_record, from_quotes = readings
        values = [
            *place, from_record.inside, from_quotes.inside, b"\n".join(from_quotes.first),
            from_record.open, from_quotes.open, from_record.starts, from_quotes.starts,
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    place, readings = None, []
    for file, block, _, lines in _by_range(batches):
        if (file, block) != place:
            if place is not None:
                yield row(place, readings)
            place, readings = (file, block), [_Reading(False), _Reading(True)]
        for line in lines:
            for reading in readings:
                reading.read(line)
    if place is not None:
        yield row(place, readings)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, place, record) of all records that begin and end in their range."""

    place, reading = None, None
    for batch in batches:
        inside = batch.column("inside")
        found: list[tuple[str, int, bytes]] = []
        for file, block, start, lines in _by_range(iter([batch])):
            if (file, block) != place:
                place, reading = (file, block), _Reading(inside[start].as_py())
            for line in lines:
                record = reading.read(line)
                if record is not None:
                    found.append((file, block + reading.starts - 1, b"\n".join(record)))
        if found:
            files, places, texts = zip(*found)
            columns = [pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "place", "record"])


def resolved(ranges: DataFrame) -> DataFrame:
    """The ranges with `inside`: whether each begins inside quotes. The window holds one narrow row a range."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("from_record") == F.col("from_quotes")
    turned = F.sum((F.col("from_record") & ~F.col("from_quotes")).cast("int"))
    known = ranges.withColumn("turned", turned.over(upto)).withColumn("last", F.when(fixed, F.struct("from_record", "turned")))
    last = F.last("last", ignorenulls=True).over(before)
    turns = F.coalesce(F.lag("turned").over(Window.partitionBy("file").orderBy("block")), F.lit(0)) - F.coalesce(last["turned"], F.lit(0))
    return known.withColumn("inside", F.coalesce(last["from_record"], F.lit(False)) != (turns % 2 == 1)).drop("turned", "last")


def _spanning_records(ranges: DataFrame) -> DataFrame:
    """(file, place, record) of the records that begin in one range and end in a later one, or never."""
    opened = F.when(F.col("inside"), F.col("open_1")).otherwise(F.col("open_0"))
    starts = F.when(F.col("inside"), F.col("starts_1")).otherwise(F.col("starts_0"))
    begun = ranges.select("file", "block", "inside", "first", opened.alias("opened"), starts.alias("starts"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col("opened").isNotNull(), F.col("block") + F.col("starts") - 1)
    begun = begun.withColumn("place", place)
    pieces = begun.where("opened IS NOT NULL").select("file", "place", "block", F.col("opened").alias("piece"))
    rest = begun.withColumn("place", F.last("place", ignorenulls=True).over(before)).where("inside")
    pieces = pieces.union(rest.select("file", "place", "block", F.col("first").alias("piece")))
    ordered = F.array_sort(F.collect_list(F.struct("block", F.col("piece").cast("string").alias("piece"))))
    joined = F.array_join(F.transform(ordered, lambda p: p["piece"]), "\n")
    return pieces.groupBy("file", "place").agg(joined.cast("binary").alias("record"))


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the header as strings, and `row_order` (file, place in it), as Spark's `multiLine` reader gives them.

    Files have a header each, the same one; lines end in \\n or \\r\\n. Empty lines between records are skipped. A value
    whose quotes are never closed goes on to the end of its file. `place` rises with the records of a file
    and is no count. The ranges are Spark's splits; one row of 100 bytes or so for each range that begins
    inside quotes is broadcast, and a window of a file holds its ranges.
    """
    names = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').columns
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )
    ranges = resolved(stored(lines.mapInArrow(_survey, RANGES), "csv-ranges"))
    inside = F.broadcast(ranges.where("inside").select("file", "block", "inside"))
    placed = lines.join(inside, ["file", "block"], "left").select("file", "block", "line", F.coalesce("inside", F.lit(False)).alias("inside"))
    whole = placed.mapInArrow(_records, "file string, place long, record binary")
    return _parsed(whole.union(_spanning_records(ranges)), names)


def _parsed(records: DataFrame, names: list[str]) -> DataFrame:
    text = F.regexp_replace(F.col("record").cast("string"), "\\r$", "")
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    rows = records.where("place > 0").select("file", "place", text.alias("text"))  # the record at 0 is the header
    parsed: Column = F.from_csv("text", F.lit(schema), OPTIONS)
    order = F.struct("file", "place").alias("row_order")
    return rows.select(parsed.alias("row"), order).select(*[F.col(f"row.`{n}`").alias(n) for n in names], "row_order")
