"""A stored table that follows its input files: only files that have changed are built again.

Beside the rows lies a manifest: path, length and time of every input file, a key of the code version
and the parameters the rows were built with, and their schema. A file whose entry differs in any of them is
built anew, the rows of a file that is gone are deleted, all other rows stay as they are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortspark.sources.checkpoints import is_complete

#: The column that ties an output row to its input file; `build` must hand it on.
SOURCE = "source"
_ENTRY = "source string, path string, length bigint, modified timestamp, build string, schema string"


@dataclass(frozen=True)
class Refreshed:
    """The table, and how many input files were built, left as they were, and are gone; which, by their paths."""

    table: DataFrame
    rebuilt: int
    kept: int
    removed: int
    rebuilt_paths: tuple[str, ...] = ()
    kept_paths: tuple[str, ...] = ()
    removed_paths: tuple[str, ...] = ()


def input_files(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Path, length and time of the files below `folder`; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.md5("_metadata.file_path").alias(SOURCE), "path", "length", F.col("modificationTime").alias("modified"))


def build_key(version: str, parameters: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps([version, parameters], sort_keys=True, default=str).encode()).hexdigest()


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def refresh(
    spark: SparkSession,
    folder: str,
    path: str,
    build: Callable[[DataFrame], DataFrame],
    version: str,
    parameters: Mapping[str, object] | None = None,
) -> Refreshed:
    """Bring the table at `path` up to date with the Parquet files below `folder`.

    `build` works row by row or within a file, and keeps the column `source`. The manifest names
    only rows that are complete: before anything is deleted or written it is reduced to
    what stays, and completed at the end, so a run that dies half-way is made good by the next one.
    The driver sees the names of the files, as Spark's reader does, and no rows. A null, empty or repeated row
    is a row like any other; a folder that has lost all its files gives
    no rows, one that never had any is an error.
    """
    data, manifest = f"{path.rstrip('/')}/data", f"{path.rstrip('/')}/manifest"
    now = input_files(spark, folder).withColumn("build", F.lit(build_key(version, parameters or {})))
    known = is_complete(spark, manifest)
    if not known:
        _delete(spark, data)
    before = spark.read.schema(_ENTRY).parquet(manifest) if known else spark.createDataFrame([], _ENTRY)
    current, old = now.collect(), before.collect()  # names and times of files
    same = {tuple(r)[:-1] for r in old} & {tuple(r) for r in current}
    changed = [r for r in current if tuple(r) not in same]
    entries = sorted(tuple(r) for r in old if tuple(r)[:-1] in same)
    outdated = [r for r in old if tuple(r)[:-1] not in same]
    if outdated or (changed and known):
        spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("overwrite").parquet(manifest)
    for source in {r.source for r in outdated} | {r.source for r in changed}:
        _delete(spark, f"{data}/{SOURCE}={source}")
    if changed:
        rows = spark.read.parquet(*[r.path for r in changed]).withColumn(SOURCE, F.md5("_metadata.file_path"))
        built = build(rows)
        built.write.partitionBy(SOURCE).mode("append").parquet(data)
        entries += [(*r, built.schema.json()) for r in changed]
    if changed or outdated:
        spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("overwrite").parquet(manifest)
    here = {r.source for r in current}
    gone = {r.source: r.path for r in old if r.source not in here}
    if not entries and not old:
        raise ValueError(f"no files below {folder}, and nothing stored at {path}")
    schema = StructType.fromJson(json.loads((entries or [tuple(r) for r in old])[-1][-1]))
    table = spark.read.schema(schema).parquet(data).drop(SOURCE)
    paths = [tuple(r.path for r in changed), tuple(r[1] for r in same), tuple(gone.values())]
    return Refreshed(table, len(changed), len(same), len(gone), *paths)
