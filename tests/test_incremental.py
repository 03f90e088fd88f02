"""Tables that follow their input files."""

import os

import pytest
from pyspark.sql import functions as F

from cohortspark.catalog import sources
from cohortspark.sources.incremental import refresh
from helpers import SMALL


def write(spark, folder, part, ids):
    spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i}") for i in ids], "id int, t string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{part}")


def result(run):
    return sorted(r.id for r in run.table.collect()), (run.rebuilt, run.kept, run.removed)


def test_only_changed_files_are_built(spark, tmp_path):
    folder, path, built = str(tmp_path / "in"), str(tmp_path / "out"), []

    def build(df):
        built.append(len(df.inputFiles()))
        return df.where("id % 2 = 0").withColumn("n", F.length("t"))

    for part in range(3):
        write(spark, folder, f"p{part}", range(10 * part, 10 * part + 10))
    even = list(range(0, 30, 2))
    assert result(refresh(spark, folder, path, build, "1")) == (even, (3, 0, 0))
    assert result(refresh(spark, folder, path, build, "1")) == (even, (0, 3, 0)) and built == [3]
    write(spark, folder, "p1", [100, 101])  # a new file in place of an old one
    assert result(refresh(spark, folder, path, build, "1")) == ([*range(0, 10, 2), *range(20, 30, 2), 100], (1, 2, 1))
    name = next(f for f in os.listdir(f"{folder}/p0") if f.endswith(".parquet"))
    os.utime(f"{folder}/p0/{name}", (1, 1))  # the same name, another time
    assert result(refresh(spark, folder, path, build, "1"))[1] == (1, 2, 0)
    write(spark, folder, "p1", [101])  # nothing of it passes: its old rows go
    assert result(refresh(spark, folder, path, build, "1"))[0] == [*range(0, 10, 2), *range(20, 30, 2)]
    assert result(refresh(spark, folder, path, build, "2"))[1] == (3, 0, 0)
    assert result(refresh(spark, folder, path, build, "2", {"width": 3}))[1] == (3, 0, 0)
    assert built == [3, 1, 1, 1, 3, 3]


def test_a_run_that_died_is_made_good(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, folder, "p0", range(5))
    write(spark, folder, "p1", range(5, 9))
    refresh(spark, folder, path, lambda df: df, "1")
    write(spark, folder, "p1", range(50, 53))

    def die(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        refresh(spark, folder, path, die, "1")
    assert result(refresh(spark, folder, path, lambda df: df, "1")) == ([0, 1, 2, 3, 4, 50, 51, 52], (1, 1, 0))
    os.remove(f"{path}/manifest/_SUCCESS")
    assert result(refresh(spark, folder, path, lambda df: df, "1"))[1] == (2, 0, 0)


def test_nothing_passes_and_nothing_is_there(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, folder, "p0", range(3))
    none = lambda df: df.where("id < 0")
    assert result(refresh(spark, folder, path, none, "1")) == ([], (1, 0, 0))
    again = refresh(spark, folder, path, none, "1")
    assert result(again) == ([], (0, 1, 0)) and again.table.columns == ["id", "t"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no files"):
        refresh(spark, str(tmp_path / "empty"), str(tmp_path / "other"), none, "1")


def test_parts_of_the_query_are_written_by_many_tasks(spark, monkeypatch):
    files = []

    def watched(spark, folder, *rest):
        run = refresh(spark, folder, *rest)
        files.append([len([p for p in run.rebuilt_paths + run.kept_paths if f"/part{i}/" in p]) for i in range(4)])
        return run

    monkeypatch.setattr(sources, "refresh", watched)
    got = [tuple(r)[:4] for r in sources.refresh_changed(spark, SMALL).collect()]
    assert got == [("built", 4, 0, 0), ("unchanged", 0, 4, 0), ("file replaced", 1, 3, 1), ("parameter changed", 4, 0, 0)]
    assert min(files[0]) > 1 and files[0] == files[1]
    assert files[2] == files[3] == [files[0][0], 1, *files[0][2:]]
