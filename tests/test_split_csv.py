"""The ranged CSV reader against Spark's whole-file reader, on files cut anywhere."""

import random

import pytest

from cohortspark.session import stored
from cohortspark.sources import split_csv
from cohortspark.sources.split_csv import ends_in_quotes, read_split_csv

SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def cut(spark):
    """Sets the size of a range in bytes."""
    before = [spark.conf.get(name) for name in SPLITS]

    def set_size(size):
        spark.conf.set(SPLITS[0], str(size))
        spark.conf.set(SPLITS[1], "1")

    yield set_size
    for name, value in zip(SPLITS, before):
        spark.conf.set(name, value)


def whole_file(spark, path):
    return spark.read.csv(str(path), header=True, multiLine=True, quote='"', escape='"')


def values(df, columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def write(path, records, end="\n", last=True):
    text = end.join(records)
    path.write_bytes((text + (end if last else "")).encode())


WORDS = ["a", "b c", "é\U0001d400", "12", "", '""', '"quoted, with comma"', '"two\nlines"', '"three\n\n""quoted""\nlines"', '"\n"', '""""', '"a""\n""b"', 'in"side', 'x"y"z', '"ends ""', '"\r\n"', "tab\t", " "]
WORDS.remove('"ends ""')


@pytest.mark.parametrize("seed", range(3))
def test_any_cut_gives_the_rows_of_the_whole_file_reader(spark, cut, tmp_path, seed):
    rng = random.Random(seed)
    records = ["id,text,more"] + [f"{i},{rng.choice(WORDS)},{rng.choice(WORDS)}" for i in range(60)]
    write(tmp_path / "reports.csv", records, last=seed % 2 == 0)
    expected = values(whole_file(spark, tmp_path / "reports.csv"), ["id", "text", "more"])
    assert len(expected) == 60
    for size in (40 + seed, 1 << 20):
        cut(size)
        read = read_split_csv(spark, str(tmp_path / "reports.csv"))
        assert values(read.orderBy("row_order"), ["id", "text", "more"]) == expected
        if size < 100:
            assert spark.read.text(str(tmp_path / "reports.csv"), lineSep="\n").rdd.getNumPartitions() > 8


def test_records_that_span_many_ranges_and_never_end(spark, cut, tmp_path):
    cut(100)
    long = "\n".join(f"line {i} of a long value, with commas" for i in range(40))
    write(tmp_path / "a.csv", ["id,text", f'1,"{long}"', "2,short", f'3,"{long}""', "4,inside the open value"])
    found = values(read_split_csv(spark, str(tmp_path / "a.csv")).orderBy("row_order"), ["id", "text"])
    assert found[:2] == [("1", long), ("2", "short")] and [f[0] for f in found] == ["1", "2", "3"]
    assert found[2][1].startswith(long) and found[2][1].rstrip("\n").endswith("4,inside the open value")


def test_several_files_with_headers_blank_lines_and_carriage_returns(spark, cut, tmp_path):
    write(tmp_path / "a.csv", ["id,text", "1,x", "", '2,"y\r\nz"', ""], end="\r\n")
    write(tmp_path / "b.csv", ['id,text', '3,"p', 'q"', "4,", "5"])
    write(tmp_path / "c.csv", ["id,text"])
    (tmp_path / "d.csv").write_bytes(b"")
    for size in (9, 1 << 20):
        cut(size)
        found = read_split_csv(spark, str(tmp_path)).orderBy("row_order")
        assert values(found, ["id", "text"]) == [("1", "x"), ("2", "y\r\nz"), ("3", "p\nq"), ("4", None), ("5", None)]
        assert [r.row_order.file.rsplit("/", 1)[1] for r in found.collect()] == ["a.csv", "a.csv", "b.csv", "b.csv", "b.csv"]


def test_state_behind_a_line():
    cases = [
        (b"a,b", False, False), (b"a,b", True, True), (b'a,"b', False, True), (b'a,"b', True, False), (b'"a""', False, True),
        (b'"a"""', False, False), (b'x"y,z', False, False), (b'x"y,"z', False, True), (b'" ,"a', True, True), (b'""', False, False),
        (b'"a"b"c,"d', False, True), (b"", True, True), (b'"', False, True), (b'"', True, False),
    ]
    assert [(line, inside, ends_in_quotes(line, inside)) for line, inside, _ in cases] == cases


@pytest.mark.parametrize("seed", range(3))
def test_ranges_are_resolved_as_their_functions_compose(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for file in ("a", "b"):
        state = False
        for block in range(0, 400, 10):
            from_record, from_quotes = rng.choice([(False, True), (True, False), (False, False), (True, True)])
            rows.append((file, block, from_record, from_quotes, b"", None, None, 0, 0))
            expected[file, block] = state
            state = from_quotes if state else from_record
    rng.shuffle(rows)
    found = split_csv.resolved(spark.createDataFrame(rows, split_csv.RANGES)).collect()
    assert {(r.file, r.block): r.inside for r in found} == expected


def test_one_large_file_is_read_by_more_tasks_than_cores(spark, cut, tmp_path):
    cut(256 << 10)
    text = "a line of a report, with a comma\n" * 20
    write(tmp_path / "large.csv", ["id,text"] + [f'{i},"{text}{i}"' for i in range(6000)])
    read = read_split_csv(spark, str(tmp_path / "large.csv"))
    assert read.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert {(r.id, r.text) for r in stored(read.select("id", "text"), "large").collect()} == {(str(i), f"{text}{i}") for i in range(6000)}
