"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from helpers import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# trained on so few rows that some results are empty or take long without saying more
ROWS_ONLY = sorted(set(driver.queries()) - set(driver.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = driver.queries()[name](spark, SMALL)
    cursor = duck.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", ["train_logistic", "per_cohort_models", "score_reports"])
def test_runs(spark, name):
    assert driver.queries()[name](spark, SMALL).count() > 0


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 4
