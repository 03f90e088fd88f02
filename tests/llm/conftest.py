import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "One two three four five six.", "en", "a", 28),
    (4, "one TWO three four five six.", None, None, 28),
    (4, "one TWO three four five six.", None, None, 28),
    (5, "ÉTÉ été \U0001d400 ß", "fr", "", 9),
    (None, "one two three four five six.", "en", "b", 28),
    (None, "words without an id", "en", "b", 19),
    (6, "word " * 60_000, "en", "a", 300_000),
    (7, " \n\t ", "en", "a", 4),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(AWKWARD, DOCUMENTS)
    clashing = "id n size h hash key comp component rep copies norm keep_id label row batch block kind order pattern host digest".split()
    return docs.select("*", *[F.lit(f"other {c}").alias(c) for c in clashing])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
