"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    *(T.StructField(n, T.StringType()) for n in ("doc", "text_key", "body", "fp", "rep", "lines_total", "removed", "quality_score", "fingerprint", "license", "host", "verdict", "kept", "uid", "part", "cuts")),
])


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


ROWS = [
    (None, "text without an id that is long enough", None, None, None),
    (1, None, "en", None, 0),
    (2, "", None, "src0", 0),
    (3, "   \n\t\n  ", "en", "src0", None),
    (4, words(120), "en", "src0", None),
    (5, words(120), "en", "src0", None),
    (5, words(120), "en", "src0", None),
    (6, "Über " + words(60, 30) + " ende 😀", "de", "src0", None),
    (7, words(40_000, 1000), "en", "src0", None),
    (8, "a line that is long enough to count\nanother line that is also long\na line that is long enough to count", "en", "src0", None),
    (9, "a line that is long enough to c0unt\nsomething else that nobody wrote", "en", "src0", None),
    (10, "one two", "en", "src0", None),
    (11, "ONE two", "en", "src0", None),
]


@pytest.fixture(scope="session")
def tricky(spark):
    extra = len(SCHEMA) - 5
    return spark.createDataFrame([(*r, *["x"] * extra) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
