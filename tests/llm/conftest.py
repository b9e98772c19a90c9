"""Small documents with every odd case, shared by the operator tests."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("size", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("rank", T.LongType()),
    T.StructField("content", T.StringType()), T.StructField("host", T.StringType()), T.StructField("node", T.LongType()),
])
LONG = " ".join(f"word{k % 977}" for k in range(30_000))


def odd_rows():
    rows = [
        (1, "The same text here, twice over.", "en", "a", 1), (2, "The same text  here,\ttwice over.", "en", "a", 1),
        (3, None, None, None, None), (4, "", "de", "b", 0), (5, " \n\t ", None, "b", 3), (None, "no id at all", "en", "c", 5),
        (6, LONG, "en", "c", 9), (7, LONG, "en", None, 9), (8, "Ünïcode – ß 漢字 🙂 mit license", "de", "a", 2),
        (8, "Ünïcode – ß 漢字 🙂 mit license", "de", "a", 2), (9, "x", "fr", "a", 1), (10, "12 34 !!", "fr", "\U0001f600", 1),
        (-11, "one two three four five six", "en", "b", 1), (12, "one two three four five six", "en", "b", 1),
    ]
    return [(*r, "other", "other", 7, "other", "other", 7) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
