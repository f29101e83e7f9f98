import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000


@pytest.fixture()
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names that operators use inside."""
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, " \n\t", "en", "s", 3), (4, LONG, "en", "s", len(LONG)), (None, "No id here", "de", "s", 10), (5, "Same row twice", "en", "s", 14), (5, "Same row twice", "en", "s", 14), (6, "1234 ?! 99", "en", "s", 10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for extra in ("words", "fp", "ids", "h", "score", "_row", "key", "seed", "at", "a", "b", "node"):
        docs = docs.withColumn(extra, F.lit("clash"))
    return docs


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
