import pytest

NULLS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "de", "b", 4), (5, "The  quick brown\tfox jumps over the lazy dog", "en", "a", 44),
    (5, "The  quick brown\tfox jumps over the lazy dog", "en", "a", 44), (None, "no id here at all", "en", "z", 17), (7, "word " * 30000, "en", "a", 150000), (8, "é" * 5000, "fr", "a", 5000), (9, "x", "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    rows = spark.createDataFrame(NULLS, SCHEMA)
    return rows.selectExpr("*", "1 as size", "'x' as key", "2L as n", "doc_id as component", "'y' as digest", "0 as shard", "3 as kept")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
