import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 9973}" for i in range(60_000))
    prose = "the quick brown fox jumps over the lazy dog near the river bank while seven old men watch it go by slowly today"
    rows = [
        (1, prose, "en", "a", 5), (2, prose, "en", "a", 5), (2, prose, "en", "a", 5), (3, prose.upper(), "en", None, 5),
        (4, None, "en", "b", None), (5, "", None, "b", 0), (6, " \t\n ", "en", "b", 4), (None, prose, None, "c", 5), (None, None, None, None, None),
        (7, long, "en", "c", len(long)), (8, long + " tail", "en", "c", 1), (9, "4711 !!! ---", "en", "a", 12), (10, "été à côté de la forêt où dort le vieux chêne", "fr", "ä", 3),
        (11, "one two", "en", "a", 7), (12, "one two", "en", "a", 7), (13, "x", None, "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "key", "id", "size", "shard", "slot", "src", "_order", "bucket", "rep", "root", "batch", "sha", "rank", "matches", "lettered", "taken", "target"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
