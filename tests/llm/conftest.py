import pytest

from chronoframe.llm.common import read

SF = "/root/testdata/sf0.001"
LONG = "Wort der Länge " * 3000
#: Nulls, empty and blank texts, a very long text, ties, repeated rows, and columns named as internals.
ROWS = [
    (1, None, "en", 10), (2, "", "en", 11), (3, " \t\n ", None, 12), (4, "one", "en", 13), (5, LONG, "de", 14),
    (6, "the quick brown fox jumps over the lazy dog and runs far away", "en", 15),
    (7, "the quick brown fox jumps over the lazy dog and runs far away", "en", 16),
    (7, "the quick brown fox jumps over the lazy dog and runs far away", "en", 16),
    (8, "THE quick brown fox jumps over the lazy dog and runs far away now", "en", 17),
    (None, "the quick brown fox jumps over the lazy dog and runs far away", "en", 18),
    (9, "été ñandú 日本語 русский текст 123", None, None), (10, "12 34 !!", "en", 19),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns that clash with names the operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(
        ("id", "row", "shard", "slot", "rep", "node", "component", "spans", "source"))])


@pytest.fixture(scope="session")
def docs(spark):
    return read(spark, SF, "documents")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
