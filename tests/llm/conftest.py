import pytest


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture
def odd(spark):
    """Nulls, empty texts, copies, ties, a column whose name clashes."""
    long = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim " * 40
    rows = [(1, None, "en", "a", 0, 1), (2, "", "en", "a", 0, 2), (3, long, None, "a", 9, 3), (4, long, "fr", None, None, 4), (5, " \n\t", None, None, 3, None), (6, "x", "en", "b", 1, 6), (6, "x", "en", "b", 1, 6), (None, "null id", None, None, 7, 7), (7, "Éé \U0001f600 ...", "fr", "b", 8, 8), (8, "a" * 30000, "en", "b", 30000, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
