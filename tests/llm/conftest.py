import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 97}x{i}" for i in range(30_000))
    rows = [(1, "a b c d e f g", "x", 1), (1, "a b c d e f g", "x", 1), (2, None, None, None), (3, "", "x", 3), (4, long, "y", 4), (5, long, "y", 5), (6, "   ", "z", 6), (7, "one", "z", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int").withColumnsRenamed({"size": "size"})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
