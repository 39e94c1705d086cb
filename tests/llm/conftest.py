import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with outputs."""

    def build(rows):
        names = "score string, predicted string, n_removed string, hits string, block string"
        rows = [(i, t, *["x"] * 5) for i, t in rows]
        return spark.createDataFrame(rows, f"doc_id bigint, text string, {names}")

    return build


WORDS = " ".join(f"word{i}" for i in range(400))


@pytest.fixture(scope="session")
def edges():
    """Nulls, empty and blank texts, ties, repeated rows, a long text and odd bytes."""
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one two"),
        (5, "One TWO"),
        (6, WORDS),
        (7, WORDS),
        (7, WORDS),
        (8, WORDS + " end"),
        (9, "x\x00y " + "é漢😀 " * 40),
        (10, "a" * 5000),
        (11, "ab " * 40_000),
        (None, WORDS),
        (None, None),
    ]
