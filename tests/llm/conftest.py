import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    yield s


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    long = "tail of words " * 9000
    rows = [(1, "a b c d e f"), (2, None), (3, ""), (4, "a b c d e f"), (4, "a b c d e f"), (None, "no id at all"), (5, "x"), (6, long), (7, "\n\t  "), (8, "A B C D E f"), (9, "ß É 1.2.3.4 \U0001f600 z"), (None, None)]
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], "doc_id long, text string, a string, label string, n_words int")


@pytest.fixture(scope="session")
def no_docs(spark, hard_docs):
    return hard_docs.where("1 = 0")
