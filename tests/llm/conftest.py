import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint"


@pytest.fixture
def odd_docs(spark, docs_schema):
    """Nulls in every column, empty and very long texts, repeated rows, ties, a clashing extra column ``n``."""
    words = "the quick brown fox jumps over the lazy dog while it rains in the old town of stone and glass".split()
    long = " ".join(words[(i * 7 + i // 19) % len(words)] + str(i % 97) for i in range(30_000))
    rows = [
        (1, "The Quick brown\tfox; jumps <|endoftext|> over it's café 你好", "en", "a", 1, 9),
        (2, None, "en", "a", None, 9),
        (3, "", None, None, 0, None),
        (None, "a text without id, and nothing more than that", "en", None, 3, 1),
        (5, long, "en", "b", 4, 1),
        (6, long + " and one more end", "en", "b", 4, 1),
        (7, " \n\t ", "de", "c", 4, 1),
        (8, "der die das und nicht ein haus " * 30, "de", "c", 4, 1),
        (8, "der die das und nicht ein haus " * 30, "de", "c", 4, 1),
        (9, "der die das und nicht ein haus " * 30, None, "d", 4, 1),
        (-10, "Été İstanbul ΣΣ é́ nbsp here \x1c sep", "fr", "d", 4, 1),
        (2**40, "12345 67 8", "fr", "d", 4, 1),
    ]
    return spark.createDataFrame(rows, docs_schema)


@pytest.fixture
def no_docs(spark, docs_schema):
    return spark.createDataFrame([], docs_schema)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
