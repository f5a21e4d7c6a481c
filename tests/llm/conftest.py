import pytest
from pyspark.sql import types as T

ODD_TEXTS = [None, "", " \t\n", "a", "one two", "One  two", "x" * 70_000, "word " * 9_000, "é ü 中文 \U0001f600 text", "one two"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("kept", T.StringType()),
            T.StructField("piece", T.StringType()),
            T.StructField("fp", T.LongType()),
            T.StructField("score", T.StringType()),
            T.StructField("n", T.LongType()),
        ]
    )
    rows = [(k, text, "en" if k % 2 else None, "x", None, k, None, 1) for k, text in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[4], (None, "one two", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
