import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def sf():
    return SF


def frame(spark, rows, schema="doc_id long, text string, extra string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def odd_docs(spark):
    """Nulls, empties, a very long text, repeated rows and a column with a clashing name."""
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n\t ", None), (4, "one two three four five six", "x"), (4, "one two three four five six", "x"), (None, "no id here at all", "x"), (5, "word " * 30_000, "x"), (6, "ÀÉ ñ 中文 😀 don't stop", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")
