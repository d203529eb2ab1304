import pytest
from llm.helpers import prose

@pytest.fixture
def docs(spark):
    """(doc_id, text) rows with the given values."""
    return lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, copies under one id and under none."""
    long = prose(1, 6000)
    shared = prose(2, 60)
    return [
        (1, shared + " " + prose(3, 40)),
        (2, prose(4, 30) + "\n" + shared),
        (3, None),
        (4, ""),
        (5, " \t\n"),
        (6, long),
        (7, long),
        (7, long),
        (None, long + " end"),
        (None, shared),
        (None, None),
        (8, "one two"),
        (9, "one two"),
        (10, "a b " * 80),
        (11, "Größe É ñandú 日本語 " * 12),
        (12, "x" * 500 + " " + "x" * 500),
        (12, prose(5, 25)),
        (13, prose(6, 25) + "\x00\x1c\x85   end"),
    ]
