import pytest

LONG = "word " * 40_000
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t\n ", "en"),
    (5, LONG, "en"),
    (6, "Alpha beta gamma delta epsilon zeta eta theta", "en"),
    (6, "Alpha beta gamma delta epsilon zeta eta theta", "en"),
    (None, "Alpha beta gamma delta epsilon zeta eta theta", "en"),
    (8, "é日本 x\u0000y 😀\nnext line", "fr"),
]
SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture
def odd(spark):
    """Null, empty, very long, repeated and foreign texts, and a null key."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def frame(spark):
    def make(texts, first=0):
        return spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], "doc_id bigint, text string")

    return make
