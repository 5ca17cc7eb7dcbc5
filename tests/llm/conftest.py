import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """Rows as DataFrame of documents with columns whose names clash with the operators' own."""

    def make(rows):
        schema = "doc_id long, text string, score string, spans string, class string, label string, key string, part string, length string, base string"
        return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], schema)

    return make


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (None, "a row without an id"),
    (4, "the same row"),
    (4, "the same row"),
    (5, "É漢字🙂 don't  stop…\r\n"),
    (6, "word " * 30000),
    (7, "x" * 120000),
    (8, "1" * 40000),
]


@pytest.fixture(scope="session")
def awkward():
    return list(AWKWARD)
