import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sender string, row string, keep string, shard string, slot string, node string, words string, pos string, key string, kept string, text_sha256 string"


def frame(spark, rows):
    """Documents from (doc_id, text), with columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, None, "src" if i else None, None, *(["x"] * 11)) for i, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "same text here for all of us today"), (4, "same text here for all of us today"), (5, "same  text\nhere for all of us today"), (None, "alone but for its missing id"), (None, None), (6, "one"), (7, "two words"), (8, "é" * 50 + " ünï ßtraße " + "中文 " * 20), (9, "word " * 40000)]


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, []).limit(0)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)
