import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, row long"


@pytest.fixture()
def edge(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = "wörd Alpha beta. " * 4000
    rows = [
        (1, "Hello World foo bar baz", "en", "b", 23, "x", 1),
        (2, "hello world FOO bar baz", "en", "b", 23, "x", 1),
        (2, "hello world FOO bar baz", "en", "b", 23, "x", 1),
        (3, None, None, None, None, None, None),
        (4, "", "en", "a", 0, "x", None),
        (None, "orphan text here", "en", None, 16, None, 2),
        (5, " \t\n ", "de", "a", 4, None, 2),
        (6, long, "de", "c", len(long), None, 3),
        (7, "É é <|endoftext|> ﷽ 漢字\x1c\x85 x", "fr", "c", 20, None, 3),
        (8, "one", "fr", "é", 3, None, 3),
        (9, long.replace("beta", "gamma", 1), "de", "c", len(long) + 1, None, 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
