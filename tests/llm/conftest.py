import pytest

from deckloom.llm import store

ODD = "doc_id long, text string, lang string, source string, n_chars long, size int, label string, words array<int>"


@pytest.fixture(scope="session", autouse=True)
def clean_tables(spark):
    yield
    store.clean(spark)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    and extra columns whose names operators use inside."""
    long = "word " * 60_000 + "end"
    rows = [
        (1, "The cat sat on the mat and looked at the dog.", "en", "a", 45, 1, "x", [1]),
        (2, None, "en", "a", None, None, None, None),
        (3, "", None, None, 0, 2, "", []),
        (4, "   \n\t ", "fr", "b", 6, 3, "y", None),
        (5, long, "en", "a", len(long), 4, "z", None),
        (6, "The cat sat on the mat and looked at the dog.", "en", None, None, 5, "x", [1]),
        (6, "The cat sat on the mat and looked at the dog.", "en", None, None, 5, "x", [1]),
        (None, "no id here at all", None, "b", 17, 6, None, [None]),
        (8, "é 日本 \U0001f600 x</s>", "de", "b", 11, 7, "w", None),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], ODD)
