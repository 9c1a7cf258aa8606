import pytest


@pytest.fixture
def docs(spark):
    """Documents with every awkward case: nulls, empty, repeated rows, and columns that clash with the operators' own."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en"), (2, "alpha beta gamma delta epsilon zeta", None), (3, None, "en"), (4, "", "de"), (5, "  \n\t ", "fr"),
        (6, "word " * 30_000, "en"), (7, "Straße ñandú 日本語 \x1c odd space", "de"), (8, "alpha beta gamma delta epsilon zeta", "en"), (9, "x", "en"),
    ]
    return spark.createDataFrame([(d, t, k, "s", 1, "clash", "clash", 0.5) for d, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, score double")


@pytest.fixture
def empty(docs):
    return docs.filter("false")
