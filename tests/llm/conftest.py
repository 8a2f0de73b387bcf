import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, size int, t string, label int, path string"


@pytest.fixture
def odd_docs(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))
    rows = [(1, "Plain words stand here for a while, and end.", "en", "a"), (1, "Plain words stand here for a while, and end.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "A row without a number, but with words.", "fr", "b"),
            (5, long_text, "en", "a"), (6, "\n\n \n", "de", "b"), (7, "!!! ... ###", None, "c"), (8, "Plain words stand here for a while, and end.", "fr", None), (9, None, None, None), (9, "é ü ñ ß 日本語", "de", "b")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0.5, "x", 3, "y", None, "p") for r in rows], SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
