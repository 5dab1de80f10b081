import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, component_id string, count long, keep string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank and very long texts, repeated rows, columns with clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog again and again", None, "a"),
        (2, "the quick brown fox jumps over the lazy dog again and again", None, "a"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \n\t ", "en", "b"),
        (6, "word " * 60_000, "en", "b"),
        (None, "no id here", None, None),
        (7, "Ünïcode 日本語 \U0001f600 text, with é and é", "x", "b"),
        (-8, "<|endoftext|> ### Assistant: </turn> a@b.example +1 (555) 010-0199", "x", "b"),
        (9, "x" * 50_000, "x", "c"),
    ]
    return spark.createDataFrame([(*r, None, "f", "c", 1, "k") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
