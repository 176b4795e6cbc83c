import pytest

ODD_TEXTS = [
    None, "", " \n\t ", "a", "same text here", "same text here", "ünï çødé 🙂 字 the and of", "x" * 30_000, "word " * 20_000,
    "9" * 20_000, "\x00\x1c\x1f odd controls", "UPPER lower 123 !!! ###"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeats, and extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src", i, "c", 1, 2.0) for i, t in enumerate(ODD_TEXTS)]
    rows += [(4, "same text here", "en", "src", 4, "c", 1, 2.0), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, id int, score double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
