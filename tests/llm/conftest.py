import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, own string, score double, _row string, key string, fp string, spans string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, ties and repeated rows; extra columns whose names the operators use inside."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(30000))
    texts = [
        (None, None, None, None), (1, "", "en", "a"), (2, " \n\t \n", "en", "a"), (3, long, "de", None), (4, "One line of text that is kept.\nAnother line here.", "en", "b"),
        (4, "One line of text that is kept.\nAnother line here.", "en", "b"), (5, None, "fr", "b"), (None, "No id, but some words.", None, "c"), (6, "\U0001d4db𝓁 mixed \U0001f600 text", "en", "c"),
        (7, "x" * 200000, None, "a"), (8, "One line of text that is kept.\nAnother line here.", "en", "b"), (9, "12345 67890", "en", "a"),
    ]
    rows = [(i, t, lang, s, None, 1, "o", 0.5, "r", "k", "f", "s") for i, t, lang, s in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
