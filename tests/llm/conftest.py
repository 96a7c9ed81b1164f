import pytest

LONG = "the long text goes on and on over many words " * 6000

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, row int, label string, target double"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns named like results."""
    rows = [
        (1, "One small text of a few words.", "en", "a", 1, True, 1, "x", 1.0),
        (2, "one small text of a few words.", "en", "a", 1, True, 1, "x", 1.0),
        (3, None, None, None, None, None, None, None, None),
        (None, "A row without an id, but with words in it.", "en", "b", 1, True, 1, "x", 1.0),
        (None, None, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, False, 2, "y", 2.0),
        (5, " \n\t ", "en", None, 0, False, 2, "y", 2.0),
        (6, LONG, "en", "c", 1, True, 1, "x", 1.0),
        (7, LONG, "en", "c", 1, True, 1, "x", 1.0),
        (8, "Größe, Straße und Übermut: ein Text über Äpfel.\nEin Text über Äpfel.", "de", "d", 1, True, 1, "x", 1.0),
        (8, "Größe, Straße und Übermut: ein Text über Äpfel.\nEin Text über Äpfel.", "de", "d", 1, True, 1, "x", 1.0),
        (9, "12345 67890 !!", "de", "d", 1, True, 1, "x", 1.0),
        (10, "word " * 300, "en", "a", 1, True, 1, "x", 1.0),
    ]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
