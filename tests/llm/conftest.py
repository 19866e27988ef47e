import pytest

LONG = "The river of the valley and the hills is long. " * 4000
PLAIN = "The old house is on the hill and the road to it is long, so that nobody was there for the whole of the winter."
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, quality int, p_ double, row string, "
          "digest long, fp long, owner string, word string, topic string, `Text_` string")


def make(spark, rows):
    """Documents out of (doc_id, text, lang, source), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, s, None, None, 3, 0.5, "r", 7, 8, "o", "w", "t", "x") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    return make(spark, [(1, PLAIN, "en", "a"), (1, PLAIN, "en", "a"), (2, PLAIN, "en", None), (3, None, "en", "a"), (4, "", None, "a"),
                        (5, " \t\n", None, None), (6, LONG, "en", "b"), (None, PLAIN, "en", "b"), (None, None, None, None), (7, "é", "fr", "b")])


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
