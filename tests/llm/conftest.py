import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, size long, fp long, _row long, _doc string"


def rows(*texts, source="s", lang="en"):
    """Rows with columns whose names clash with the operators' own."""
    return [(i, t, lang, source, None if t is None else len(t), 0.5, 7, -1, 3, 9, "x") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words(seed, n, vocab=2000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


#: What every operator must take: nulls in any column, empty, blank, long, tied and repeated rows.
ODD = [
    (None, "no id at all here", "en", "a", 1, None, None, None, None, None, None),
    (1, None, None, None, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 0.0, 0, 0, 0, 0, ""),
    (3, " \n\t ", "en", "a", 4, 0.0, 0, 0, 0, 0, ""),
    (4, words(4, 20000), "en", "b", 1, 0.0, 0, 0, 0, 0, ""),
    (5, "héé ñandú \U0001f600 " + words(5, 30), "fr", "b", 1, 0.0, 0, 0, 0, 0, ""),
    (6, "the same text of two rows", "en", "c", 1, 0.0, 0, 0, 0, 0, ""),
    (6, "the same text of two rows", "en", "c", 1, 0.0, 0, 0, 0, 0, ""),
    (7, "the same text of two rows", "en", "c", 1, 0.0, 0, 0, 0, 0, ""),
    (8, "x" * 50_000, "en", "c", 1, 0.0, 0, 0, 0, 0, ""),
    (9, "é" * 3 + "\x85 b", "en", "", 1, 0.0, 0, 0, 0, 0, ""),
]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
