import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n long, key string, size long, kept string, component_id string, v string, ids string, u string"


def words(rng, n, vocabulary=2000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def make(spark):
    """documents of (doc_id, text) or (doc_id, text, lang, source), with extra columns whose names clash with inner ones."""

    def build(rows):
        full = [(*r, *("en", "s")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 1, 2, "k", 3, "x", "y", "z", "i", "q") for i, t, g, s in full], SCHEMA)

    return build


@pytest.fixture(scope="session")
def edge(make):
    """Nulls in any column, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = " ".join(words(rng, 60_000, 50_000))
    same = " ".join(words(rng, 120))
    rows = [(1, None), (2, ""), (3, " \n\t \x0b\n"), (4, "one two"), (5, long), (6, same), (7, same), (7, same), (None, same), (8, same, None, None), (9, "é" * 50_000), (10, "ü 😀 \x00 ſ\n" * 40, "xx", None), (11, "a@" * 2000), (12, "1" * 5000)]
    return make(rows)
