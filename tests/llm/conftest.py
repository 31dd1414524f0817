"""Small tables with every odd case, and columns whose names clash with the operators' own."""

import pytest

CLASH = "rep long, n long, epoch long, k1 string, label int, score string, block_rank long, __block long, __lang string, `a.b` long, key string, c0 long, block long, s string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "   \n\t ", "en", "a"),
        (4, word, "en", "a"),
        (5, word.upper(), "en", "b"),
        (6, word, "en", "b"),
        (6, word, "en", "b"),
        (7, long_text, "fr", "c"),
        (8, long_text + " tail", None, "c"),
        (9, "ÉTÉ été É", "fr", None),
        (10, "é" * 5000, "fr", ""),
        (11, "one\ntwo lines here\nthree", "en", "a"),
        (12, "12345 !!! ---", None, "a"),
        (13, "\U0001f600 \u0000 \x1f end", "en", "d"),
    ]
    rows = [(*r, 0, 1, 2, "k", 3, "s", 4, 5, "l", 6, "key", 7, 8, "s") for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
