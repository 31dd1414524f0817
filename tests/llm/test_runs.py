"""Runs of words against every stretch tried."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecspan.llm import registry, runs


def brute(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        x = 0
        while x + q < n:
            if words[x] != words[x + q]:
                x += 1
                continue
            s = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            if x + q - s >= max(least, 2 * q):
                found.setdefault((s, x + q - s), q)
    out = sorted((s, length, q) for (s, length), q in found.items())
    gone = {i for s, length, q in out for i in range(s + q, s + length)}
    return out, [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.sampled_from([2, 5, 12]), st.sampled_from([3, 1 << 19]))
def test_small_alphabets(texts, least, places):
    before, runs.MOST_PLACES = runs.MOST_PLACES, places
    try:
        found = runs.find_runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts], np.int64), least)
    finally:
        runs.MOST_PLACES = before
    assert [tuple(r) for r in found.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in brute(t, least)[0]]


def test_long_repeats():
    rng = random.Random(1)
    for words in ([7] * 5000, [1, 2, 3] * 1500 + [1, 2], [rng.randrange(50) for _ in range(900)] * 4, [rng.randrange(3) for _ in range(1500)]):
        found = runs.find_runs(np.array(words), np.array([len(words)]))
        assert [tuple(r[1:]) for r in found.tolist()] == brute(words)[0]


def test_odd_texts(spark, odd_docs, no_docs):
    more = [(20, "a b\x0bc\x0cd\r\n" * 5, "en"), (None, " x" * 13, None), (None, " y " * 12, None), (21, "  z " * 12, "en"), (22, "w " * 11, "en")]
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()), key=str)
    want = []
    for r in docs.select("doc_id", "text").collect():
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in r.text or "").split(" ") if w]
        found, kept = brute(words) if len(words) < 3000 else (None, None)
        want.append((r.doc_id, len(words), found, None if kept is None else " ".join(kept)))
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:2] == w[:2] and (w[2] is None or g[2:] == w[2:])
    assert runs.periodic_runs(no_docs).collect() == []


def test_planted_words(spark, monkeypatch):
    """The query's texts, word by word, and its columns."""
    rng = random.Random(2)
    rows = [(i, None if i % 37 == 0 else " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(90)))) for i in range(-50, 400)]
    docs = spark.createDataFrame([*rows, (None, "a b")], "doc_id long, text string")
    monkeypatch.setattr(registry, "table", lambda *_: docs)
    got = {r.doc_id: r for r in registry.op13_runs(spark, "").collect()}
    for i, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len((text or "").split())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        found, kept = brute(words)
        top = max(((length, -s, -q) for s, length, q in found), default=None)
        want = (len(found), *((-top[1], top[0], -top[2], 1000 * top[0] // -top[2]) if top else (None,) * 4))
        assert tuple(got[i])[1:6] == want
        assert got[i].collapsed_sha256 == __import__("hashlib").sha256(" ".join(kept).encode()).hexdigest()
    assert got[None].n_runs == 0


@pytest.mark.parametrize("n", [200_000])
def test_a_long_text(n):
    """A cycle of words in a long text is one run."""
    words = np.concatenate([np.arange(n // 2), np.arange(n // 2) % 1000 + n])
    assert runs.find_runs(words, np.array([n])).tolist() == [[0, n // 2, n // 2, 1000]]
