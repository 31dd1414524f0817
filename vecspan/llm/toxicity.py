"""Toxicity scores from a counterfactually regularised linear classifier."""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: Identity terms by kind; a swap puts another term of the same kind in a term's place.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "elderly", "young"),
)

_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 200_000


def features(word: str) -> tuple[str, ...]:
    """A word and the beginnings that inflected forms share."""
    return (word, *(f"{word[:k]}*" for k in (4, 5) if len(word) > k))


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _shared(words: set[str]) -> set[str]:
    """The same words, held once however many texts have them."""
    return set(map(sys.intern, words))


def swaps(words: set[str]) -> Iterator[set[str]]:
    """The text's words with each identity term replaced by the next of its kind."""
    for kind in IDENTITY:
        if present := [w for w in kind if w in words]:
            for w in present:
                yield (words - {w}) | {kind[(kind.index(w) + 1) % len(kind)]}


@dataclass
class ToxicModel:
    weights: dict[str, float]
    bias: float

    def value(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def train(rows: Iterable[tuple[str | None, int]], penalty: float = 4.0, ridge: float = 1e-3, kept: int = 4096, epochs: int = 400) -> ToxicModel:
    """Fit on (text, label) pairs.

    Features are the distinct words of a text and their beginnings. The ``kept`` features whose
    share among toxic texts differs most from that among others (z of at least 4, in 3 texts at
    least), and all identity terms, get weights. The loss is the class-balanced logistic loss,
    plus a ridge, plus ``penalty`` times the mean squared change of the logit when an identity
    term of a text is swapped for another of its kind. Identity terms start alike and the last
    term drives their weights together, so naming a group neither adds nor removes toxicity.
    """
    import numpy as np

    rows = [(_shared(words_of(t)), int(y)) for t, y in rows]
    n, pos = len(rows), sum(y for _, y in rows)
    if not n or not pos or pos == n:
        return ToxicModel({}, -4.0 if not pos else 4.0)
    by: tuple[Counter, Counter] = (Counter(), Counter())
    for words, y in rows:
        by[y].update({f for w in words for f in features(w)})
    neg = n - pos

    def z(f: str) -> float:
        p, q = by[1][f] / pos, by[0][f] / neg
        m = (by[1][f] + by[0][f]) / n
        return (p - q) / (m * (1 - m) * (1 / pos + 1 / neg) + 1e-12) ** 0.5

    scored = sorted(((abs(s), f) for f in by[0].keys() | by[1].keys() if by[0][f] + by[1][f] >= 3 and abs(s := z(f)) >= 4), reverse=True)[:kept]
    terms = [w for kind in IDENTITY for w in kind]
    names = list(dict.fromkeys([f for _, f in scored] + terms))
    at = {f: i for i, f in enumerate(names)}

    def sparse(sets: list[set[str]]):
        r, c = [], []
        for i, words in enumerate(sets):
            for w in words:
                for f in features(w):
                    if f in at:
                        r.append(i)
                        c.append(at[f])
        return np.array(r, np.int64), np.array(c, np.int64)

    xr, xc = sparse([w for w, _ in rows])
    y = np.array([y for _, y in rows], float)
    pairs = [(i, s) for i, (words, _) in enumerate(rows) for s in swaps(words)]
    sr, sc = sparse([s for _, s in pairs])
    orig = np.array([i for i, _ in pairs], np.int64)
    balance = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    w, b = np.zeros(len(names)), 0.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, epochs + 1):
        logit = np.bincount(xr, w[xc], n) + b
        g = balance * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        gw = np.bincount(xc, g[xr], len(w)) + ridge * w
        gb = g.sum()
        if len(pairs):
            change = (np.bincount(sr, w[sc], len(pairs)) + b) - logit[orig]
            d = 2 * penalty * change / len(pairs)
            gw += np.bincount(sc, d[sr], len(w))
            back = np.bincount(orig, d, n)
            gw -= np.bincount(xc, back[xr], len(w))
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        fix = (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        w -= 0.05 * fix * mw / (vw**0.5 + 1e-9)
        b -= 0.05 * fix * mb / (vb**0.5 + 1e-9)
    return ToxicModel({f: float(w[i]) for f, i in at.items() if w[i]}, float(b))


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 8_000, most_bytes: int = 1 << 15) -> ToxicModel:
    """Train on a bounded sample of labelled rows.

    The bound is documented: of the labelled rows that ``train_rows`` admits, half of
    ``most_rows`` of each label at most, with texts of at most ``most_bytes`` bytes: the texts of
    the ids that come first by a hash, and of those, should ids have several, the ones that come
    first by a hash of id and text. An id with both labels counts as toxic; several texts of one id
    are a training row each, and rows that repeat both count once. Rows without an id have no label.
    """
    known = labels.where(train_rows)
    ok = pick(known, id=id_col, y=label_col).where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    by = [ok.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most_rows // 2) for y in (0, 1)]
    chosen = by[0].unionByName(by[1])
    texts = pick(docs, id=id_col, text=text_col).where(F.octet_length("text") <= most_bytes)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("y", F.xxhash64("id", "text").alias("draw")).agg(F.min(F.struct("id", "text")).alias("row"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy("draw"))).where(F.col("place") <= most_rows // 2)
    found = sorted((r.id, r.y, zlib.compress(r.text.encode("utf-8"), 1)) for r in rows.select("row.id", "y", "row.text").toLocalIterator())
    return train((zlib.decompress(t).decode("utf-8"), y) for _, y, t in found)


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row.

    Whole texts of any length; null and empty ones get the score of a text without known words.
    Repeated rows, with or without an id, give a row each; an empty table gives an empty result;
    other columns, whatever their names, are ignored.
    """
    import pyarrow as pa

    rows = pick(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    class Memo(dict):
        def __missing__(self, word: str) -> float:
            if len(self) >= _MEMO:
                self.clear()
            self[word] = v = shared.value.value(word)
            return v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        memo, bias = Memo(), shared.value.bias
        for batch in batches:
            z = np.array([bias + sum(map(memo.__getitem__, sorted(words_of(t.as_py())))) for t in batch.column(1)])
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
