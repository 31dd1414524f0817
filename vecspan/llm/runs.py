"""Periodic runs of words: every stretch of a text that repeats with some period, and the text with the repeats dropped.

Substrings of 1, 2, 4, 8, ... words are named after Karp, Miller and Rosenberg: two have one name
where they are equal. How far two places agree, forwards or backwards, follows from the names,
from the longest to the shortest. A run of period p covers two places p apart on the grid of
multiples of p, so that only those are asked, about n ln n of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from vecspan.session import importable

from .common import pick, slices, text_bytes, trimmed

#: Bytes of text that are named together; one longer text stands alone.
BATCH_BYTES = 1 << 20
#: Grid places asked at once.
MOST_PLACES = 1 << 19


def names(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Names of the 1, 2, 4, ... words from each place on, a level each: -1 where no second place of the text has an equal one, or past its end.

    ``words`` are word numbers of texts one after the other; a name belongs to one text only. A
    level further is made from places with a name alone, and the last level has at least one.
    """
    n = len(words)
    levels: list[np.ndarray] = []
    alive, size = np.arange(n), 1
    key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    while len(alive):
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        alive, inverse = alive[again], inverse[again]
        if not len(alive):
            break
        level = np.full(n + 1, -1, np.int32)
        level[alive] = inverse
        levels.append(level)
        alive = alive[alive + 2 * size <= ends[doc[alive]]]
        alive = alive[level[alive + size] >= 0]
        key = level[alive].astype(np.int64) * (n + 1) + level[alive + size]
        size *= 2
    return levels


def agreement(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from places ``a`` and ``b`` on are equal."""
    total = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x = levels[k][a + total]
        total += ((x >= 0) & (x == levels[k][b + total])).astype(np.int64) << k
    return total


def agreement_back(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many words that end before places ``a`` < ``b`` are equal, from place ``first`` on."""
    total = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x = a - total - (1 << k)
        inside = x >= first
        x = np.where(inside, x, a)
        name = levels[k][x]
        total += (inside & (name >= 0) & (name == levels[k][x + (b - a)])).astype(np.int64) << k
    return total


def find_runs(words: np.ndarray, counts: np.ndarray, least: int = 12) -> np.ndarray:
    """(text, start, length, period) of every run, sorted, of texts one after the other with ``counts`` words each."""
    ends = np.cumsum(counts)
    starts = ends - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    levels = names(words, starts, ends, doc)
    none = np.zeros((0, 4), np.int64)
    # A run of period p has an agreement of p words or more, and of least - p, about a grid place: half of it on one side.
    top = np.full(len(counts), -1)
    for k, level in enumerate(levels):
        top[doc[level[:-1] >= 0]] = k
    least = max(least, 2)
    lowest = int(np.log2(((least + 1) // 2 + 1) // 2))
    most = np.where((counts >= least) & (top >= lowest), np.minimum(counts // 2, (4 << np.maximum(top, 0)) - 2), 0)
    texts = np.repeat(np.arange(len(counts)), most)
    if not len(texts):
        return none
    period = np.arange(len(texts)) - np.repeat(np.cumsum(most) - most, most) + 1
    by = np.argsort(period, kind="stable")
    texts, period = texts[by], period[by]
    places = (counts[texts] - 1) // period
    upto = np.cumsum(places)
    found = none
    for low in range(0, int(upto[-1]), MOST_PLACES):
        # The grid places [low, high) of all (text, period) pairs, one after the other.
        high = min(low + MOST_PLACES, int(upto[-1]))
        a, b = np.searchsorted(upto, [low, high - 1], "right") + [0, 1]
        first = np.maximum(upto[a:b] - places[a:b], low)
        many = np.minimum(upto[a:b], high) - first
        t, p = np.repeat(texts[a:b], many), np.repeat(period[a:b], many)
        step = np.arange(low, high) - np.repeat(upto[a:b] - places[a:b], many)
        i = starts[t] + step * p
        level = np.log2((np.maximum(p, least - p) + 1) // 2).astype(np.int64)
        hit = np.zeros(len(i), bool)
        for k in np.unique(level):
            if k >= len(levels):
                continue
            some = np.flatnonzero(level == k)
            x, q, name = i[some], p[some], levels[k]
            ahead = name[x]
            before = x - (1 << int(k))
            inside = before >= starts[t[some]]
            before = np.where(inside, before, x)
            back = name[before]
            hit[some] = ((ahead >= 0) & (ahead == name[x + q])) | (inside & (back >= 0) & (back == name[before + q]))
        t, p, i = t[hit], p[hit], i[hit]
        s = i - agreement_back(levels, i, i + p, starts[t])
        e = i + p + agreement(levels, i, i + p)
        good = e - s >= np.maximum(least, 2 * p)
        found = _least_period(np.concatenate([found, np.stack([t, s, e, p], 1)[good]]))
    found[:, 2] -= found[:, 1]
    found[:, 1] -= starts[found[:, 0]]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _least_period(found: np.ndarray) -> np.ndarray:
    """Of rows (text, start, end, period) for one stretch the one with the smallest period."""
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, 1:3] != found[:-1, 1:3]).any(1)
    return found[new]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every text.

    Words are stretches without blank, tab, line end, form feed or vertical tab. A run is a
    stretch of words with smallest period q (words q apart are equal), at least ``least`` words and
    twice q long, that no neighbouring word extends; runs is an array of (start, length, period)
    structs by start, then period. collapsed is the words joined by one blank, without those that
    a run contains after its first q words.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Whole texts of
    any length: a text takes memory for four bytes a word and level of names, and the levels end
    where nothing repeats. Rows that repeat an id or a text give a row each; an empty table gives
    an empty result; other columns, whatever their names, are ignored. Map-only.
    """
    import pyarrow as pa

    rows = pick(docs, doc_id=id_col, text=text_col)
    importable(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, BATCH_BYTES):
                text = pc.fill_null(batch.column(1).slice(a, b - a).cast(pa.large_string()), "")
                split = pc.ascii_split_whitespace(text)
                lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
                flat = split.flatten()
                there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(b - a), lengths)[there]
                flat = flat.filter(pa.array(there))
                counts = np.bincount(doc, minlength=b - a)
                words = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                found = find_runs(words, counts, least)
                # Words that some run drops, by marks at both ends of what each run drops.
                starts = np.cumsum(counts) - counts
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, starts[found[:, 0]] + found[:, 1] + found[:, 3], 1)
                np.add.at(mark, starts[found[:, 0]] + found[:, 1] + found[:, 2], -1)
                kept = np.cumsum(mark)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=b - a))])
                lines = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept)).cast(pa.string()))
                ends = np.searchsorted(found[:, 0], np.arange(b - a + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], fields=list(run_type)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), runs, pc.binary_join(lines, " ")], names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
