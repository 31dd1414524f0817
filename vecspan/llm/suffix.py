"""Removal of repeated byte strings with per-shard suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, release, slices, stored, text_bytes, unpacked
from .shingles import mixed, powers

#: Bytes of distinct text in one suffix array.
SHARD_BYTES = 1 << 20
_GRAM = 32
#: Places of a hot anchor in its windows that are looked at together.
_STEP = 28
#: Bytes whose windows are found at once: their arrays fit the processor's cache.
PIECE = 1 << 16


def anchors(data, offsets, length: int):
    """The anchor of every window of ``length`` bytes that lies within one text.

    A window's anchor is its 32-byte gram of least hash, the leftmost of equals, so that equal
    windows have equal anchors at equal places. Returns, per run of windows with one anchor:
    text number, first and last start of the windows, 64-bit hash of the gram, place of the gram.
    """
    import numpy as np

    rng = np.random.default_rng(7_77)
    h = rng.integers(1, 2**63, 256, dtype=np.uint64)[data]
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    base = 0x9E3779B97F4A7C15
    k = 1
    while k < _GRAM:
        h = h[:-k] * np.uint64(pow(base, k, 2**64)) + h[k:]
        k *= 2
    h = mixed(h)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    grams = length - _GRAM + 1
    k = 1
    while 2 * k <= grams:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    if grams > k:
        low = np.minimum(low[: len(low) - (grams - k)], low[grams - k :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int64)
    begin, end = offsets[:-1], offsets[1:]
    long = end - begin >= length
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, end[long] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(s):
        return none, none, none, none, none
    # A window inside one text never reads another's bytes, so its anchor is the text's own.
    text = np.searchsorted(offsets, s, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (at[s[1:]] != at[s[:-1]]) | (text[1:] != text[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(s)]]) - 1
    return text[new], s[new], s[last], h[at[s[new]]].view(np.int64), at[s[new]]


class SuffixArray:
    """Suffixes of the contexts that have ``length`` bytes left, ordered by those bytes.

    Larsson-Sadakane refinement: suffixes are first sorted by eight bytes; then, with the step
    doubling, each group of equals is sorted by the group of the suffix one step on, and groups
    of one are left alone.
    """

    def __init__(self, contexts: list[bytes], length: int):
        import numpy as np

        self.length = length
        self.text = np.frombuffer(b"".join(contexts), np.uint8)
        size = np.array([len(c) for c in contexts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(size)])
        n = len(self.text)
        room = np.repeat(self.begin[1:], size) - np.arange(n)  # bytes left in the context
        self.packed = packed = np.zeros(n, np.uint64)  # eight bytes from each position on
        for k in range(8):
            packed[: n - k] |= self.text[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
        rank = np.full(n, -1, np.int64)
        live = np.flatnonzero(room >= 8)
        order = live[np.argsort(packed[live])]
        head = np.concatenate([[True], packed[order[1:]] != packed[order[:-1]]]) if len(order) else np.zeros(0, bool)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        h = 8
        while h < length and len(live):
            step = min(h, length - h)
            live = live[room[live] >= h + step]
            r = rank[live]
            sizes = np.bincount(r, minlength=n)
            live = live[sizes[r] > 1]
            by = live[np.argsort(rank[live] * n + rank[live + step])]  # by the group, then by the second half
            r, second = rank[by], rank[by + step]
            group = np.concatenate([[True], r[1:] != r[:-1]]) if len(by) else np.zeros(0, bool)
            head = group | np.concatenate([[True], second[1:] != second[:-1]]) if len(by) else group
            place = np.arange(len(by))
            first = np.maximum.accumulate(np.where(group, place, 0))
            part = np.maximum.accumulate(np.where(head, place, 0))
            rank[by] = r + part - first
            h += step
        self.rank = rank
        ready = np.flatnonzero(room >= length)
        self.order = ready[np.argsort(rank[ready])]

    def common(self):
        """Length, up to ``length``, of the prefix each suffix shares with the one before it.

        Kasai's rule, for all suffixes at once: where the suffix before is the left neighbour's
        shifted by one, the comparison starts at one less than the left neighbour's result.
        """
        import numpy as np

        order, n = self.order, len(self.text)
        before = np.full(n + 1, -1, np.int64)
        before[order[1:]] = order[:-1]
        lcp = np.zeros(n + 1, np.int64)
        p = np.sort(order[1:])
        if not len(p):
            return lcp[order]
        heads = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (before[p[1:]] != before[p[:-1]] + 1)])
        self._extend(p[heads], before, lcp)
        place = np.arange(len(p))
        start = np.maximum.accumulate(np.where(heads, place, 0))
        lcp[p] = np.maximum(0, lcp[p[start]] - (place - start))
        self._extend(p[~heads], before, lcp)
        return lcp[order]

    def _extend(self, p, before, lcp) -> None:
        """Go on comparing from lcp, eight bytes at a time."""
        import numpy as np

        p = p[lcp[p] < self.length]
        while len(p):
            differ = self.packed[p + lcp[p]] ^ self.packed[before[p] + lcp[p]]
            same = np.zeros(len(p), np.int64)
            for k in range(8):
                same += differ < np.uint64(1 << (8 * k)) if k else differ == 0
            lcp[p] = np.minimum(self.length, lcp[p] + same)
            p = p[(same == 8) & (lcp[p] < self.length)]

    def holds(self, other: SuffixArray, starts):
        """Whether this array has a suffix that agrees with other's at each of ``starts``: binary search."""
        import numpy as np

        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            less = self._compare(self.order[mid], other.text, starts[open_]) < 0
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        found = low < len(self.order)
        found[found] = self._compare(self.order[low[found]], other.text, starts[found]) == 0
        return found

    def _compare(self, mine, text, theirs):
        import numpy as np

        out = np.zeros(len(mine), np.int64)
        open_ = np.arange(len(mine))
        for k in range(self.length):
            d = self.text[mine[open_] + k].astype(np.int64) - text[theirs[open_] + k]
            out[open_] = d
            open_ = open_[d == 0]
            if not len(open_):
                break
        return out


def repeated_starts(contexts: list[bytes], times, length: int, other: list[bytes] | None = None):
    """For each context, the starts whose ``length`` bytes occur again.

    ``times``: how many places each (distinct) context stands for. With ``other``, only strings
    that some context of the other shard holds count.
    """
    import numpy as np

    sa = SuffixArray(contexts, length)
    ctx = np.searchsorted(sa.begin, sa.order, "right") - 1
    if other is None:
        same = sa.common() >= length
        again = same.copy()
        again[:-1] |= same[1:]
        again |= np.asarray(times)[ctx] > 1
    else:
        heads = np.flatnonzero(sa.common() < length)
        found = SuffixArray(other, length).holds(sa, sa.order[heads])
        again = np.repeat(found, np.diff(np.append(heads, len(sa.order))))
    hit = np.sort(sa.order[again])
    ctx = np.searchsorted(sa.begin, hit, "right") - 1
    return ctx, hit - sa.begin[ctx]


def pieces(data, offsets, length: int) -> Iterator[tuple]:
    """(first text, data, offsets, place) of texts together, or of a part of a long text that begins at ``place`` in it.

    Parts of a long text overlap, so that each window of ``length`` bytes is in exactly one.
    """
    import numpy as np

    for i, j in slices(offsets, PIECE):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j > i + 1 or hi - lo <= 2 * PIECE:
            yield i, data[lo:hi], offsets[i : j + 1] - lo, 0
            continue
        for at in range(lo, hi - length + 1, PIECE):
            part = data[at : min(hi, at + PIECE + length - 1)]
            yield i, part, np.array([0, len(part)]), at - lo


def ranges(starts) -> list[tuple[int, int, int]]:
    """Rising starts as (first, step, count); a run of one letter, or of several in turn, is one of each."""
    import numpy as np

    steps = np.diff(starts)
    change = np.append(np.flatnonzero(steps[1:] != steps[:-1]) + 1, len(steps))
    out, at = [], 0
    while at < len(starts):
        end = int(change[np.searchsorted(change, at, "right")]) if at < len(steps) else at
        out.append((int(starts[at]), int(steps[at]) if end > at else 1, end - at + 1))
        at = end + 1
    return out


def _hashes(data):
    """A function (starts, length) -> 64-bit hashes of the byte strings there."""
    import numpy as np

    rng = np.random.default_rng(7_78)
    base = np.uint64(0xD6E8FEB86659FD93)
    back = np.uint64(pow(int(base), -1, 2**64))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(rng.integers(1, 2**63, 256, dtype=np.uint64)[data] * powers(base, len(data)), out=total[1:], dtype=np.uint64)
    undo = powers(back, len(data) + 1)

    def of(first, size):
        size = np.broadcast_to(size, first.shape)
        return mixed((total[first + size] - total[first]) * undo[first] + size.astype(np.uint64))

    return of


def contexts(data, offsets, length: int, wanted: list, hot: bool) -> Iterator[tuple[int, int, list, bytes]]:
    """(text number, key, ranges of starts, bytes) of each distinct context of wanted grams in a piece.

    ``wanted`` has an array of grams for each text. The key of a context is its gram; for hot
    ones each place of the gram in a window, in steps, has a key of its own, of all bytes that
    the windows of that step have in common.
    """
    import numpy as np

    text, first, last, gram, at = anchors(data, offsets, length)
    use = np.zeros(len(text), bool)
    cuts = np.searchsorted(text, np.arange(len(offsets)))
    for i, grams in enumerate(wanted):
        a, b = cuts[i], cuts[i + 1]
        if len(grams) and b > a:
            use[a:b] = np.isin(gram[a:b], grams)
    text, first, last, key, at = (x[use] for x in (text, first, last, gram, at))
    if not len(text):
        return
    of = _hashes(data)
    if hot:
        parts = []
        for c in range((length - _GRAM) // _STEP + 1):
            lo, hi = np.maximum(first, at - (c + 1) * _STEP + 1), np.minimum(last, at - c * _STEP)
            ok = lo <= hi
            core = of(at[ok] - c * _STEP, length - _STEP + 1) ^ np.uint64(c + 1)
            parts.append((text[ok], lo[ok], hi[ok], mixed(core).view(np.int64)))
        text, first, last, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    size, raw = last - first + length, data.tobytes()
    same = of(first, size)
    by = np.lexsort((first, same, size, key, text))
    text, first, size, key, same = (x[by] for x in (text, first, size, key, same))
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (same[1:] != same[:-1])]))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(text)], strict=True):
        i = int(text[a])
        s = int(first[a])
        yield i, int(key[a]), [(s - int(offsets[i]), 1, 1)] if b == a + 1 else ranges(first[a:b] - offsets[i]), raw[s : s + int(size[a])]


_RANGES = "array<struct<first: long, step: long, count: long>>"


def _spans(r, a, b):
    """Where the bytes [a, b) of a context are in a text that has it at the starts of a range: joined where they meet."""
    one = F.array(F.struct((r["first"] + a).alias("a"), (r["first"] + (r["count"] - 1) * r["step"] + b).alias("b")))
    each = F.transform(F.sequence(F.lit(0).cast("long"), r["count"] - 1), lambda i: F.struct((r["first"] + i * r["step"] + a).alias("a"), (r["first"] + i * r["step"] + b).alias("b")))
    return F.when(r["step"] <= b - a, one).otherwise(each)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) or kept_sha256 of every row.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in the
    same text or another row's, goes; overlaps count and all is judged on the input. Texts are
    UTF-8 bytes and null is empty; matches never cross texts. Repeated rows, with or without an
    id, are texts of their own, so that one of ``length`` bytes or more goes whole; an empty
    table gives an empty result; other columns, whatever their names, are ignored. Long texts are
    read in overlapping pieces, and a run of one repeated pattern is held as one range. ``length``
    is at least 64.

    Method: equal texts are one class. Every window of ``length`` bytes belongs to its anchor, a
    gram picked by its content alone, so that equal windows meet under equal anchors and nothing
    is lost where windows of anchors that occur once aren't looked at. The texts around anchors
    that occur again are dealt by anchor into shards; each shard sorts its suffixes
    (Larsson-Sadakane), finds common prefixes (Kasai) and returns runs of repeated starts.

    The contexts of a hot anchor, with more text than a shard may hold, are first split by the
    place of the anchor in the window, then equal ones are combined, so that what is dealt is
    distinct text around ``length - 27`` equal bytes. Where even that is more than a shard may
    hold, it is dealt into several, which are merged pair by pair through binary search of one's
    strings in the other's suffix array.
    """
    import pyarrow as pa

    if length < 64:
        raise ValueError("length is 64 at least")
    rows = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("k2"), text).alias("k2"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    classes = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in (0, 1))
            for i, data, offsets, place in pieces(*text_bytes(batch.column(2)), length):
                text, _, _, gram, _ = anchors(data, offsets, length)
                by = np.lexsort((gram, text))
                text, gram = text[by], gram[by]
                new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])])) if len(text) else text
                times = np.diff(np.append(new, len(text)))
                yield pa.RecordBatch.from_arrays([pa.array(k1[i + text[new]]), pa.array(k2[i + text[new]]), pa.array(gram[new]), pa.array(times.astype(np.int32)), pa.array(np.full(len(new), place))], names=["k1", "k2", "gram", "times", "place"])

    marks = rows.select("k1", "k2", "text").mapInArrow(mark, "k1 long, k2 long, gram long, times int, place long")
    again = marks.groupBy("gram").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.min("place").alias("p"), F.max("place").alias("q"), F.max("times").alias("times"), F.count("*").alias("n"))
    context = int(length * 1.5)
    again = stored(again.where("a < b or p < q or times > 1").select("gram", "n", (F.col("n") * context > SHARD_BYTES).alias("hot")))
    size, any_hot = again.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("hot")).first()
    buckets = max(1, size * context // SHARD_BYTES)
    wanted = marks.select("k1", "k2", "gram").join(again.select("gram", "hot"), "gram").groupBy("k1", "k2").agg(F.collect_set(F.struct("gram", "hot")).alias("grams"))
    wanted = stored(wanted.join(classes, ["k1", "k2"]).select("k1", "k2", "rep", "grams"))
    release(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            raw, ends = memoryview(data), offsets.tolist()
            frames = [zip_.compress(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(frames, pa.binary())], names=["doc_id", "k1", "k2", "packed"])

    # Both times that texts meet others' findings they travel compressed. What the first time yields is stored, so that
    # one journey serves hot and other grams, and the files of a step are gone before the next.
    travel = rows.select("doc_id", "k1", "k2", "text").mapInArrow(pack, f"doc_id {kind}, k1 long, k2 long, packed binary")
    texts = stored(travel.join(wanted, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("k1", "k2", "packed", "grams"))
    discard(again, wanted)
    release(docs.sparkSession)

    kind_of_ranges = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "step", "count")]))

    def surround(hot: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            kinds = [pa.int64(), pa.int64(), pa.int64(), kind_of_ranges, pa.binary()]

            def table(out: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "k1", "k2", "ranges", "context"])

            for batch in batches:
                for b in range(0, batch.num_rows, 64):
                    part = batch.slice(b, 64)
                    k1, k2 = (part.column(c).to_pylist() for c in (0, 1))
                    grams = [np.array([g["gram"] for g in x if g["hot"] == hot], np.int64) for x in part.column(3).to_pylist()]
                    out: list[tuple] = []
                    for i, data, offsets, place in pieces(*text_bytes(unpacked(part.column(2))), length):
                        for j, key, at, raw in contexts(data, offsets, length, grams[i : i + len(offsets) - 1], hot):
                            out.append((key, k1[i + j], k2[i + j], [{"first": f + place, "step": s, "count": n} for f, s, n in at], raw))
                            if len(out) >= 4096:
                                yield table(out)
                                out = []
                    if out:
                        yield table(out)

        return run

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of repeated bytes in the contexts of each (bucket, lo, hi)."""
        import numpy as np

        def settle(held: dict[bytes, list], cross: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
            sides = [None] if cross is None else [(cross[0], cross[1]), (cross[1], cross[0])]
            for side in sides:
                mine = [c for c, x in held.items() if side is None or x[0] == side[0]]
                theirs = None if side is None else [c for c, x in held.items() if x[0] == side[1]]
                if not mine or theirs == []:
                    continue
                ctx, starts = repeated_starts(mine, [held[c][1] for c in mine], length, theirs)
                if not len(ctx):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (starts[1:] != starts[:-1] + 1)]))
                end = np.append(new[1:], len(ctx)) - 1
                out: tuple[list, ...] = ([], [], [], [], [])
                for c, s, e in zip(ctx[new].tolist(), starts[new].tolist(), starts[end].tolist(), strict=True):
                    for x, y, at in held[mine[c]][2]:
                        for o, v in zip(out, (x, y, at, s, e + length), strict=True):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), kind_of_ranges, pa.int64(), pa.int64()), strict=True)], names=["k1", "k2", "ranges", "a", "b"])

        held: dict[bytes, list] = {}
        last = None
        for batch in batches:
            for bucket, lo, hi, own, k1, k2, at, times, raw in zip(*(batch.column(c).to_pylist() for c in range(9)), strict=True):
                if (bucket, lo, hi) != last:
                    if held:
                        yield from settle(held, None if last[1] == last[2] else last[1:])
                    held, last = {}, (bucket, lo, hi)
                x = held.setdefault(raw, [own, 0, []])
                x[1] += times
                x[2].append((k1, k2, at))
        if held:
            yield from settle(held, None if last[1] == last[2] else last[1:])

    def dealt(frame: DataFrame) -> DataFrame:
        cols = ["bucket", "lo", "hi", "own", "k1", "k2", "ranges", "times", "context"]
        by = frame.select(*cols).repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
        return by.mapInArrow(shard, f"k1 long, k2 long, ranges {_RANGES}, a long, b long")

    zero = F.lit(0)
    starts = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["count"])
    around = texts.mapInArrow(surround(False), f"key long, k1 long, k2 long, ranges {_RANGES}, context binary")
    runs = dealt(around.select(F.pmod("key", F.lit(buckets)).alias("bucket"), zero.alias("lo"), zero.alias("hi"), zero.alias("own"), "k1", "k2", "ranges", starts.alias("times"), "context"))
    runs = runs.select("k1", "k2", F.explode("ranges").alias("r"), "a", "b")
    done = [texts]
    if any_hot:
        hot = texts.where(F.exists("grams", lambda g: g["hot"])).mapInArrow(surround(True), f"key long, k1 long, k2 long, ranges {_RANGES}, context binary")
        hot = stored(hot.withColumn("c1", F.xxhash64("context")).withColumn("c2", F.xxhash64(F.lit("c2"), "context")))
        one = stored(hot.groupBy("key", "c1", "c2").agg(F.first("context").alias("context"), F.sum(starts).alias("times")))
        keys = one.groupBy("key").agg(F.sum("times").alias("all"), F.sum(F.octet_length("context")).alias("bytes")).where("all > 1").select("key", F.ceil(F.col("bytes") / SHARD_BYTES).cast("int").alias("blocks"))
        one = one.join(keys, "key").withColumn("own", F.pmod("c1", F.col("blocks")).cast("int"))
        one = one.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # A small key's bucket is shared; that of a large one, below zero, is its own.
        bucket = F.when(F.col("blocks") == 1, F.pmod("key", F.lit(buckets))).otherwise(F.col("key").bitwiseOR(F.lit(-(2**63))))
        place = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("step"), F.lit(1).cast("long").alias("count")))
        found = dealt(one.select(bucket.alias("bucket"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", F.col("c1").alias("k1"), F.col("c2").alias("k2"), place.alias("ranges"), "times", "context"))
        found = stored(found.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "a", "b").distinct())
        places = hot.select("c1", "c2", "k1", "k2", "ranges").join(found, ["c1", "c2"]).select("k1", "k2", F.explode("ranges").alias("r"), "a", "b")
        runs = runs.unionByName(places)
        done += [hot, found]
    spans = runs.select("k1", "k2", F.explode(_spans(F.col("r"), F.col("a"), F.col("b"))).alias("s"))
    runs = stored(spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("s")).alias("runs")))
    discard(*done)
    release(docs.sparkSession)
    fate = classes.where("copies > 1").select("k1", "k2", F.lit(True).alias("whole")).join(runs, ["k1", "k2"], "full")
    joined = travel.join(fate, ["k1", "k2"], "left").select("doc_id", "packed", F.coalesce("whole", F.lit(False)).alias("whole"), "runs")
    kept_name, kept_kind = ("kept_sha256", "string") if digest else ("kept", "binary")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, removed, spans, kept = [], [], [], []
                for frame, whole, runs_ in zip(part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    raw = open_.decompress(frame.as_py())
                    cuts = [[0, len(raw)]] if whole and len(raw) >= length else []
                    for r in () if cuts else runs_ or ():
                        if cuts and r["a"] <= cuts[-1][1]:
                            cuts[-1][1] = max(cuts[-1][1], r["b"])
                        else:
                            cuts.append([r["a"], r["b"]])
                    ends = [0, *(x for c in cuts for x in c), len(raw)]
                    left = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                    n.append(len(raw))
                    removed.append(len(raw) - len(left))
                    spans.append(len(cuts))
                    kept.append(hashlib.sha256(left).hexdigest() if digest else left)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", kept_name])

    return joined.mapInArrow(apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {kept_name} {kept_kind}")
