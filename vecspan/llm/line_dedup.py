"""Line dedup by probing sharded minimal perfect hash tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

_STRIP = b" \t\n\x0b\x0c\r"
#: Keys of one shard, and the bytes of tables that may be broadcast; beyond it probes are routed.
SHARD_KEYS, MOST_BROADCAST, _KEY_BYTES = 16_384, 48 << 20, 24
#: Where probes are routed, probes of one place: a shard's table is sent to as many places as its lines' documents need.
PLACE_PROBES = 1_000_000
#: Shards whose number of places may be broadcast.
MOST_SHARDS = 200_000


def line_keys(text: str | None, least: int) -> tuple[list[str], list[int | None]]:
    """The lines of a text and the 128-bit hash of each key; None where the key is too short."""
    from xxhash import xxh3_128_intdigest

    text = text or ""
    lines = text.split("\n")
    keys: list[int | None] = []
    # bytes.lower touches A-Z only.
    for raw in text.encode("utf-8").lower().split(b"\n"):
        k = raw.strip(_STRIP)
        short = len(k) < least or (len(k) < 4 * least and len(k.decode("utf-8")) < least)
        keys.append(None if short else xxh3_128_intdigest(k))
    return lines, keys


def _halves(keys):
    import numpy as np

    raw = b"".join(k.to_bytes(16, "little") for k in keys)
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def _mix(h1, h2, level: int):
    import numpy as np

    x = h1 ^ (h2 * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (2**64 - 1)))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class PerfectTable:
    """A minimal perfect hash over distinct 128-bit keys, with fingerprint, owner and count arrays.

    Each level is a bit array of about 1.5 bits a key; a key alone on its bit is placed, the
    others go to the next level. A key's slot is the number of set bits before its own.
    """

    def __init__(self, sizes, bits: bytes, fps: bytes, owners: bytes, counts: bytes):
        import numpy as np

        self.sizes = [int(s) for s in sizes]
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8))
        self.rank = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int32)])
        self.fps, self.owners, self.counts = np.frombuffer(fps, np.uint64), np.frombuffer(owners, np.int64), np.frombuffer(counts, np.uint32)

    @staticmethod
    def build(h1, h2, owners, counts) -> tuple[list[int], bytes, bytes, bytes, bytes]:
        import numpy as np

        left = np.arange(len(h1))
        sizes, bits, order = [], [], []
        while len(left):
            m = (int(1.5 * len(left)) + 8) // 8 * 8
            at = (_mix(h1[left], h2[left], len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            placed = alone[at]
            order.append(left[placed][np.argsort(at[placed])])
            bits.append(alone)
            sizes.append(m)
            left = left[~placed]
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        flat = np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8)
        return sizes, flat.tobytes(), h2[order].tobytes(), owners[order].astype(np.int64).tobytes(), np.minimum(counts[order], 2**32 - 1).astype(np.uint32).tobytes()

    def owner(self, h1, h2):
        """(found, owner) of each key; a key that isn't in the table is found with odds of 2**-64."""
        import numpy as np

        slot = np.full(len(h1), -1, np.int64)
        start, open_ = 0, np.arange(len(h1))
        for level, m in enumerate(self.sizes):
            at = start + (_mix(h1[open_], h2[open_], level) % np.uint64(m)).astype(np.int64)
            hit = self.bits[at] == 1
            slot[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
            start += m
        found = slot >= 0
        found[found] = (self.fps[slot[found]] == h2[found]) & (self.counts[slot[found]] >= 2)
        return found, np.where(found, self.owners[np.maximum(slot, 0)] if len(self.owners) else 0, 0)


def _key_rows(docs: DataFrame, least: int) -> DataFrame:
    """(h1, h2, doc_id, row): each distinct line key of each row of ``docs`` (doc_id, text, row)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own, ids, rows = [], [], []
                for d, t, r in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    keys = {k for k in line_keys(t.as_py(), least)[1] if k is not None}
                    own += keys
                    ids += [d] * len(keys)
                    rows += [r] * len(keys)
                h = _halves(own).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())], names=["h1", "h2", "doc_id", "row"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, row long")


def _tables(dup: DataFrame, shards: int) -> DataFrame:
    """A row per shard: its perfect hash and arrays. A shard holds about SHARD_KEYS keys."""
    import pandas as pd

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        h1, h2 = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        sizes, bits, fps, owners, counts = PerfectTable.build(h1, h2, pdf["owner"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "sizes": [sizes], "bits": [bits], "fps": [fps], "owners": [owners], "counts": [counts]})

    return dup.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(build, "shard long, sizes array<int>, bits binary, fps binary, owners binary, counts binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, digest: bool = False, probe: str = "auto") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text (or kept_sha256) of every row.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at
    least ``least`` code points that two or more ids hold lose all their lines except in the
    smallest such id. A row without an id counts as no holder and loses all lines of such keys.
    Null and empty texts are one empty line; rows with one id share its fate, row by row. Texts
    and lines of any length are read whole. Ids are integers; others are an error. An empty table
    gives an empty result; other columns, whatever their names, are ignored.

    Method: the distinct keys of each document are counted by a map-side combined aggregation of
    128-bit hashes (a hot line is one row per task). Those found in two ids or more go to
    shards; each shard's minimal perfect hash indexes compact fingerprint, owner and count
    arrays. Documents then probe these arrays. ``probe``: "broadcast" sends all arrays to every
    worker and is taken where they need at most MOST_BROADCAST bytes; "routed" sends the keys
    of documents to the shard instead and holds at any size; "auto" decides by the exact count.
    """
    import pyarrow as pa

    rows = pick(docs, doc_id=id_col, text=text_col)
    if rows.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"ids of lines are integers, not {rows.schema['doc_id'].dataType.simpleString()}")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    spark = docs.sparkSession
    # A row without an id owns no key and is known by its text.
    rows = rows.withColumn("row", F.coalesce("doc_id", F.xxhash64("text")))
    keys = _key_rows(rows, least)
    dup = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"), F.count("*").alias("n"))
    dup = stored(dup.where("owner < other").select("h1", "h2", "owner", "n"))
    n = dup.count()
    shards = max(1, -(-n // SHARD_KEYS))
    tables = _tables(dup, shards)
    if probe == "auto":
        probe = "broadcast" if n * _KEY_BYTES <= MOST_BROADCAST else "routed"
    kind = "kept_sha256" if digest else "kept_text"
    schema = f"doc_id long, n_lines long, n_dropped long, {kind} string"

    def result(ids, texts, lost) -> pa.RecordBatch:
        """lost(ids, list of key lists) -> list of flag lists."""
        split = [line_keys(t.as_py(), least) for t in texts]
        flags = lost(ids, [k for _, k in split])
        kept = ["\n".join(x for x, f in zip(lines, fs, strict=True) if not f) for (lines, _), fs in zip(split, flags, strict=True)]
        if digest:
            kept = [hashlib.sha256(k.encode("utf-8")).hexdigest() for k in kept]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(f) for f in flags], pa.int64()), pa.array([sum(f) for f in flags], pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", kind])

    if probe == "broadcast":
        shared = spark.sparkContext.broadcast({r.shard: (r.sizes, bytes(r.bits), bytes(r.fps), bytes(r.owners), bytes(r.counts)) for r in tables.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            loaded = {s: PerfectTable(*x) for s, x in shared.value.items()}

            def lost(ids, lists):
                flat = [k for ks in lists for k in ks if k is not None]
                h = _halves(flat)
                n_keys = [sum(k is not None for k in ks) for ks in lists]
                own = np.repeat(ids.fill_null(0).to_numpy(), n_keys)
                no_id = np.repeat(ids.is_null().to_numpy(zero_copy_only=False), n_keys)
                shard = h[:, 0].view(np.int64) % shards if len(h) else np.zeros(0, np.int64)
                gone = np.zeros(len(flat), bool)
                for s in np.unique(shard):
                    if s in loaded:
                        at = np.flatnonzero(shard == s)
                        found, owner = loaded[s].owner(np.ascontiguousarray(h[at, 0]), np.ascontiguousarray(h[at, 1]))
                        gone[at] = found & (no_id[at] | (owner != own[at]))
                it = iter(gone.tolist())
                return [[k is not None and next(it) for k in ks] for ks in lists]

            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    yield result(part.column(0), part.column(1), lost)

        return rows.select("doc_id", "text").mapInArrow(run, schema)

    # Routed: table rows come first in each partition, then the keys to look up.
    none = [F.lit(None).cast(t).alias(c) for c, t in (("sizes", "array<int>"), ("bits", "binary"), ("fps", "binary"), ("owners", "binary"), ("counts", "binary"))]
    places = stored(dup.groupBy(F.pmod("h1", F.lit(shards)).alias("shard")).agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / PLACE_PROBES)).cast("long").alias("places")))
    some = F.broadcast(places) if shards <= MOST_SHARDS else places
    probes = keys.withColumn("shard", F.pmod("h1", F.lit(shards))).join(some, "shard").select("shard", F.pmod(F.xxhash64("row"), F.col("places")).alias("salt"), F.lit(1).alias("side"), "h1", "h2", F.col("doc_id").isNull().alias("no_id"), "row", *none)
    held = tables.join(some, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("salt"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(False).alias("no_id"), F.lit(0).cast("long").alias("row"), "sizes", "bits", "fps", "owners", "counts")
    both = held.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "side")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        at, tab = None, None
        for batch in batches:
            shard, side = batch.column("shard").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(shard, prepend=shard[:1] - 1) != 0) | (side == 0))
            for i, j in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if side[i] == 0:
                    row = batch.slice(i, 1).to_pylist()[0]
                    at, tab = row["shard"], PerfectTable(row["sizes"], row["bits"], row["fps"], row["owners"], row["counts"])
                    i += 1
                if i < j and tab is not None and at == shard[i]:
                    part = batch.slice(i, j - i)
                    h1, h2, ids = (part.column(c).to_numpy() for c in ("h1", "h2", "row"))
                    no_id = part.column("no_id").to_numpy(zero_copy_only=False)
                    found, owner = tab.owner(h1.view(np.uint64), h2.view(np.uint64))
                    gone = np.flatnonzero(found & (no_id | (owner != ids)))
                    if len(gone):
                        yield part.select(["row", "no_id", "h1", "h2"]).take(pa.array(gone))

    gone = both.mapInArrow(look, "row long, no_id boolean, h1 long, h2 long")
    by_doc = gone.groupBy("row", "no_id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    joined = rows.withColumn("no_id", F.col("doc_id").isNull()).join(by_doc, ["row", "no_id"], "left").select("doc_id", "text", "gone")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [{((g["h1"] % 2**64) | (g["h2"] % 2**64) << 64) for g in x or ()} for x in part.column(2).to_pylist()]
                yield result(part.column(0), part.column(1), lambda ids, lists, sets=sets: [[k is not None and k in s for k in ks] for ks, s in zip(lists, sets, strict=True)])

    return joined.mapInArrow(apply, schema)
