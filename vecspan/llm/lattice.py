"""Near-duplicate vectors by E8 lattice hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, pick, stored

#: Vectors of a cell compared in one block; larger cells are dealt out in pairs of blocks.
BLOCK = 2048
#: Vectors of a label from which on its lattices are so fine, and tables of them: (vectors, scale,
#: tables). A finer lattice lets fewer random pairs share a cell and needs more tables.
FINENESS = ((0, 1.0, 5), (1 << 13, 0.8, 9), (1 << 17, 0.65, 20), (1 << 21, 0.55, 45))
#: Labels of more vectors than the second of FINENESS that may be broadcast.
MOST_LABELS = 200_000
#: Pairs whose cosines are found at once.
_PAIRS = 1 << 17


@lru_cache(maxsize=1)
def roots():
    """The 240 shortest vectors of E8, from their rule."""
    import itertools

    import numpy as np

    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    for signs in itertools.product((0.5, -0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            out.append(np.array(signs))
    return np.array(out)


def nearest_e8(z):
    """The nearest E8 point of each row: the better of D8 and D8 + 1/2 (Conway and Sloane)."""
    import numpy as np

    def d8(x):
        f = np.rint(x)
        off = x - f
        odd = np.flatnonzero(f.sum(1).astype(np.int64) % 2)
        k = np.abs(off[odd]).argmax(1)
        f[odd, k] += np.where(off[odd, k] >= 0, 1.0, -1.0)
        return f

    a, b = d8(z), d8(z - 0.5) + 0.5
    closer = ((z - a) ** 2).sum(1) <= ((z - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def cells(unit, tables: int, probes: int, scale: float, seed: int):
    """(n, tables, 1 + probes) cell hashes of unit vectors.

    Each table projects to eight Gaussian coordinates, shifts them at random and decodes them to
    E8. The first cell is the nearest point's; the others belong to the neighbouring points that
    lie nearest. Sums are added up component by component, so that a vector's cells are the same
    to the last bit whatever vectors it comes with.
    """
    import numpy as np

    n, dim = unit.shape
    rng = np.random.default_rng([seed, dim])
    out = np.empty((n, tables, 1 + probes), np.int64)
    near = roots()
    coef = rng.integers(1, 2**63, size=(tables, 8), dtype=np.uint64) | np.uint64(1)
    axes, shift = rng.standard_normal((dim, tables * 8)) / scale, rng.uniform(0, 2, tables * 8)
    for at in range(0, n, 1024):
        u = unit[at : at + 1024]
        all_ = np.zeros((len(u), tables * 8)) + shift
        for d in range(dim):
            all_ += u[:, d, None] * axes[d]
        for t in range(tables):
            z = all_[:, 8 * t : 8 * t + 8]
            x = nearest_e8(z)
            points = x[:, None]
            if probes:
                off, along = z - x, np.zeros((len(u), len(near)))
                for k in range(8):
                    along += off[:, k, None] * near[:, k]
                by = np.argpartition(-along, probes, axis=1)[:, :probes]
                points = np.concatenate([points, x[:, None] + near[by]], axis=1)
            twice = np.rint(2 * points).astype(np.int64).view(np.uint64)
            h = (twice * coef[t]).sum(2, dtype=np.uint64)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[at : at + 1024, t] = (h ^ (h >> np.uint64(32))).view(np.int64)
    return out


def cell_codes(unit, label, tier: int, probes: int, seed: int):
    """The cells of unit vectors with their labels' 64-bit keys, at a place in FINENESS."""
    import numpy as np

    _, scale, tables = FINENESS[tier]
    return cells(unit, tables, probes, scale, seed) ^ (label[:, None, None] * np.int64(-7046029254386353131)) ^ (np.arange(tables)[None, :, None] + 1)


def unit_vectors(column, at=None):
    """Rows of an Arrow list column, all of one length, as unit vectors in double precision."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = np.ascontiguousarray(x if at is None else x[at])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked_pairs(vec, begin, size, blk, cross, cosine: float):
    """(i, j), i < j, of the rows of one cell whose cosine is ``cosine`` at least, for many cells at once.

    Cells are runs of ``size`` rows from ``begin``; in those marked ``cross`` only pairs of two
    blocks count. Pairs of small cells are made side by side, large cells by a matrix product.
    """
    import numpy as np

    left, right = [], []
    for m in np.unique(size[(size > 1) & (size <= 64)]):
        i, j = np.triu_indices(m, 1)
        heads, each = begin[size == m], max(1, _PAIRS // len(i))
        for at in range(0, len(heads), each):
            h = heads[at : at + each, None]
            a, b = (h + i).ravel(), (h + j).ravel()
            ok = np.einsum("ij,ij->i", vec[a], vec[b]) >= cosine
            left.append(a[ok])
            right.append(b[ok])
    for b, m in zip(begin[size > 64], size[size > 64], strict=True):
        for at in range(0, m, 512):  # rows of the matrix at once
            i, j = np.nonzero(vec[b + at : b + min(m, at + 512)] @ vec[b + at : b + m].T >= cosine)
            up = i < j
            left.append(i[up] + b + at)
            right.append(j[up] + b + at)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    ok = ~cross[i] | (blk[i] != blk[j])
    return i[ok], j[ok]


def first_met(codes, table, key, i, j):
    """Whether a pair meets in this cell first: no earlier table, nor a smaller code in this one, has both."""
    import numpy as np

    first = np.ones(len(i), bool)
    for t in range(int(table.max()) + 1 if len(i) else 0):
        for at in range(0, len(i), 1 << 16):
            s = np.arange(at, min(at + (1 << 16), len(i)))
            s = s[first[s] & (table[i[s]] >= t)]
            a = codes[i[s], t]
            eq = a[:, :, None] == codes[j[s], t][:, None, :]
            eq &= ((table[i[s]] > t)[:, None] | (a < key[i[s], None]))[:, :, None]
            first[s[eq.any((1, 2))]] = False
    return first


def least_reachable(n: int, i, j):
    """For each of n rows the least row that edges (i, j) reach."""
    import numpy as np

    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        np.minimum.at(new, low[i], low[j])
        np.minimum.at(new, low[j], low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, probes: int = 7, seed: int = 7) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared where labels are equal and not null. Null and zero vectors, and those
    with null or non-finite components, link with nothing; neither do vectors of different
    lengths. Equal vectors (repeated rows too) are one class throughout and link with each other,
    also those without an id; a class is known by its least id, and one without any links with
    nothing beyond itself. An empty table gives an empty result; other columns are ignored,
    whatever their names. The candidate search is a lattice hash and so may miss a link; every
    link reported was verified in double precision.

    Method: class representatives go to the cells of several E8 lattices and to ``probes``
    neighbouring cells each; the lattices are the finer the more vectors a label has (FINENESS),
    so that a vector's candidates don't grow with the table. Cells with one member are dropped
    before vectors are attached; a cell's vectors are compared in blocks, larger cells in pairs of
    blocks. A task returns per vector the weight of links first met there, and a spanning forest,
    never the pairs.
    """
    import pyarrow as pa

    v = pick(vectors, vec_id=id_col, label=label_col, e=vec_col)
    usable = F.col("label").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(usable, F.lit(False)))
    v = v.withColumn("k1", F.when(F.col("ok"), F.xxhash64("label", "e"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(seed), F.reverse("e"), "label")))
    classes = stored(v.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min(F.xxhash64("label", F.size("e"))).alias("lk")))
    reps = v.where("ok").join(classes, ["k1", "k2"]).where("vec_id = rep").dropDuplicates(["k1", "k2"])
    # Labels of more than the first size: at most vectors / that size of them.
    large = stored(classes.groupBy("lk").agg(F.count("*").alias("n")).where(F.col("n") >= FINENESS[1][0]))
    few = large.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    tier = sum((F.coalesce("n", F.lit(0)) >= least).cast("int") for least, _, _ in FINENESS[1:])
    kind_e = "array<float>" if v.schema["e"].dataType.simpleString() == "array<float>" else "array<double>"
    reps = reps.join(F.broadcast(large) if few else large, "lk", "left").select("rep", "copies", "lk", tier.alias("tier"), F.col("e").cast(kind_e).alias("e"))
    kind = reps.schema["rep"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            label, tier_ = (batch.column(c).to_numpy() for c in ("lk", "tier"))
            size = np.diff(batch.column("e").offsets.to_numpy())
            for dim, k in {*zip(size.tolist(), tier_.tolist(), strict=True)}:
                part = batch.filter(pa.array((size == dim) & (tier_ == k)))
                for at in range(0, part.num_rows, 1024):
                    rows = part.slice(at, 1024)
                    codes = cell_codes(unit_vectors(rows.column("e")), rows.column("lk").to_numpy(), k, probes, seed)
                    n, tables, width = codes.shape
                    who = pa.array(np.repeat(np.arange(n), tables * width))
                    yield pa.RecordBatch.from_arrays([rows.column("rep").take(who), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), width), n)), pa.array(codes.reshape(-1))], names=["rep", "t", "code"])

    seen = stored(reps.select("rep", "lk", "tier", "e").mapInArrow(place, f"rep {kind}, t int, code long"))
    full = seen.groupBy("t", "code").agg(F.count("*").alias("n")).where("n > 1")
    full = full.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    # Representatives with any shared cell, each with its cells.
    cells_of = seen.join(full, ["t", "code"]).groupBy("rep").agg(F.collect_list(F.struct("t", "code", "blocks")).alias("cells"))
    near = cells_of.join(reps, "rep").select("rep", "copies", "lk", "tier", "e", F.explode("cells").alias("c")).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("c.blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("c.blocks") - 1))
    near = near.withColumn("other", other).select(F.col("c.t").alias("t"), F.col("c.code").alias("code"), F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "rep", "copies", "lk", "tier", "e")
    near = near.repartition("t", "code", "lo", "hi").sortWithinPartitions("t", "code", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole cells."""
            rows = rows.combine_chunks()
            size = np.diff(rows.column("e").chunk(0).offsets.to_numpy())
            for dim in np.unique(size):
                yield same_length(rows if (size == dim).all() else rows.filter(pa.array(size == dim)).combine_chunks())

        def same_length(rows: pa.Table) -> pa.RecordBatch:
            t, code, lo, hi, blk, tier_, lk, mult = (rows.column(c).to_numpy() for c in ("t", "code", "lo", "hi", "blk", "tier", "lk", "copies"))
            rep, vec = rows.column("rep"), unit_vectors(rows.column("e").chunk(0))
            n = len(t)
            new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (t[1:] != t[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            i, j = linked_pairs(vec, new, np.diff(np.append(new, n)), blk, lo != hi, cosine)
            w = np.zeros(n)
            for k in np.unique(tier_[i]):
                a, b = i[tier_[i] == k], j[tier_[i] == k]
                who, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                codes = cell_codes(vec[who], lk[who], int(k), probes, seed)
                first = first_met(codes, t[who], code[who], at[: len(a)], at[len(a) :])
                w += np.bincount(a[first], mult[b[first]], n) + np.bincount(b[first], mult[a[first]], n)
            root = least_reachable(n, i, j)
            use = np.flatnonzero((w > 0) | (root != np.arange(n)))
            ids = rep.combine_chunks() if isinstance(rep, pa.ChunkedArray) else rep
            return pa.RecordBatch.from_arrays([ids.take(pa.array(use)), ids.take(pa.array(root[use])), pa.array(w[use].astype(np.int64))], names=["a", "b", "w"])

        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in (b for b in batches if b.num_rows):
            ids = np.stack([batch.column(c).to_numpy() for c in ("t", "code", "lo", "hi")], 1)
            ends = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            if rows >= 2 * BLOCK and tuple(ids[0].tolist()) != last:
                yield from settle(pa.Table.from_batches(held))
                held, rows = [], 0
            cut = int(ends[-1]) if len(ends) else 0
            if cut and rows + cut >= 2 * BLOCK:
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows, last = rows + batch.num_rows, tuple(ids[-1].tolist())
        if rows:
            yield from settle(pa.Table.from_batches(held))

    found = stored(near.mapInArrow(compare, f"a {kind}, b {kind}, w long"))
    links = found.groupBy("a").agg(F.sum("w").alias("w")).withColumnRenamed("a", "rep")
    comps = connected_components(found.where("a <> b").select("a", "b")).select(F.col("node").alias("rep"), "component")
    classes = classes.join(links, "rep", "left").join(comps, "rep", "left")
    classes = classes.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = v.select("vec_id", "k1", "k2").join(classes, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
