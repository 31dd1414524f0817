"""What a graph's build and the steps of its search hold and compute, against plain forms of them."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vecspan.operators import proximity


def plain_pruning(dist, vec, degree, alpha):
    kept = np.zeros(dist.shape, bool)
    for row in range(len(dist)):
        left = [j for j in range(dist.shape[1]) if np.isfinite(dist[row, j])]
        while left and kept[row].sum() < degree:
            p = left.pop(0)
            kept[row, p] = True
            left = [j for j in left if alpha * alpha * ((vec[row, j] - vec[row, p]) ** 2).sum() > dist[row, j]]
    return kept


def test_pruning_in_single_precision_decides_as_double_does():
    """Also for equal candidates, distances that are just even, and vectors too large, too small or too far off for single precision."""
    rng = np.random.default_rng(3)
    for scale, shift in ((1.0, 0.0), (2.0**-83, 0.0), (2.0**83, 0.0), (1.0, 1e6)):
        for whole in (False, True):
            vec = rng.integers(-2, 3, (40, 30, 4)) * scale if whole else rng.normal(size=(40, 30, 4)) * scale
            vec[:, 7] = vec[:, 3]
            dist = (vec * vec).sum(2)
            by = np.argsort(dist, 1, kind="stable")
            dist, vec = np.take_along_axis(dist, by, 1), vec[np.arange(40)[:, None], by] + shift
            dist[5:9, 20:] = np.inf
            for alpha in (1.0, 1.2):
                assert (proximity.kept_by_pruning(dist, vec, 6, alpha) == plain_pruning(dist, vec, 6, alpha)).all()


def test_pruning_holds_few_rows_candidates():
    rng = np.random.default_rng(1)
    x, cand = rng.normal(size=(2000, 64)), rng.integers(0, 2000, (256, 300))
    tracemalloc.start()
    try:
        proximity.pruned_links(x, np.arange(256), cand, 8, 200, 1.2)
        assert tracemalloc.get_traced_memory()[1] < 32 << 20  # the vectors of all candidates are 39 MB
    finally:
        tracemalloc.stop()


def test_shards_are_spread(spark):
    """A task for about every shard, however few bytes they are."""
    rows = spark.range(600).select((F.col("id") % 20).alias("shard"), F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.rand(1).cast("float") + i).alias("embedding"))
    found = proximity.shard_graphs(rows, 4, 8, 20, 1.2, parts=40)
    assert found.count() == 600
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 10


def test_a_step_of_a_beam():
    """New nodes enter by distance, then by number; what was asked for is done, also where it is gone."""
    none = np.zeros(0)
    beam = proximity.Beam(4, 2, np.array([5, 3, 9]), np.array([1.0, 2.0, 3.0]), np.array([False, False, False]), np.array([9, 5, 3]), none.astype(np.int64), none)
    assert beam.want().tolist() == [5, 3]
    beam.take(np.array([5]), np.array([0.5]), np.array([3, 8, 2, 8]), np.array([2.0, 1.5, 1.5, 1.5]))
    assert (beam.nodes.tolist(), beam.dist.tolist(), beam.done.tolist()) == ([5, 2, 8, 3], [1.0, 1.5, 1.5, 2.0], [True, False, False, True])
    assert beam.seen.tolist() == [2, 3, 5, 8, 9] and beam.near.tolist() == [5] and beam.near_dist.tolist() == [0.5]
    beam.take(np.array([8, 2]), np.array([0.4, 0.3]), np.array([], np.int64), none)
    assert beam.want().tolist() == [] and beam.near.tolist() == [5, 2, 8] and beam.near_dist.tolist() == [0.5, 0.3, 0.4]


def test_distances_to_codes():
    rng = np.random.default_rng(2)
    book, q = rng.normal(size=(4, 16, 3)), rng.normal(size=(5, 12))
    rows, codes = rng.integers(0, 5, 3000), rng.integers(0, 16, (3000, 4))
    got = proximity.steered(book, q, rows, codes)
    want = [sum(((q[r, 3 * p : 3 * p + 3] - book[p, c[p]]) ** 2).sum() for p in range(4)) for r, c in zip(rows, codes, strict=True)]
    assert np.allclose(got, want, rtol=1e-12)
    assert len(proximity.steered(book, q, rows[:0], codes[:0])) == 0


def test_a_node_is_linked_anew():
    """Candidates given twice count once, lists are pruned as by hand, a bare node loses its list, others keep theirs; batches may end anywhere."""
    rng = np.random.default_rng(4)
    v, code = rng.normal(size=(40, 3)).astype(np.float32), rng.integers(0, 9, (40, 2)).astype(np.int32)
    names = ["kind", "dst", "bucket", "node", "v", "code", "neighbours", "codes"]
    cand = {0: rng.integers(1, 40, 60), 1: np.array([5, 4, 5]), 3: np.arange(4, 30), 77: np.array([1, 2])}
    rows = [(0, None, 7, n, v[n].tolist(), code[n].tolist(), [n + 1], code[n + 1].tolist()) for n in range(5)]
    rows += [(2, int(d), 7, n, v[d].tolist(), code[d].tolist(), None, None) for n, c in cand.items() for d in c]
    rows += [(1, None, 7, n, None, None, None, None) for n in (1, 2)]
    rows.sort(key=lambda r: (r[3], r[0]))
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    whole = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    for size in (1, 2, 7, 1000):
        tables = list(proximity._whole_groups(iter(whole.to_batches(max_chunksize=size)), "node"))
        assert sum(t.num_rows for t in tables) == len(rows)
        found = [r for t in tables for r in proximity.relinked(t, 4, 1.2).to_pylist()]
        assert sorted(r["node"] for r in found) == list(range(5))
        for r in found:
            n = r["node"]
            assert r["v"] == v[n].tolist() and r["code"] == code[n].tolist() and r["bucket"] == 7
            if n in cand:
                c = np.unique(cand[n])
                d = ((v[c].astype(float) - v[n]) ** 2).sum(1)
                c = c[np.lexsort((c, d))]
                keep = plain_pruning(np.sort(d)[None], (v[c].astype(float) - v[n])[None], 4, 1.2)[0] if len(c) > 4 else np.ones(len(c), bool)
                assert r["neighbours"] == c[keep].tolist()
            else:
                assert r["neighbours"] == ([] if n == 2 else [n + 1])
            assert r["codes"] == code[r["neighbours"]].ravel().tolist()


def test_an_insert_spreads_its_shards(spark, monkeypatch):
    """Graphs of new rows are a task for about each shard; a large frontier gives the same graph."""
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    gone = base.where("vec_id % 10 = 3")
    g = proximity.ProximityGraph.build(base, degree=8, width=16).delete(gone.select("vec_id"))
    want = sorted((r.node, r.neighbours, r.codes) for r in g.insert(gone).nodes.collect())
    parts, make = [], proximity.shard_graphs
    monkeypatch.setattr(proximity, "shard_graphs", lambda *a, **k: parts.append(k.get("parts")) or make(*a, **k))
    monkeypatch.setattr(proximity, "MOST_FRONTIER", 10)
    again = g.insert(gone)
    assert parts == [2]
    assert sorted((r.node, r.neighbours, r.codes) for r in again.nodes.collect()) == want
