"""Balanced trees: even leaves, visits in order, searches and budgets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspan.operators import evaluate, graph, tree
from vecspan.operators.topk import exact_knn
from vecspan.session import work_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture(scope="module")
def queries(base):
    return base.where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def same(df):
    return sorted((r.qid, r["rank"], r.vec_id, r.dist) for r in df.collect())


def test_prices_even_out_sizes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (400, 5)), rng.normal(3, 1, (50, 5)), rng.normal(-4, 2, (50, 5))])
    cents, prices = tree.balanced_centroids(x, 5)
    dist = ((x[:, None] - cents) ** 2).sum(2) + prices
    sizes = np.bincount(dist.argmin(1), minlength=5)
    assert sizes.min() >= 90 and sizes.max() <= 110
    cents, _ = tree.balanced_centroids(np.zeros((3, 2)), 8)
    assert len(cents) == 3 and not cents.any()


def test_leaves_and_visits(spark, base, queries):
    t = tree.BalancedTree.build(base, 20, 3)
    sizes = {r.cluster_id: r["size"] for r in t.leaves().collect()}
    assert sum(sizes.values()) == 500 and max(sizes.values()) <= 2 * min(sizes.values()) and len(sizes) == 27
    found: dict = {}
    for r in t.visits(queries, 100).orderBy("qid", "probe_rank").collect():
        found.setdefault(r.qid, []).append((r.cluster_id, r.dist))
    nodes = {(r.level, r.node): np.array(r.centroid) for r in t.nodes.collect()}
    for q in queries.collect():
        v, got = np.array(q.embedding, float), found[q.qid]
        assert len(set(got)) == len(got) and sum(sizes[c] for c, _ in got[:-1]) < 100 <= sum(sizes[c] for c, _ in got)
        assert all(abs(d - ((v - nodes[t.depth - 1, c]) ** 2).sum()) < 1e-9 for c, d in got)
        # Best first by hand: the queue's order of leaves.
        queue, order = [(0.0, 0, 0)], []
        while queue and len(order) < len(got):
            queue.sort()
            _, level, node = queue.pop(0)
            if level == t.depth:
                order.append(node)
                continue
            queue += [(float(((v - nodes[level, c]) ** 2).sum()), level + 1, c) for c in range(node * 3, node * 3 + 3)]
        assert order == [c for c, _ in got]


def test_search(spark, base, queries, monkeypatch):
    t = tree.BalancedTree.build(base, 20, 3)
    assert same(t.search(queries, 5, 10_000)) == same(exact_knn(base, queries, 5))
    some = same(t.search(queries, 5, 120))
    monkeypatch.setattr(tree.ivf, "MOST_QUERIES", 1)
    assert same(t.search(queries, 5, 120)) == some
    path = work_dir(spark, "tree")
    t.save(path)
    assert same(tree.BalancedTree.load(spark, path).search(queries, 5, 120)) == some
    truth = evaluate.others(exact_knn(base, queries, 11), 10)
    recall = [evaluate.mean_k_recall(evaluate.others(t.search(queries, 11, c), 10), truth, 10).first().recall for c in (60, 200, 500)]
    assert recall[0] < recall[1] <= recall[2] == 1.0
    edges = graph.both_ways(graph.knn_graph(base, 6))
    out = evaluate.others(graph.beam_search(edges, base, queries, 11, 32, entry=t.entries(queries)), 10)
    assert evaluate.mean_k_recall(out, truth, 10).first().recall > 0.9


def test_odd_tables(spark, base, queries):
    """Equal vectors stay together, tables smaller than a leaf have one, odd vectors are left out."""
    same_rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(90)] + [(100 + i, [float(i), -float(i)]) for i in range(60)], "vec_id long, embedding array<float>")
    t = tree.BalancedTree.build(same_rows, 10, 4)
    assert t.leaves().agg(F.sum("size")).first()[0] == 150
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [float("inf"), 0.0])], "qid long, embedding array<float>")
    assert [(r.qid, r.vec_id) for r in t.search(q, 2, 30).orderBy("rank").collect()] == [(1, 0), (1, 1)]
    one = tree.BalancedTree.build(base, 1000, 4)
    assert one.depth == 0 and same(one.search(queries, 3, 1)) == same(exact_knn(base, queries, 3))
    none = tree.BalancedTree.build(base.limit(0), 10, 4)
    assert none.search(queries, 3, 10).collect() == [] and t.search(q.limit(0), 3, 10).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [float("nan"), 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in tree.BalancedTree.build(odd, 10, 4).lists.collect()] == [3]
