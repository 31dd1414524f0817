"""Pruned proximity graphs: pruning by hand, recall, caches, saved graphs, repair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspan.operators import evaluate, proximity
from vecspan.operators.topk import exact_knn
from vecspan.session import work_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture(scope="module")
def queries(base):
    """Every second row: enough of them to tell recalls 0.02 apart."""
    return base.where("vec_id % 2 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@pytest.fixture(scope="module")
def graph(base):
    return proximity.ProximityGraph.build(base, degree=12, width=24, budget=150 * (16 * 64 + 16 * 12 + proximity.BLOCK))


def recall(g, rows, queries, width=40):
    truth = evaluate.others(exact_knn(rows, queries, 11), 10)
    return evaluate.mean_k_recall(evaluate.others(g.search(queries, 11, width, 8), 10), truth, 10).first().recall


def sound(g, degree):
    rows = {r.node: list(r.neighbours) for r in g.nodes.collect()}
    assert all(len(n) == len(set(n)) <= degree and node not in n and set(n) <= set(rows) for node, n in rows.items())
    code = {r.node: list(r.code) for r in g.nodes.collect()}
    assert all(r.codes == [c for n in r.neighbours for c in code[n]] for r in g.nodes.collect())
    return rows


def test_pruning_by_hand():
    """On a line: a candidate behind a kept one goes, one on the other side stays."""
    x = np.array([[0.0], [1.0], [2.0], [-3.0], [1.0], [10.0]])
    own, cand = np.array([0]), np.array([[1, 2, 3, 4, 5, -1, 0, 1]])
    assert proximity.pruned_links(x, own, cand, 4, 10, 1.0).tolist() == [[1, 3, -1, -1]]
    # With slack 1.2 only what is over 1.2 times nearer to a kept one goes: 10 is 9 from 1, within 1.2 of its own 10.
    assert proximity.pruned_links(x, own, cand, 4, 10, 1.2).tolist() == [[1, 3, 5, -1]]
    assert proximity.pruned_links(x, own, cand, 1, 10, 1.2).tolist() == [[1]]
    assert proximity.pruned_links(x, own, np.full((1, 2), -1), 2, 10, 1.2).tolist() == [[-1, -1]]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    got = proximity.pruned_links(x, np.arange(60), np.tile(np.arange(60), (60, 1)), 8, 30, 1.3)
    for i in range(60):
        d = ((x - x[i]) ** 2).sum(1)
        left, kept = [j for j in np.argsort(d, kind="stable") if j != i][:30], []
        while left and len(kept) < 8:
            p = left.pop(0)
            kept.append(p)
            left = [j for j in left if 1.69 * ((x[j] - x[p]) ** 2).sum() > d[j]]
        assert [j for j in got[i] if j >= 0] == kept


def test_shards_of_one_task():
    for n in (1, 2, 5, 40, 700):
        x = np.random.default_rng(n).normal(size=(n, 8))
        links, medoid = proximity.shard_links(x, 8, 16, 50, 1.2)
        assert medoid == ((x - x.mean(0)) ** 2).sum(1).argmin() and len(links) == n
        seen, todo = {medoid}, [medoid]
        while todo:
            todo = [j for i in todo for j in links[i] if j >= 0 and j not in seen and not seen.add(j)]
        assert len(seen) == n
    same, _ = proximity.shard_links(np.zeros((50, 4)), 8, 16, 50, 1.2)
    assert (same >= -1).all()


def test_links_that_merging_keeps_reach_all(base):
    """The first places of a shard's lists reach every row; so does the merged graph of many small shards from its starts."""
    for n, first in ((2, 1), (5, 2), (9, 1), (300, 1), (300, 2), (300, 4)):
        x = np.random.default_rng(n).normal(size=(n, 8))
        links, medoid = proximity.shard_links(x, 8, 16, 50, 1.2, first)
        assert len(in_reach({i: [j for j in row[:first] if j >= 0] for i, row in enumerate(links.tolist())}, {medoid})) == n
    g = proximity.ProximityGraph.build(base, degree=4, width=8, budget=150 * (16 * 64 + 16 * 4 + proximity.BLOCK))
    rows = sound(g, 4)
    assert len(in_reach(rows, {r.node for r in g.entries.collect()})) == len(rows) == 500


def in_reach(rows, starts):
    seen, todo = set(starts), list(starts)
    while todo:
        todo = [j for i in todo for j in rows[i] if j not in seen and not seen.add(j)]
    return seen


def test_budgets(spark, base):
    """No shard over the budget, though a third of the rows are equal; every row in two shards, or one where the table fits."""
    same = base.where("vec_id = 1").crossJoin(spark.range(250)).select((F.col("id") + 1000).alias("vec_id"), "embedding", "label")
    rows = base.unionByName(same)
    shards, cents = proximity.budgeted_shards(rows, 80_000, 1000)
    sizes = shards.groupBy("shard").count()
    assert sizes.agg(F.max("count")).first()[0] <= 80 and shards.groupBy("vec_id").count().where("count <> 2").isEmpty()
    assert shards.select("vec_id").distinct().count() == 750 and cents.count() > 10
    one, cents = proximity.budgeted_shards(base, 10**9, 1000)
    assert one.count() == 500 and one.select("shard").distinct().count() == 1 and cents.count() == 1
    with pytest.raises(ValueError):
        proximity.budgeted_shards(base, 1000, 1000)


def test_search(spark, base, queries, graph):
    assert graph.stats["shards"] > 3
    sound(graph, 12)
    assert recall(graph, base, queries) >= 0.95
    want = sorted(map(tuple, graph.search(queries, 10, 24, 4).collect()))
    exact = {(r.qid, r.vec_id): r.dist for r in exact_knn(base, queries, 500).collect()}
    assert all(exact[q, v] == d for q, _, v, d in want)
    steps, read = graph.stats["steps"], graph.stats["vectors_read"]
    assert read < 0.2 * graph.stats["code_distances"]
    cached = graph.with_cache(120)
    assert 0 < cached.stats["cached"] <= 120
    path = work_dir(spark, "graph")
    cached.save(path)
    loaded = proximity.ProximityGraph.load(spark, path)
    for one in (cached, loaded):
        assert sorted(map(tuple, one.search(queries, 10, 24, 4).collect())) == want
        assert one.stats["steps"] <= steps and one.stats["vectors_read"] == read
    whole = graph.with_cache(10_000)
    assert sorted(map(tuple, whole.search(queries, 10, 24, 4).collect())) == want and whole.stats["steps"] == 0
    none = graph.with_cache(1)
    assert none.cache is None and none.stats["cached"] == 0
    before, proximity.MOST_FRONTIER = proximity.MOST_FRONTIER, 0
    try:
        assert sorted(map(tuple, graph.search(queries, 10, 24, 4).collect())) == want
    finally:
        proximity.MOST_FRONTIER = before
    odd = spark.createDataFrame([(1, None), (2, [float("nan")] * 64)], "qid long, embedding array<float>")
    assert graph.search(odd, 3).collect() == [] and graph.search(queries.limit(0), 3).collect() == []


def test_updates(spark, base, queries, graph):
    """Rows that go are nobody's neighbours, rows that come are found; recall is within 0.02 of a graph made anew."""
    budget = 150 * (16 * 64 + 16 * 12 + proximity.BLOCK)

    def anew(rows, asked=queries):
        return recall(proximity.ProximityGraph.build(rows, degree=12, width=24, budget=budget), rows, asked) - 0.02

    before = {r.node: list(r.neighbours) for r in graph.nodes.collect()}
    gone = base.where("vec_id % 10 = 3")
    dead = {r.vec_id for r in gone.collect()}
    g = graph.delete(gone.select("vec_id"))
    after = sound(g, 12)
    assert set(after) == set(before) - dead
    assert all(after[n] == before[n] for n in after if not set(before[n]) & dead)
    assert all(set(before[n]) - dead <= set(after[n]) for n in after if len((set(before[n]) - dead) | {y for x in set(before[n]) & dead for y in before[x]} - dead - {n}) <= 12)
    live = base.where("vec_id % 10 <> 3")
    assert recall(g, live, queries) >= anew(live)
    g = g.insert(gone)
    assert set(sound(g, 12)) == set(before) and recall(g, base, queries) >= recall(graph, base, queries) - 0.02
    starts = {r.node for r in graph.entries.collect()}
    g = graph.delete(spark.createDataFrame([(n,) for n in starts] + [(None,), (99_999,)], "id long"))
    assert not {r.node for r in g.entries.collect()} & starts and set(sound(g, 12)) == set(before) - starts
    left, asked = base.where(~F.col("vec_id").isin(sorted(starts))), queries.where(~F.col("qid").isin(sorted(starts)))
    assert recall(g, left, asked) >= anew(left, asked)
