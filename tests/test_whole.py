"""Queries over whole tables and the stated query set: every id divisible by 100."""

import numpy as np
import pytest

from vecspan.operators import graph, topk
from vecspan.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def vectors(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    return np.array([r.embedding for r in rows], np.float64)


def test_farther_counts_whole(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)  # several blocks of queries
    v = vectors(spark)
    got = {(r.qid, r.vec_id): (r.farther, r["rank"]) for r in QUERIES["farther_count_rank"](spark, SF).collect()}
    assert {q for q, _ in got} == set(range(0, len(v), 100)) and len(got) == len(v) * -(-len(v) // 100)
    for q in range(0, len(v), 100):
        order = np.argsort(((v - v[q]) ** 2).sum(1), kind="stable")
        assert [got[q, int(i)] for i in order] == [(len(v) - 1 - at, at + 1) for at in range(len(v))]


def others(v, q, k):
    d = ((v - v[q]) ** 2).sum(1)
    return [int(i) for i in np.lexsort((np.arange(len(v)), d)) if i != q][:k]


def ten_recall(spark, name):
    v, got = vectors(spark), {}
    for r in QUERIES[name](spark, SF).collect():
        got.setdefault(r.qid, set()).add(r.vec_id)
    assert set(got) == set(range(0, len(v), 100))
    return np.mean([len(got[q] & set(others(v, q, 9))) / 9 for q in got])  # the tenth result is the own row


def test_trained_recall(spark):
    assert ten_recall(spark, "ivf_search_trained") >= 0.9
    rows = {(r["of"], r.r): r.recall for r in QUERIES["recall_trained"](spark, SF).collect()}
    assert set(rows) == {("1", 1), ("1", 10), ("1", 100), ("k", 10)} and rows["k", 10] >= 0.9
    assert rows["1", 1] <= rows["1", 10] <= rows["1", 100]


def test_beam_recall(spark):
    assert ten_recall(spark, "graph_beam_search") >= 0.9


def test_beam_goes_on(spark):
    """A line of 60 rows, whose far end is 59 edges from the first row."""
    base = spark.createDataFrame([(i, [float(i)]) for i in range(60)], "vec_id long, embedding array<float>")
    line = spark.createDataFrame([(i, j) for i in range(60) for j in (i - 1, i + 1) if 0 <= j < 60], "src long, dst long")
    q = base.where("vec_id = 59").selectExpr("vec_id AS qid", "embedding")
    found = graph.beam_search(line, base, q, 2, 4, starts=1).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [59, 58]


def test_stated_queries(spark, monkeypatch):
    """Blocks of queries too: with two a block there are three of them."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    assert not [n for n, q in ORACLES.items() if "vec_id < 20" in q or "vec_id < 5" in q]
    for name in ("exact_knn_l2", "exact_knn_l2_sql"):
        got = {(r.qid, r["rank"]): r.vec_id for r in QUERIES[name](spark, SF).collect()}
        v = vectors(spark)
        assert got == {(q, at + 1): i for q in range(0, len(v), 100) for at, i in enumerate([q, *others(v, q, 9)])}


def test_recall_of_the_searches(spark):
    assert ten_recall(spark, "ivf_search") >= 0.9
    rows = {(r.nprobe, r["of"], r.r): r.recall for r in QUERIES["ivf_nprobe_sweep_recall"](spark, SF).collect()}
    assert rows[16, "k", 10] == 1.0 and rows[12, "k", 10] >= 0.9
    assert min(r.recall for r in QUERIES["graph_beam_recall"](spark, SF).where("width > 11").collect()) >= 0.9
    found = {r.r: r.recall for r in QUERIES["ivf_pq_recall"](spark, SF).collect()}
    assert found[10] <= found[100] and found[100] >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_codes_and_filters(spark, sf):
    """Share of the nine nearest others that the searches of codes, cells and filtered lists find, at both sizes."""
    from vecspan.operators import evaluate
    from vecspan.operators.topk import exact_knn
    from vecspan.plans import catalogue, graphs, transforms  # noqa: F401  both add queries

    path = f"/root/testdata/{sf}"
    b = catalogue.base(spark, path)
    for name, where in (("pq_adc_search", None), ("ivf_pq_search", None), ("ivf_search_filtered", "label = 3"), ("graph_disk_search", None), ("multi_index_search", None)):
        truth = evaluate.others(exact_knn(b, catalogue.asked(b), 11, where=where), 9)
        found = evaluate.others(QUERIES[name](spark, path), 9)
        assert evaluate.mean_k_recall(found, truth, 9).first().recall >= 0.9, name


def test_concat_whole(spark):
    n = len(vectors(spark))
    assert sorted(map(tuple, QUERIES["vec_concat"](spark, SF).collect())) == [(i, 2) for i in range(n)]
