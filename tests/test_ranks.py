"""Ranks of all rows for each query, without a stored or shuffled row a pair."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import differences

from vecspan.functions import distance
from vecspan.operators import ranks
from vecspan.plans.catalogue import ORACLES, QUERIES


def test_pairs_are_not_stored(spark):
    before = set(os.listdir(checkpoints(spark)))
    found = QUERIES["farther_count_rank"](spark, "/root/testdata/sf0.1")
    assert found.count() == 2000 * 20
    new = [os.path.join(checkpoints(spark), x) for x in set(os.listdir(checkpoints(spark))) - before]
    rows = sum(pq.read_metadata(os.path.join(at, f)).num_rows for d in new for at, _, files in os.walk(d) for f in files if f.endswith(".parquet"))
    assert 0 < rows < 2000  # blocks of the base, where there was a row a pair
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan[: plan.index("CartesianProduct")]


def checkpoints(spark):
    path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path.removeprefix("file:")


@pytest.mark.parametrize(("cell", "block", "numbered"), [(1 << 23, 4096, 65_536), (1500, 50, 2), (90, 7, 65_536)])
def test_ties_and_ids_as_in_sql(spark, tmp_path, monkeypatch, cell, block, numbered):
    """Ties over many rows, a missing id and ids that repeat; queries alone in a task, in groups, and in ranges."""
    monkeypatch.setattr(ranks, "RANK_CELL", cell)
    monkeypatch.setattr(ranks, "RANK_BLOCK", block)
    monkeypatch.setattr(ranks, "NUMBERED", numbered)
    ids = [*range(400), None, 7, 7, 200, None]
    vectors = [[float(i * p % 5) for p in (1, 2, 7)] for i in range(400)] + [[1.0, 2.0, 2.0]] * 5
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    assert differences(spark, str(tmp_path), QUERIES["farther_count_rank"], ORACLES["farther_count_rank"]) == []


@pytest.mark.parametrize("cell", [1 << 23, 40])
@pytest.mark.parametrize("metric", distance.METRICS)
def test_odd_vectors(spark, monkeypatch, metric, cell):
    """Lengths that differ, missing and infinite components, zero vectors."""
    monkeypatch.setattr(ranks, "RANK_CELL", cell)
    v = [[float(i * p % 11 - 4) for p in (2, 3, 5)] for i in range(90)] + [[0.0] * 3, [1.0], [-2.0], None, [1.0, None, 2.0], [float("nan")] * 3, [float("inf"), 0.0, 0.0]]
    rows = spark.createDataFrame(list(enumerate(v)), "id long, w array<double>").repartition(5)
    queries = rows.where("id % 15 = 0 or id > 88").withColumnRenamed("id", "qid")
    got = sorted(map(tuple, ranks.farther_count(rows, queries, metric, "id", "w").collect()))
    ok = [i for i in range(len(v)) if v[i] and all(x is not None and np.isfinite(x) for x in v[i])]
    want = []
    for q in (i for i in ok if i % 15 == 0 or i > 88):
        near = [(float(distance.exact(np.array([v[q]]), np.array([v[i]]), metric)[0]), i) for i in ok if len(v[i]) == len(v[q])]
        near = sorted(x for x in near if x[0] == x[0])
        want += [(q, i, sum(o > d for o, _ in near), at + 1) for at, (d, i) in enumerate(near)]
    assert got == sorted(want)


def test_nothing_to_rank(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<float>")
    asked = rows.withColumnRenamed("vec_id", "qid")
    for base, queries in ((rows, asked.limit(0)), (rows.limit(0), asked), (rows, asked.where("qid = 2"))):
        assert ranks.farther_count(base, queries).collect() == []


@pytest.mark.parametrize("columns", [1, 2, 3, 1024, 1025, 2050])
@pytest.mark.parametrize("metric", distance.METRICS)
def test_every_distance_to_the_last_bit(metric, columns):
    rng = np.random.default_rng(columns)
    x, y = rng.normal(size=(3, 37)), rng.normal(size=(columns, 37))
    got = distance.every(x, y.T, metric)
    for i in range(3):
        assert got[i].tolist() == distance.exact(np.tile(x[i], (columns, 1)), y, metric).tolist()


def test_groups_are_full(spark, monkeypatch):
    monkeypatch.setattr(ranks, "NUMBERED", 40)
    asked = spark.range(100).selectExpr("id AS qid").unionByName(spark.range(3).selectExpr("id AS qid"))
    numbered, groups = ranks._numbered(asked, 100, 8)
    sizes = {}
    for r in numbered.collect():
        sizes.setdefault(r.group, set()).add(r.qid)
    assert set(sizes) == set(range(groups)) and max(map(len, sizes.values())) <= 8
    assert sum(map(len, sizes.values())) == 100 and groups <= 13 + 3
