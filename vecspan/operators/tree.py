"""Balanced k-means trees: every level splits its cells into children of like size; a search visits leaves by a queue until it has checked enough rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.functions import distance
from vecspan.session import importable, work_dir

from . import ivf
from .topk import matrix, merge_topk

#: Centroids of a level that are sent to every task; a deeper tree is an error.
MOST_NODES = 65_536


def even_prices(dist: np.ndarray, levels: int = 8, inner: int = 12, sweeps: int = 15) -> np.ndarray:
    """Prices of children such that each gets as even a share as can be of the rows, which go where ``dist`` (rows, children) plus price is least.

    First soft shares at falling temperatures, where a child's price rises by the logarithm of
    what it has too much; then each child in turn gets the price at which just its share prefers it to
    all others. The prices with the most even sizes count.
    """
    m, branch = dist.shape
    even, prices = m / branch, np.zeros(branch)
    best: tuple = (np.inf, prices)

    def look(best: tuple) -> tuple:
        off = np.abs(np.bincount((dist + prices).argmin(1), minlength=branch) - even).max()
        return (off, prices.copy()) if off < best[0] else best

    heat = max(float(np.ptp(dist, axis=1).mean()), 1e-12)
    for _ in range(levels):
        for _ in range(inner):
            z = -(dist + prices) / heat
            share = np.exp(z - z.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            prices = prices + heat * np.log(np.maximum(share.sum(0), 1e-12) / even)
        best = look(best)
        heat /= 2.5
    prices = best[1].copy()
    at = min(max(round(even), 1), m - 1)
    for _ in range(sweeps if branch > 1 and m > 1 else 0):
        for c in range(branch):
            rest = dist + prices
            rest[:, c] = np.inf
            gain = np.sort(rest.min(1) - dist[:, c])[::-1]
            prices[c] = (gain[at - 1] + gain[at]) / 2
        best = look(best)
        if best[0] < 1:
            break
    return best[1]


def balanced_centroids(x: np.ndarray, branch: int, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, prices) of ``branch`` children: rounds of even shares and their means, from rows far from each other."""
    branch = min(branch, len(x))
    far, seeds = ((x - x.mean(0)) ** 2).sum(1), []
    for _ in range(branch):
        seeds.append(int(far.argmax()))
        gap = ((x - x[seeds[-1]]) ** 2).sum(1)
        far = gap if len(seeds) == 1 else np.minimum(far, gap)
    cents = x[seeds]

    def apart() -> np.ndarray:
        return (x * x).sum(1)[:, None] + (cents * cents).sum(1) - 2 * (x @ cents.T)

    for _ in range(rounds):
        dist = apart()
        child = (dist + even_prices(dist)).argmin(1)
        sums, sizes = np.zeros_like(cents), np.bincount(child, minlength=branch)
        np.add.at(sums, child, x)
        cents = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], cents)
    return cents, even_prices(apart())


@dataclass
class BalancedTree:
    """Tree nodes (level, node, centroid, price), node = parent * branch + child, and the rows (cluster_id, the leaf; id; vector)."""

    nodes: DataFrame
    lists: DataFrame
    branch: int
    depth: int
    id_col: str = "vec_id"
    vec_col: str = "embedding"

    @staticmethod
    def build(base: DataFrame, leaf: int = 1000, branch: int = 8, sample: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> BalancedTree:
        """A tree whose leaves have about ``leaf`` rows, at most ``leaf`` * branch / 2 on average.

        A level is trained on about ``sample`` rows of each of its cells by hash of the id, a
        cell a group, and then gives every row its child in a map-only pass. Leaves differ in
        size by what sampling errs, and by equal vectors, which can't be told apart.
        """
        rows = base.where(distance.finite(F.col(vec_col))).select(F.lit(0).cast("bigint").alias("cluster_id"), id_col, vec_col)
        n, depth = rows.count(), 0
        while n > leaf * branch**depth * branch**0.5:
            depth += 1
        if branch**depth > MOST_NODES:
            raise ValueError(f"a tree of over {MOST_NODES} leaves")
        spark, nodes = importable(base.sparkSession), None
        for level in range(depth):
            share = min(1.0, sample * branch**level / max(1, n))
            some = rows.where(F.pmod(F.xxhash64(F.lit(level), id_col), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows
            split = _split(some, branch, level, id_col, vec_col).collect()  # the level's nodes
            level_nodes = spark.createDataFrame(split, "level int, node bigint, centroid array<double>, price double")
            nodes = level_nodes if nodes is None else nodes.unionByName(level_nodes)
            path = work_dir(spark, "tree")
            _down(rows, split, branch, id_col, vec_col).write.parquet(path)
            rows = spark.read.parquet(path)
        if nodes is None:
            nodes = spark.createDataFrame([], "level int, node bigint, centroid array<double>, price double")
        return BalancedTree(nodes, rows, branch, depth, id_col, vec_col)

    def leaves(self) -> DataFrame:
        """(cluster_id, size)."""
        return self.lists.groupBy("cluster_id").agg(F.count("*").alias("size"))

    def visits(self, queries: DataFrame, max_check: int) -> DataFrame:
        """(qid, cluster_id, probe_rank, dist): the leaves that each query visits, in order, until they hold ``max_check`` rows. Map-only.

        A queue holds tree nodes by the distance to their centroids; the nearest is taken and,
        unless it is a leaf, replaced by its children.
        """
        import pyarrow as pa

        spark = importable(queries.sparkSession)
        sizes = {r.cluster_id: r["size"] for r in self.leaves().collect()}  # a row a leaf, MOST_NODES at most
        levels: dict[int, tuple] = {}
        for r in self.nodes.collect():
            levels.setdefault(r.level, ([], []))
            levels[r.level][0].append(r.node)
            levels[r.level][1].append(r.centroid)
        shared = spark.sparkContext.broadcast(({k: ({n: i for i, n in enumerate(v[0])}, np.array(v[1])) for k, v in levels.items()}, sizes))
        depth, branch = self.depth, self.branch
        rows = queries.where(distance.finite(F.col(self.vec_col))).select(F.col("qid").cast("bigint").alias("qid"), distance.doubles(F.col(self.vec_col)).alias("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import heapq

            tree, held = shared.value
            for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                out: list[tuple] = []
                for qid, q in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), strict=True):
                    heap, checked, rank = [(0.0, 0, 0)], 0, 0
                    while heap and checked < max_check:
                        d, level, node = heapq.heappop(heap)
                        if level == depth:
                            checked, rank = checked + held.get(node, 0), rank + 1
                            out.append((qid, node, rank, d))
                            continue
                        place, cents = tree[level]
                        for child in range(node * branch, (node + 1) * branch):
                            if child in place:
                                gap = q - cents[place[child]]
                                heapq.heappush(heap, (float(gap @ gap), level + 1, child))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["qid", "cluster_id", "probe_rank", "dist"])

        return rows.mapInArrow(run, "qid bigint, cluster_id bigint, probe_rank bigint, dist double")

    def search(self, queries: DataFrame, k: int, max_check: int) -> DataFrame:
        """(qid, rank, id, dist) among the rows of the visited leaves, by whole vectors."""
        visits = self.visits(queries, max_check)
        if ivf.few_probes(queries, visits):
            return merge_topk(ivf.cell_topk(self.lists, queries, visits, k, "l2_sq", self.id_col, self.vec_col), k, self.id_col)
        return merge_topk(ivf.candidates(self.lists, queries, visits, "l2_sq", self.id_col, self.vec_col), k, self.id_col)

    def entries(self, queries: DataFrame, each: int = 8, max_check: int = 64) -> DataFrame:
        """(qid, node): the ``each`` nearest rows of the first leaves, from which a graph search may start."""
        return self.search(queries, each, max_check).select("qid", F.col(self.id_col).alias("node"))

    def save(self, path: str) -> None:
        """Parquet tables, the rows partitioned by leaf, and a manifest, which is written last; a path that is taken is an error."""
        self.nodes.write.parquet(f"{path}/nodes")
        self.lists.repartitionByRange("cluster_id", self.id_col).sortWithinPartitions("cluster_id", self.id_col).write.partitionBy("cluster_id").parquet(f"{path}/lists")
        about = json.dumps({"branch": self.branch, "depth": self.depth, "id_col": self.id_col, "vec_col": self.vec_col})
        self.lists.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BalancedTree:
        m = json.loads(spark.read.text(f"{path}/manifest").first().value)
        lists = spark.read.parquet(f"{path}/lists").withColumn("cluster_id", F.col("cluster_id").cast("bigint"))
        return BalancedTree(spark.read.parquet(f"{path}/nodes"), lists, m["branch"], m["depth"], m["id_col"], m["vec_col"])


def _split(rows: DataFrame, branch: int, level: int, id_col: str, vec_col: str) -> DataFrame:
    """(level, node, centroid, price) of the children of every cell of sampled rows, a cell a group."""
    import pyarrow as pa

    def train(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        cents, prices = balanced_centroids(matrix(table.column("v").combine_chunks()), branch)
        first = table.column("cluster_id")[0].as_py() * branch
        return pa.table({
            "level": pa.array([level] * len(cents), pa.int32()), "node": pa.array([first + i for i in range(len(cents))], pa.int64()),
            "centroid": pa.array(cents.tolist(), pa.list_(pa.float64())), "price": pa.array(prices),
        })

    some = rows.select("cluster_id", F.col(id_col).alias("id"), distance.doubles(F.col(vec_col)).alias("v"))
    return some.groupBy("cluster_id").applyInArrow(train, "level int, node bigint, centroid array<double>, price double")


def _down(rows: DataFrame, nodes: list, branch: int, id_col: str, vec_col: str) -> DataFrame:
    """Rows in their cell's child of least squared distance plus price (ties: the lower child). Map-only."""
    import pyarrow as pa

    by: dict[int, list] = {}
    for r in sorted(nodes, key=lambda r: r.node):
        by.setdefault(r.node // branch, []).append(r)
    cells = {c: (np.array([r.node for r in x]), np.array([r.centroid for r in x]), np.array([r.price for r in x])) for c, x in by.items()}
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            cell, v = batch.column(0).to_numpy(), matrix(batch.column(2))
            out = np.zeros(len(cell), np.int64)
            for c in np.unique(cell):
                names, cents, prices = shared.value[int(c)]
                at = np.flatnonzero(cell == c)
                dist = (cents * cents).sum(1) - 2 * (v[at] @ cents.T) + prices
                out[at] = names[dist.argmin(1)]
            yield pa.RecordBatch.from_arrays([pa.array(out), batch.column(1), batch.column(2)], names=["cluster_id", id_col, vec_col])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("cluster_id", id_col, vec_col).mapInArrow(run, f"cluster_id bigint, `{id_col}` {kinds[id_col]}, `{vec_col}` {kinds[vec_col]}")
