"""The inverted multi-index: lists for pairs of entries of two half codebooks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspan.functions import distance
from vecspan.session import importable

from . import ivf, pq
from .topk import matrix, merge_topk


def nearest_pairs(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[float, int, int]]:
    """(a[i] + b[j], i, j) in rising order, ties by i, then j: the multi-sequence walk.

    Both sides are sorted once; a pair is a candidate once its left and upper neighbours in
    that order have been visited, so that a heap holds a staircase of candidates and not the product.
    """
    import heapq

    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[by_a], b[by_b]
    n, m = len(sa), len(sb)
    if not n or not m:
        return
    heap = [(sa[0] + sb[0], int(by_a[0]), int(by_b[0]), 0, 0)]
    # How far each row of the staircase has come; a row opens when the one before has passed its first place.
    while heap and most > 0:
        d, i, j, x, y = heapq.heappop(heap)
        yield float(d), i, j
        most -= 1
        if y + 1 < m:
            heapq.heappush(heap, (sa[x] + sb[y + 1], int(by_a[x]), int(by_b[y + 1]), x, y + 1))
        if y == 0 and x + 1 < n:
            heapq.heappush(heap, (sa[x + 1] + sb[0], int(by_a[x + 1]), int(by_b[0]), x + 1, 0))


@dataclass
class MultiIndex:
    """(cell, id, vector) rows, cell = first code * codes + second code, and the two codebooks."""

    codebook: DataFrame
    lists: DataFrame
    codes: int
    id_col: str = "vec_id"
    vec_col: str = "embedding"

    @staticmethod
    def build(base: DataFrame, codes: int = 256, iterations: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", codebook: DataFrame | None = None) -> MultiIndex:
        """Each row in the cell of its halves' nearest entries. codes * codes cells from two books of ``codes``; vectors have an even number of components."""
        from vecspan.functions.vectors import dimension

        book = codebook if codebook is not None else pq.train_codebook(base, 2, dimension(base, vec_col), codes, iterations, id_col, vec_col)
        rows = pq.encode_rows(base.withColumn("__v", F.col(vec_col)), book, [id_col, "__v"], vec_col)
        lists = rows.select((F.col("codes")[0].cast("bigint") * codes + F.col("codes")[1]).alias("cell"), id_col, F.col("__v").alias(vec_col))
        return MultiIndex(book, lists, codes, id_col, vec_col)

    def cells(self, queries: DataFrame, most: int) -> DataFrame:
        """(qid, rank, cell, dist): the ``most`` nearest cells of each query, by the sum of the halves' distances. Map-only."""
        import pyarrow as pa

        spark = importable(queries.sparkSession)
        shared = spark.sparkContext.broadcast(pq.book_array(self.codebook))
        codes = self.codes
        rows = queries.where(distance.finite(F.col(self.vec_col))).select(F.col("qid").cast("bigint").alias("qid"), distance.doubles(F.col(self.vec_col)).alias("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book, names = shared.value
            for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
                out: list[tuple] = []
                for qid, q in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), strict=True):
                    halves = [distance.exact(np.repeat(h[None], len(e), 0), e, "l2_sq") for h, e in zip(q.reshape(2, -1), book, strict=True)]
                    out += [(qid, r + 1, int(names[0][i]) * codes + int(names[1][j]), d) for r, (d, i, j) in enumerate(nearest_pairs(*halves, most))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["qid", "rank", "cell", "dist"])

        return rows.mapInArrow(run, "qid bigint, rank bigint, cell bigint, dist double")

    def search(self, queries: DataFrame, k: int, cells: int) -> DataFrame:
        """(qid, rank, id, dist) among the rows of each query's ``cells`` nearest cells, by whole vectors."""
        probes = self.cells(queries, cells).select("qid", F.col("cell").alias("cluster_id"), F.col("rank").alias("probe_rank"))
        lists = self.lists.withColumnRenamed("cell", "cluster_id")
        if ivf.few_probes(queries, probes):
            return merge_topk(ivf.cell_topk(lists, queries, probes, k, "l2_sq", self.id_col, self.vec_col), k, self.id_col)
        return merge_topk(ivf.candidates(lists, queries, probes, "l2_sq", self.id_col, self.vec_col), k, self.id_col)
