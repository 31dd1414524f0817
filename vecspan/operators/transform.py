"""Linear transforms that belong to an index: trained, kept, and applied to rows and queries alike."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.functions import distance
from vecspan.session import importable, work_dir

from . import ivf
from .topk import exact_knn, matrix


@dataclass
class Linear:
    """(x - mean) times a matrix of a row a component of the result, to ``digits`` decimals."""

    mean: np.ndarray
    rows: np.ndarray
    digits: int = 9

    def apply(self, df: DataFrame, vec_col: str = "embedding") -> DataFrame:
        """The table with its vectors transformed; those without a finite value in every place are left out. Map-only."""
        import pyarrow as pa

        importable(df.sparkSession)
        keep = [c for c in df.columns if c != vec_col]
        shared = df.sparkSession.sparkContext.broadcast((self.mean, self.rows, self.digits))
        size = len(self.rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, rows, digits = shared.value
            for batch in (b for b in batches if b.num_rows):
                out = np.round((matrix(batch.column(len(keep))) - mean) @ rows.T, digits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), lists], names=[*keep, vec_col])

        schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{vec_col}` array<double>"])
        return df.where(distance.finite(F.col(vec_col))).select(*keep, distance.doubles(F.col(vec_col)).alias(vec_col)).mapInArrow(run, schema)


def pca(base: DataFrame, size: int, id_col: str = "vec_id", vec_col: str = "embedding", sample: int | None = 1_000_000) -> Linear:
    """The ``size`` directions in which the vectors vary most, from a sample of about so many rows.

    Means and products of components are sums that each task makes for its batches; what leaves
    it is a row a component. The matrix of a direction's signs is fixed by its largest entry.
    """
    rows = ivf.sampled(base.where(distance.finite(F.col(vec_col))), sample, id_col, vec_col)
    first = rows.select(F.size(vec_col)).first()
    dim = first[0] if first else 0
    if not 0 < size <= dim:
        raise ValueError(f"{size} directions of {dim} components")

    def products(batch):
        x = matrix(batch.column(0))
        yield 1, np.zeros(len(x), np.int64), x
        for i in range(dim):
            yield 0, np.full(len(x), i), x * x[:, i : i + 1]

    found = ivf.cluster_means(rows.select(vec_col), products, dim, dim).collect()  # a row a component, and the mean
    mean, square = np.zeros(dim), np.zeros((dim, dim))
    for r in found:
        if r.part:
            mean = np.array(r.mean)
        else:
            square[r.cluster_id] = r.mean
    values, vectors = np.linalg.eigh(square - np.outer(mean, mean))
    top = vectors[:, np.argsort(-values, kind="stable")[:size]].T
    sign = np.sign(top[np.arange(size), np.abs(top).argmax(1)])
    return Linear(mean, top * sign[:, None])


def cosines(dim: int, size: int) -> Linear:
    """The first ``size`` directions of the orthonormal cosine transform, for vectors whose neighbouring components are alike."""
    i, j = np.arange(size)[:, None], np.arange(dim)[None, :]
    rows = np.cos(np.pi * i * (2 * j + 1) / (2 * dim)) * np.sqrt(2 / dim)
    rows[0] /= np.sqrt(2)
    return Linear(np.zeros(dim), rows)


@dataclass
class TransformedIndex:
    """An index of transformed vectors that takes queries as they are: inverted lists, or the transformed table itself.

    Distances are those of transformed vectors.
    """

    transform: Linear
    inner: object
    id_col: str = "vec_id"
    vec_col: str = "embedding"

    @staticmethod
    def build(base: DataFrame, transform: Linear, nlist: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", **how) -> TransformedIndex:
        path = work_dir(base.sparkSession, "transformed")
        transform.apply(base, vec_col).write.parquet(path)
        rows = base.sparkSession.read.parquet(path)
        inner = ivf.IvfIndex.build(rows, nlist, id_col=id_col, vec_col=vec_col, **how) if nlist else rows
        return TransformedIndex(transform, inner, id_col, vec_col)

    @property
    def rows(self) -> DataFrame:
        return self.inner.lists if isinstance(self.inner, ivf.IvfIndex) else self.inner

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, where: Column | str | None = None) -> DataFrame:
        """(qid, rank, id, dist); inverted lists need nprobe."""
        q = self.transform.apply(queries.select("qid", self.vec_col), self.vec_col)
        if isinstance(self.inner, ivf.IvfIndex):
            if nprobe is None:
                raise ValueError("a search of inverted lists needs nprobe")
            return self.inner.search(q, k, nprobe, where)
        return exact_knn(self.inner, q, k, where=where, id_col=self.id_col, vec_col=self.vec_col)

    def save(self, path: str) -> None:
        """The inner index or table, and the transform; a path that is taken is an error."""
        lists = isinstance(self.inner, ivf.IvfIndex)
        self.inner.save(f"{path}/index") if lists else self.inner.write.parquet(f"{path}/rows")
        t = self.transform
        about = json.dumps({"mean": t.mean.tolist(), "rows": t.rows.tolist(), "digits": t.digits, "lists": lists, "id_col": self.id_col, "vec_col": self.vec_col})
        self.rows.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/transform")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TransformedIndex:
        m = json.loads(spark.read.text(f"{path}/transform").first().value)
        inner = ivf.IvfIndex.load(spark, f"{path}/index") if m["lists"] else spark.read.parquet(f"{path}/rows")
        return TransformedIndex(Linear(np.array(m["mean"]), np.array(m["rows"]), m["digits"]), inner, m["id_col"], m["vec_col"])
