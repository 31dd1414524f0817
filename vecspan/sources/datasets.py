"""Named data sets: base, queries and truth by one name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.functions import vectors

from .formats import read_vectors


@dataclass(frozen=True)
class Dataset:
    base: str
    queries: str
    learn: str | None = None
    truth: str | None = None
    rows: int | None = None


class Registry:
    """Data sets by name, read from one folder."""

    def __init__(self, root: str):
        self.root, self.known = root.rstrip("/"), {}

    def add(self, name: str, dataset: Dataset) -> Registry:
        self.known[name] = dataset
        return self

    def load(self, spark: SparkSession, name: str, part: str = "base", as_int: bool = False) -> DataFrame:
        """A part (base, queries, learn, truth); the base is cut to its first ``rows``. ``as_int`` truncates."""
        if name not in self.known:
            raise KeyError(f"unknown data set {name!r}; one of {', '.join(sorted(self.known))}")
        d = self.known[name]
        path = getattr(d, part)
        if path is None:
            raise KeyError(f"{name} has no {part}")
        df = read_vectors(spark, f"{self.root}/{path}", **({"count": d.rows} if part == "base" and d.rows else {}))
        return df.withColumn("embedding", vectors.cast_int(F.col("embedding"))) if as_int else df
