"""Collections of keyed vectors: create, insert, index, search, drop."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.functions.vectors import checked
from vecspan.operators import ivf
from vecspan.operators.topk import exact_knn, merge_topk

from .commits import CommitLog, Conflict


_EMPTY = {"folders": [], "index": None, "covers": []}


def fold(state: dict, commit: dict, version: int) -> dict:
    """The state after a commit: the folders of rows, the index's, and which folders it covers."""
    gone = set(commit.get("remove", ()))
    folders = [f for f in state["folders"] if f not in gone] + list(commit.get("add", ()))
    return {"folders": folders, "index": commit.get("index", state["index"]), "covers": commit.get("covers", state["covers"])}


@dataclass
class Collection:
    """A table of an integer key and a vector of one dimension, with an optional index.

    Every insert is a folder of its own that a commit makes visible; an index covers the folders
    that were there when it was made, and searches find what came later by an exact search of
    those rows. Flushes and indexes are commits too, so that readers see one or the other whole.
    """

    spark: SparkSession
    root: str
    name: str
    id_field: str
    vector_field: str
    dim: int
    ttl_seconds: int | None = None
    _loaded: object = field(default=None, repr=False, compare=False)

    @property
    def _log(self) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/{self.name}/log")

    def _state(self) -> tuple[int, dict]:
        return self._log.state(fold, _EMPTY)

    def _fresh(self, what: str) -> str:
        return f"{self.root}/{self.name}/{what}-{uuid.uuid4().hex}"

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*folders)

    def _alive(self) -> Column:
        """Rows whose time to live, counted from their insertion, hasn't run out."""
        if self.ttl_seconds is None:
            return F.lit(True)
        return F.col("__inserted") > F.current_timestamp() - F.expr(f"INTERVAL {int(self.ttl_seconds)} SECONDS")

    def insert(self, rows: DataFrame) -> None:
        """Append rows; a vector of another dimension is an error. Batches of any size, any number of writers."""
        out = rows.select(F.col(self.id_field).cast("bigint"), checked(F.col(self.vector_field).cast("array<float>"), self.dim).alias(self.vector_field), *[c for c in rows.columns if c not in (self.id_field, self.vector_field)])
        at = self._fresh("rows")
        out.withColumn("__inserted", F.current_timestamp()).write.parquet(at)
        self._log.commit({"kind": "insert", "add": [at]}, self._log.version(), lambda others: None)

    def rows(self) -> DataFrame:
        return self._read(self._state()[1]["folders"]).where(self._alive()).drop("__inserted")

    def count(self) -> int:
        return self.rows().count()

    def create_index(self, nlist: int, iterations: int = 10) -> None:
        """An index of the rows that are there now, under a name of its own; searches then use it."""
        read, state = self._state()
        index = ivf.IvfIndex.build(self._read(state["folders"]), nlist, iterations, id_col=self.id_field, vec_col=self.vector_field)
        at = self._fresh("index")
        index.save(at)
        self._log.commit({"kind": "index", "index": at, "covers": state["folders"]}, read, _unless_moved)

    def has_index(self) -> bool:
        return self._state()[1]["index"] is not None

    def drop_index(self) -> None:
        """Searches with nprobe are an error until an index is created again; rows stay."""
        self._log.commit({"kind": "drop", "index": None, "covers": []}, self._log.version(), lambda others: None)
        self.release()

    def flush(self) -> int:
        """Rewrite the rows that many small inserts have left as files of a good size; the rows there are afterwards.

        What the index covers and what it doesn't stay apart. Rows whose time has run out go.
        """
        read, state = self._state()
        parts = [[f for f in state["folders"] if f in state["covers"]], [f for f in state["folders"] if f not in state["covers"]]]
        new = []
        for folders in parts:
            if folders:
                rows, at = self._read(folders).where(self._alive()), self._fresh("rows")
                rows.repartitionByRange(max(1, -(-rows.count() // 1_000_000)), self.id_field).write.parquet(at)
                new.append(at)
        covers = new[:1] if parts[0] else []
        self._log.commit({"kind": "flush", "remove": state["folders"], "add": new, "covers": covers}, read, _unless_moved)
        return self.count()

    def load(self) -> Collection:
        """Keep the index's lists, or without an index the rows, in the executors' memory and disks until ``release``.

        What is inserted later isn't loaded but found all the same.
        """
        self.release()
        _, state = self._state()
        if state["index"] is not None:
            index = self.index()
            index.lists = index.lists.persist()
            self._loaded = (state["index"], index)
        else:
            self._loaded = (tuple(state["folders"]), self._read(state["folders"]).persist())
        return self

    def release(self) -> None:
        if self._loaded is not None:
            getattr(self._loaded[1], "lists", self._loaded[1]).unpersist()
            self._loaded = None

    def index(self) -> ivf.IvfIndex:
        at = self._state()[1]["index"]
        if at is None:
            raise KeyError(f"{self.name} has no index")
        if self._loaded is not None and self._loaded[0] == at:
            return self._loaded[1]
        return ivf.IvfIndex.load(self.spark, at)

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, expr: Column | str | None = None, metric: str = "l2_sq") -> DataFrame:
        """(qid, rank, id, dist); over the index with ``nprobe``, else exact. ``expr`` filters first.

        With an index, rows that it doesn't cover are searched exactly beside it; rows whose time
        to live has run out are found by neither.
        """
        _, state = self._state()
        where = self._alive() if expr is None else self._alive() & (F.expr(expr) if isinstance(expr, str) else expr)
        if nprobe is None:
            loaded = self._loaded is not None and self._loaded[0] == tuple(state["folders"])
            rows = self._loaded[1] if loaded else self._read(state["folders"])
            return exact_knn(rows, queries, k, metric, where, id_col=self.id_field, vec_col=self.vector_field)
        found = self.index().search(queries, k, nprobe, where)
        later = [f for f in state["folders"] if f not in set(state["covers"])]
        if not later:
            return found
        near = exact_knn(self._read(later), queries, k, self.index().metric, where, id_col=self.id_field, vec_col=self.vector_field)
        return merge_topk(found.unionByName(near).drop("rank"), k, self.id_field)

    def timed_search(self, queries: DataFrame, k: int, **how) -> tuple[float, list]:
        """(milliseconds, result rows)."""
        began = time.perf_counter()
        rows = self.search(queries, k, **how).collect()
        return 1000 * (time.perf_counter() - began), rows


def _unless_moved(others: list[dict]) -> None:
    """Inserts may come before; a flush, an index or a drop may not."""
    if any(c["kind"] != "insert" for c in others):
        raise Conflict("the collection was flushed or indexed meanwhile")


class Catalog:
    """Collections under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def create(self, name: str, id_field: str, vector_field: str, dim: int, ttl_seconds: int | None = None) -> Collection:
        if self.has(name):
            raise ValueError(f"collection {name!r} exists")
        c = Collection(self.spark, self.root, name, id_field, vector_field, dim, ttl_seconds)
        info = json.dumps({"id_field": id_field, "vector_field": vector_field, "dim": dim, "ttl_seconds": ttl_seconds})
        self.spark.createDataFrame([(info,)], "value string").coalesce(1).write.text(f"{self.root}/{name}/info")
        at = c._fresh("rows")
        self.spark.createDataFrame([], f"`{id_field}` bigint, `{vector_field}` array<float>, __inserted timestamp").write.parquet(at)
        c._log.commit({"kind": "create", "add": [at]}, -1, _unless_moved)
        return c

    def has(self, name: str) -> bool:
        fs, path = self._path(f"{name}/info")
        return fs.exists(path)

    def get(self, name: str) -> Collection:
        if not self.has(name):
            raise KeyError(name)
        return Collection(self.spark, self.root, name, **json.loads(self.spark.read.text(f"{self.root}/{name}/info").first().value))

    def list(self) -> list[str]:
        fs, path = self._path("")
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if self.has(s.getPath().getName())) if fs.exists(path) else []

    def drop(self, name: str) -> None:
        if not self.has(name):
            raise KeyError(name)
        fs, path = self._path(name)
        fs.delete(path, True)
