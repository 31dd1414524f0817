"""An index over base and deltas: levels of inverted lists under a commit log, for any number of writers.

Every insert is a folder of lists of its own (level 0); merges fold folders into level 1 and the
base (level 2). All levels share the centroids. Deletes are folders of ids. A row is visible where
no later commit deletes or inserts its id; every folder's rows carry the commit that brought them,
so that merges beside inserts and deletes change nothing of what is visible.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecspan.functions import distance
from vecspan.sources.commits import CommitLog, Conflict

from . import ivf

#: The base, and what merges of small inserts make.
BASE, MERGED, FRESH = 2, 1, 0
#: Ids that newer commits hide, broadcast up to so many; more are joined by shuffle.
MOST_HIDDEN = 1_000_000
_START = {"folders": [], "dead": [], "centroids": None}


def fold(state: dict, commit: dict, version: int) -> dict:
    """The state after a commit: live folders with their level, tombstone folders, and the centroids' folder."""
    folders = [f for f in state["folders"] if f["path"] not in commit.get("remove", ())]
    folders += [{"seq": version, **f} if f["level"] == FRESH else f for f in commit.get("add", ())]
    dead = [d for d in state["dead"] if d["path"] not in commit.get("remove", ())]
    dead += [{"seq": version, "path": p} for p in commit.get("dead", ())]
    return {"folders": folders, "dead": dead, "centroids": commit.get("centroids", state["centroids"])}


@dataclass
class LevelledIndex:
    """Vectors by id under one folder. An id that is inserted again takes the place of its former row.

    Ids are unique within an insert. Vectors that are null or hold a null or non-finite
    component can't be found and aren't kept. Old folders stay for running searches until ``vacuum``.
    """

    spark: SparkSession
    path: str
    id_col: str = "vec_id"
    vec_col: str = "embedding"

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, f"{self.path}/log")

    def create(self, base: DataFrame, nlist: int = 1024, centroids: DataFrame | None = None) -> LevelledIndex:
        """The first commit: centroids, trained or given, and the base in their lists."""
        if self.log.version() >= 0:
            raise ValueError(f"there is an index at {self.path}")
        base = base.where(distance.finite(F.col(self.vec_col)))
        cents = centroids if centroids is not None else ivf.kmeans(base, nlist, 10, self.id_col, self.vec_col, train_rows=ivf.train_rows(nlist, False))
        at = self._fresh("centroids")
        cents.write.parquet(at)
        folder = self._write(base.withColumn("__seq", F.lit(0).cast("long")), BASE, self.spark.read.parquet(at))
        if self.log.commit({"kind": "create", "add": [folder], "centroids": at}, -1, _taken) != 0:
            raise Conflict(f"there is an index at {self.path}")
        return self

    def _fresh(self, name: str) -> str:
        return f"{self.path}/data/{name}-{uuid.uuid4().hex}"

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        return self.log.state(fold, _START, version)

    def _centroids(self, state: dict) -> DataFrame:
        return self.spark.read.parquet(state["centroids"])

    def _write(self, rows: DataFrame, level: int, centroids: DataFrame) -> dict:
        """A folder of lists in ranges of (cluster, id); the base's is partitioned by cluster, small ones are pruned by their files' statistics."""
        lists = ivf.assign(rows, centroids, "l2_sq", self.id_col, self.vec_col, keep=rows.columns).drop("dist")
        return self._lists(lists, level)

    def _lists(self, lists: DataFrame, level: int) -> dict:
        at = self._fresh(f"level{level}")
        spread = lists.repartitionByRange("cluster_id", self.id_col).sortWithinPartitions("cluster_id", self.id_col)
        (spread.write.partitionBy("cluster_id") if level == BASE else spread.write).parquet(at)
        return {"path": at, "level": level, "rows": self.spark.read.schema(lists.schema).parquet(at).count(), "schema": lists.schema.json()}

    def insert(self, rows: DataFrame) -> int:
        """Add or replace rows; returns the commit. Inserts never conflict: of two of one id the later commit holds."""
        read, state = self._state()
        folder = self._write(rows.where(distance.finite(F.col(self.vec_col))), FRESH, self._centroids(state))
        return self.log.commit({"kind": "insert", "add": [folder]}, read, _any)

    def delete(self, ids: DataFrame) -> int:
        """Delete by id (the first column); returns the commit."""
        at = self._fresh("dead")
        ids.select(F.col(ids.columns[0]).cast("bigint").alias("id")).where("id is not null").distinct().write.parquet(at)
        return self.log.commit({"kind": "delete", "dead": [at]}, self.log.version(), _any)

    def failed(self, version: int) -> DataFrame:
        """Of a delete's ids those that weren't visible when it was committed, whatever ran beside it."""
        commit = self.log.commits(version - 1, version)[0]
        asked = self.spark.read.schema("id bigint").parquet(*commit["dead"])
        return asked.join(self.rows(version - 1).select(F.col(self.id_col).alias("id")), "id", "left_anti")

    def _level(self, folder: dict) -> DataFrame:
        rows = self.spark.read.schema(StructType.fromJson(json.loads(folder["schema"]))).parquet(folder["path"])
        return rows if "__seq" in rows.columns else rows.withColumn("__seq", F.lit(folder["seq"]).cast("long"))

    def _hidden(self, state: dict) -> DataFrame | None:
        """(id, __last, __dead): the last insert of each id above the base, and the last delete."""
        parts = [self._level(f).select(F.col(self.id_col).alias("__id"), "__seq", F.lit(None).cast("long").alias("__dead")) for f in state["folders"] if f["level"] != BASE]
        parts += [self.spark.read.schema("id bigint").parquet(d["path"]).select(F.col("id").alias("__id"), F.lit(None).cast("long").alias("__seq"), F.lit(d["seq"]).cast("long").alias("__dead")) for d in state["dead"]]
        if not parts:
            return None
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("__id").agg(F.max("__seq").alias("__last"), F.max("__dead").alias("__dead"))

    def _seen(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows that no later commit hides."""
        hidden = self._hidden(state)
        if hidden is None:
            return rows
        many = sum(f["rows"] for f in state["folders"] if f["level"] != BASE) > MOST_HIDDEN or hidden.limit(MOST_HIDDEN + 1).count() > MOST_HIDDEN
        on = rows[self.id_col] == F.col("__id")
        joined = rows.join(hidden if many else F.broadcast(hidden), on, "left")
        return joined.where("(__last is null or __seq >= __last) and (__dead is null or __seq > __dead)").drop("__id", "__last", "__dead")

    def _every(self, state: dict, probed: list[int] | None = None) -> DataFrame:
        out = None
        for f in state["folders"]:
            rows = self._level(f)
            if probed is not None:
                rows = rows.where(F.col("cluster_id").isin(probed))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def rows(self, version: int | None = None) -> DataFrame:
        """What is visible, now or after an earlier commit."""
        _, state = self._state(version)
        return self._seen(self._every(state), state).drop("__seq", "cluster_id")

    def search(self, queries: DataFrame, k: int, nprobe: int, where: Column | str | None = None, version: int | None = None) -> DataFrame:
        """(qid, rank, id, dist) over the probed clusters of every level, of what is visible."""
        _, state = self._state(version)
        cents = self._centroids(state)
        probes = ivf.probe(queries, cents, nprobe, "l2_sq", self.vec_col)
        few = [r[0] for r in probes.select("cluster_id").distinct().limit(1001).collect()]
        lists = self._seen(self._every(state, sorted(few) if len(few) <= 1000 else None), state)
        return ivf.search(lists, cents, queries, k, nprobe, "l2_sq", self.id_col, self.vec_col, where=where)

    def merge(self, whole: bool = False) -> int | None:
        """Fold the small folders into one of level 1, or with ``whole`` everything into a new base; the commit, or None where there is nothing to do.

        What comes in meanwhile stays as it is: rows keep the commit that brought them. A merge
        that has folded what another merge folded first is a Conflict, and its folder goes.
        """
        read, state = self._state()
        inputs = [f for f in state["folders"] if whole or f["level"] != BASE]
        if len(inputs) < 2 and not (whole and state["dead"]):
            return None
        rows = self._seen(self._every({"folders": inputs}), state)
        folder = self._lists(rows, BASE if whole else MERGED)
        gone = [f["path"] for f in inputs] + ([d["path"] for d in state["dead"]] if whole else [])

        def check(others: list[dict]) -> None:
            if taken := {p for c in others for p in c.get("remove", ())} & set(gone):
                raise Conflict(f"{len(taken)} of the merged folders were merged before")

        try:
            return self.log.commit({"kind": "merge", "add": [folder], "remove": gone}, read, check)
        except Conflict:
            self._remove([folder["path"]])
            raise

    def keep_up(self, folders: int = 8, ratio: int = 4) -> int | None:
        """Merge where it is due: the small folders once there are ``folders``, everything once they hold a ``ratio``-th of the base's rows."""
        _, state = self._state()
        small = [f for f in state["folders"] if f["level"] != BASE]
        base = sum(f["rows"] for f in state["folders"] if f["level"] == BASE)
        if sum(f["rows"] for f in small) * ratio >= base and small:
            return self.merge(whole=True)
        return self.merge() if len(small) >= folders else None

    def vacuum(self, keep: int = 0) -> int:
        """Delete folders that no state of the last ``keep`` commits and now has; returns how many. Only when no write is under way."""
        last = self.log.version()
        live: set[str] = set()
        for v in range(max(0, last - keep), last + 1):
            _, state = self._state(v)
            live |= {f["path"] for f in state["folders"]} | {d["path"] for d in state["dead"]} | {state["centroids"]}
        names = {p.split("/")[-1] for p in live}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName() not in names]
        self._remove(old)
        return len(old)

    def _remove(self, paths: list[str]) -> None:
        for p in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _any(others: list[dict]) -> None:
    """Commits that any others may precede."""


def _taken(others: list[dict]) -> None:
    raise Conflict("there is an index already")
