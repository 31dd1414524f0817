"""Inserts, lazy deletes, search over base and delta, compaction, workloads."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.session import work_dir

from .topk import exact_knn

#: The tag that marks an invalid point in tag files.
INVALID_TAG = 4294967295


def visible(base: DataFrame, delta: DataFrame | None, tombstones: DataFrame | None, id_col: str = "vec_id") -> DataFrame:
    """Base rows neither deleted nor replaced, and the delta's.

    Deletes come before the inserts of one batch, so a row inserted again is visible with its
    new vector.
    """
    out = base
    if tombstones is not None:
        out = out.join(tombstones.select(F.col(tombstones.columns[0]).alias(id_col)), id_col, "left_anti")
    if delta is not None:
        out = out.join(delta.select(id_col), id_col, "left_anti").unionByName(delta.select(*out.columns))
    return out


def failed_deletes(asked: DataFrame, present: DataFrame, tag: str = "tag", id_col: str = "vec_id") -> DataFrame:
    """Tags asked to be deleted that aren't there."""
    return asked.select(tag).distinct().join(present.select(F.col(id_col).alias(tag)), tag, "left_anti")


def active_tags(all_ids: DataFrame, deleted: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, active) of every id."""
    gone = deleted.select(F.col(deleted.columns[0]).alias(id_col)).distinct().withColumn("__gone", F.lit(True))
    return all_ids.select(id_col).join(gone, id_col, "left").select(id_col, F.col("__gone").isNull().alias("active"))


def positions_to_tags(results: DataFrame, tags: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Results with their positions replaced by tags, from (position, tag) rows; positions without a tag, or with an invalid one, go."""
    return results.join(valid_tags(tags).select(F.col("position").alias(id_col), "tag"), id_col).drop(id_col)


def sorted_tags(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """Valid tags in rising order, each once."""
    return valid_tags(tags, tag).select(tag).distinct().orderBy(tag)


def valid_tags(tags: DataFrame, tag: str = "tag") -> DataFrame:
    return tags.where((F.col(tag) != INVALID_TAG) & F.col(tag).isNotNull())


def latest(ops: DataFrame, id_col: str = "tag") -> DataFrame:
    """The state each tag is left in by (batch, op, tag) rows: the last batch wins, deletes before inserts."""
    order = F.struct("batch", F.when(F.col("op") == "insert", 1).otherwise(0))
    return ops.groupBy(id_col).agg(F.max_by("op", order).alias("op"), F.max("batch").alias("batch"))


def search_after_updates(base: DataFrame, delta: DataFrame | None, tombstones: DataFrame | None, queries: DataFrame, k: int, **how) -> DataFrame:
    return exact_knn(visible(base, delta, tombstones), queries, k, **how)


def compact(base: DataFrame, delta: DataFrame | None, tombstones: DataFrame | None, path: str, id_col: str = "vec_id") -> DataFrame:
    """Fold deletes and inserts into a new snapshot table at ``path``."""
    visible(base, delta, tombstones, id_col).write.mode("errorifexists").parquet(path)
    return base.sparkSession.read.parquet(path)


def expired(df: DataFrame, inserted: str, ttl_seconds: int, now: Column | None = None) -> DataFrame:
    """Rows whose time to live has not run out."""
    return df.where(F.col(inserted) > (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))


def seed_workload(ids: DataFrame, active: float, deletes: float, memories: int = 1, seed: int = 0, id_col: str = "vec_id") -> DataFrame:
    """(id, active, deleted, memory): which points start active, which of them go, and which in-memory index takes an insert."""

    def number(salt: int) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{salt}"), F.col(id_col).cast("string")))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")

    def draw(salt: int) -> Column:
        return number(salt) % 1_000_000 / F.lit(1_000_000.0)

    on = draw(1) < active
    return ids.select(id_col, on.alias("active"), (on & (draw(2) < deletes)).alias("deleted"), F.when(~on, number(3) % memories).alias("memory"))


@dataclass
class VectorStore:
    """A versioned table of vectors with a delta and tombstones, in Parquet under one folder.

    Files are only ever added: inserts and deletes carry a rising number, and a row is visible
    where no later delete names it and no later insert replaces it. One writer, any readers: a
    merge writes the next version beside the old one and then publishes its number, so that a
    search that runs meanwhile goes on reading its own version.
    """

    spark: SparkSession
    path: str
    merge_rows: int = 30_000_000
    id_col: str = "vec_id"

    def _parts(self, folder: str | None = None) -> dict[str, list[str]]:
        """The complete folders of a version by kind, from one listing, so that they belong to one moment."""
        at = f"{self.path}/{folder or self._version()[1]}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(at).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(path(at)))
        found: dict[str, list[str]] = {}
        for n in names:
            if fs.exists(path(f"{at}/{n}/_SUCCESS")):
                found.setdefault(n.split("-")[0], []).append(f"{at}/{n}")
        return found

    def _version(self) -> tuple[int, str]:
        """The number and folder of the highest version that was published. A pointer is an empty file of its own, named after both, that appears at once and never changes."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max(((int(n.split("-")[0][1:]), n) for n in names if n.startswith("v")), default=(0, "v0"))

    def _point(self, folder: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{folder}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p, False).close()

    def create(self, base: DataFrame) -> VectorStore:
        base.write.parquet(f"{self.path}/v0/base")
        self._point("v0")
        return self

    def insert(self, rows: DataFrame) -> None:
        seq = time.time_ns()
        rows.withColumn("__seq", F.lit(seq)).write.parquet(f"{self.path}/{self._version()[1]}/delta-{seq}")
        if self.spark.read.parquet(*self._parts()["delta"]).count() >= self.merge_rows:
            self.merge()

    def delete(self, tags: DataFrame) -> DataFrame:
        """Lazy delete; returns the tags that weren't there."""
        seq = time.time_ns()
        at = f"{self.path}/{self._version()[1]}"
        tags.select(F.col(tags.columns[0]).cast("bigint").alias("tag")).distinct().write.parquet(f"{at}/asked-{seq}")
        asked = self.spark.read.parquet(f"{at}/asked-{seq}")
        failed_deletes(asked, self.rows(), "tag", self.id_col).write.parquet(f"{at}/failed-{seq}")
        asked.withColumn("__seq", F.lit(seq)).write.parquet(f"{at}/tombstones-{seq}")
        return self.spark.read.parquet(f"{at}/failed-{seq}")

    def eager_delete(self, tags: DataFrame) -> DataFrame:
        """Delete and rewrite the table at once; returns the tags that weren't there."""
        failed = self.delete(tags)
        self.merge()
        return failed

    def rows(self) -> DataFrame:
        """What is visible now. All parts are of one version, whatever is merged meanwhile."""
        parts = self._parts()
        base, delta, dead = (self.spark.read.parquet(*parts[kind]) if kind in parts else None for kind in ("base", "delta", "tombstones"))
        if dead is not None:
            dead = dead.groupBy(F.col("tag").alias(self.id_col)).agg(F.max("__seq").alias("__dead"))
        if delta is not None:
            last = delta.groupBy(self.id_col).agg(F.max("__seq").alias("__seq"))
            delta = delta.join(last, [self.id_col, "__seq"], "left_semi")
            if dead is not None:
                delta = delta.join(dead, self.id_col, "left").where("__dead is null or __dead < __seq").drop("__dead")
            base = base.join(last, self.id_col, "left_anti")
        if dead is not None:
            base = base.join(dead, self.id_col, "left_anti")
        return base if delta is None else base.unionByName(delta.select(*base.columns))

    def search(self, queries: DataFrame, k: int, **how) -> DataFrame:
        return exact_knn(self.rows(), queries, k, id_col=self.id_col, **how)

    def merge(self) -> None:
        """Write the next snapshot under a name of its own, then point readers at it; the old one stays for running searches, and what a crash left behind is in nobody's way."""
        folder = f"v{self._version()[0] + 1}-{uuid.uuid4().hex}"
        self.rows().write.parquet(f"{self.path}/{folder}/base")
        self._point(folder)


def update_while_searching(store, queries: DataFrame, k: int, steps: list[tuple[str, DataFrame]], **how) -> DataFrame:
    """Apply ("insert" | "delete", rows) steps with a merge after each while another thread goes on searching.

    Returns the results of all searches, (search, ...) with a number each, from a table in the
    shared folder; each search saw one version whole. ``store`` is a VectorStore or LevelledIndex;
    ``how`` goes to its search.
    """
    import threading

    spark, path = queries.sparkSession, work_dir(queries.sparkSession, "searches")
    failed: list[BaseException] = []
    stop = threading.Event()

    def search() -> None:
        done = 0
        try:
            while not stop.is_set() or not done:
                store.search(queries, k, **how).withColumn("search", F.lit(done)).write.parquet(f"{path}/{done:06d}")
                done += 1
        except BaseException as e:  # noqa: BLE001 - raised below, in the caller's thread
            failed.append(e)

    reader = threading.Thread(target=search)
    reader.start()
    try:
        for op, rows in steps:
            store.insert(rows) if op == "insert" else store.delete(rows)
            store.merge()
    finally:
        stop.set()
        reader.join()
    if failed:
        raise failed[0]
    return spark.read.parquet(f"{path}/*")


def delete_reinsert_cycles(store: VectorStore, source: DataFrame, share: float, cycles: int, seed: int = 0) -> list[tuple[int, int]]:
    """Each cycle deletes a share of the points by hash, folds that in, and inserts them again.

    Returns per cycle the rows visible after the deletes and after the inserts.
    """
    seen = []
    for cycle in range(cycles):
        picked = source.where(F.pmod(F.xxhash64(F.lit(seed + cycle), F.col(store.id_col)), F.lit(1_000_000)) < int(share * 1_000_000))
        store.eager_delete(picked.select(store.id_col))
        after = store.rows().count()
        store.insert(picked)
        seen.append((after, store.rows().count()))
    return seen


def ramp_up(store: VectorStore, source: DataFrame, rounds: int = 50, step: float = 0.02, drop: float = 0.1, seed: int = 0) -> list[int]:
    """Rounds of inserting the next ``step`` of the points, then of deleting ``drop`` of what is there."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(store.id_col)), F.lit(1_000_000)) / 1_000_000.0
    seen = []
    for r in range(rounds):
        store.insert(source.where((at >= r * step) & (at < (r + 1) * step)))
        gone = store.rows().where(F.pmod(F.xxhash64(F.lit(seed + r + 1), F.col(store.id_col)), F.lit(1_000_000)) < int(drop * 1_000_000))
        store.delete(gone.select(store.id_col))
        seen.append(store.rows().count())
    return seen
