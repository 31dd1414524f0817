"""What the operators share: table reading, lineage cuts, text helpers, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspan.session import importable, shared_dir

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder (compressed, columnar)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark deletes them once the driver has collected the objects that stand for them, which may
    otherwise be after the job; what is still in use stays.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, _UPPER, _UPPER.lower())


def train_side(key: str = "doc_id") -> Column:
    """True for rows that may be learned from: crc32 of the key as text, modulo 5, is not 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0


def trimmed(run):
    """A function over Arrow batches that gives memory back to the system after each partition.

    Python workers are used again by later stages, and what one has freed would else stay with it.
    """

    def whole(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def slices(offsets, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``most`` bytes; one longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= most:
            j += 1
        yield i, j
        i = j


def text_bytes(column):
    """(uint8 data, int64 offsets) of an Arrow string or binary column; null counts as empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Columns under new names: ``pick(df, id="doc_id")``. Found by place, so that dots, quotes and names that differ in case only don't matter."""
    at, place = placed(df)
    return at.select(*[F.col(place(old)).alias(new) for new, old in names.items()])


def _place(have: list[str], name: str) -> int:
    if name in have:
        return have.index(name)
    alike = [i for i, c in enumerate(have) if c.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"no column {name!r} among {', '.join(have)}")
    return alike[0]


def placed(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """The table with columns named c0, c1, ... by place, which nothing clashes with, and a function from old names to those."""
    at = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return at, lambda name: f"c{_place(df.columns, name)}"


def packed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, packed): texts as zstd frames, for a shuffle; null as null. Read by ``unpacked``."""
    import pyarrow as pa

    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data, offsets = text_bytes(part.column(1))
                raw, ends = memoryview(data), offsets.tolist()
                frames = [zip_.compress(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(frames, pa.binary())], names=[id_col, "packed"])

    return rows.select(id_col, text_col).mapInArrow(trimmed(run), f"`{id_col}` {kind}, packed binary")


def unpacked(column):
    """The Arrow binary column of the texts in a column of ``packed``."""
    import pyarrow as pa
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    return pa.array([open_.decompress(x.as_py()) for x in column], pa.large_binary())


#: Rows of a table that may be broadcast to be attached to others.
MOST_ATTACHED = 100_000


def attach(rows: DataFrame, found: DataFrame, key: str, most: int = MOST_ATTACHED) -> DataFrame:
    """``rows`` with the further columns of ``found``, null where there are none: a left join by ``key``, null equal to null.

    ``found``, a stored table, has each key once and n, how many rows have it; n isn't added. Up
    to ``most`` keys are broadcast. Beyond it only those of at least a 4,096th of the counted
    rows are, of which there can't be more than 4,096; the rest is joined by shuffle, where no key
    is larger than that. Rows without a key don't take part in the shuffle.
    """
    added = [c for c in found.columns if c not in (key, "n")]

    def joined(left: DataFrame, right: DataFrame, *more: Column) -> DataFrame:
        right = right.select(F.col(key).alias("__key"), *added, *more)
        return left.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")

    if found.limit(most + 1).count() <= most:
        return joined(rows, found)
    total = found.agg(F.sum("n")).first()[0]
    hot = found.where((F.col("n") * 4096 >= total) | F.col(key).isNull())
    near = joined(rows, hot, F.lit(True).alias("__hot"))
    cold = near.where(F.col("__hot").isNull() & F.col(key).isNotNull()).drop("__hot", *added).join(found.drop("n"), key, "left")
    return near.where(F.col("__hot").isNotNull() | F.col(key).isNull()).drop("__hot").unionByName(cold)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """Components of an undirected graph: (node, component), component = least node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014) over DataFrames; each
    round is cut with a checkpoint, and nothing but a count reaches the driver. Nodes without
    an edge don't appear; null ends and loops are ignored. It needs about log2(nodes) rounds; a
    graph that still changes after ``rounds`` is an error. The least neighbours of nodes are a
    table of their own before they are joined with the edges, so that the join is a plain one
    whose hot node (a hub, as the least node of a large component becomes) is split at run time.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = cut(e)
    last, stable = None, e.isEmpty()
    for _ in range(0 if stable else rounds):
        # Large star: each node's larger neighbours point to the least of its neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node and its smaller neighbours, few after the large star, point to the least of them.
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s"))
        e = cut(small.select(F.col("s.u").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct())
        # Stable once every node has one edge, to a node that is no node's child.
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stable := seen == last:
            break
        last = seen
    if not stable:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
