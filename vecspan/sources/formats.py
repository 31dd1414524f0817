"""Binary vector formats as Spark data sources.

``register(spark)`` makes these formats known to ``spark.read.format`` and ``write.format``:

- ``fvecs``, ``ivecs``, ``bvecs``: each row is its int32 length and that many float32, int32, uint8
- ``fbin``, ``ibin``, ``u8bin``, ``i8bin``, ``u32bin``: int32 rows, int32 length, then all rows
- ``dat``: int32 rows without any header; option ``dim``
- ``truthset``: int32 rows, int32 k, then ids, float32 distances and, if there, tags
- ``trace``: int32 m, m tags to delete, m tags to insert; a file is a batch

All are little-endian. A path names a file or a folder of part files, which are read in the
order of their names; vec_id is the ordinal over all of them. Options ``start`` and ``count``
read a range of rows, as do filters of vec_id, which are pushed down where the session allows it
(``register`` asks for it); ``rows_per_split`` bounds a split. A trace is also a stream, whose
files become batches as they appear. Option ``offset`` is the byte at which a matrix with a header
begins inside a file. Paths may be of any store that
``pyarrow.fs`` opens by URI.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from vecspan.session import importable

#: numpy type and Spark component type of each format.
_TYPES = {
    "fvecs": ("<f4", "float"),
    "ivecs": ("<i4", "int"),
    "bvecs": ("u1", "smallint"),
    "fbin": ("<f4", "float"),
    "ibin": ("<i4", "int"),
    "u8bin": ("u1", "smallint"),
    "i8bin": ("i1", "tinyint"),
    "u32bin": ("<u4", "bigint"),
    "dat": ("<i4", "int"),
}


def opened(path: str):
    """(file system, path in it)."""
    import os
    import re

    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def files(path: str):
    """(file system, [(path, bytes)]) of a file or a folder's files, in the order of their names."""
    from pyarrow import fs

    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return store, [(info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else []
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    parts = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
    return store, parts


def side_by_side(read, parts: list) -> list:
    """What ``read`` gives for each part, many at once: headers of many files are read in the time of a few."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(min(64, len(parts)) or 1) as pool:
        return list(pool.map(read, parts))


def _numbers(store, path: str, kind: str) -> tuple:
    """The numbers that a file begins with."""
    with store.open_input_file(path) as f:
        return struct.unpack(kind, f.read(struct.calcsize(kind)))


@dataclass
class Split(InputPartition):
    path: str
    first: int
    rows: int
    dim: int
    ordinal: int
    head: int
    stride: int
    total: int


class _Vectors(DataSource):
    """Rows (vec_id, embedding)."""

    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return f"vec_id bigint, embedding array<{_TYPES[self.kind][1]}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _VectorReader(self.kind, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _VectorWriter(self.kind, dict(self.options), overwrite)


class _VectorReader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.options = kind, options
        #: The rows that pushed filters leave: [low, high).
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]):
        """Take the bounds of vec_id; every filter is still applied to what is read."""
        for f in filters:
            if getattr(f, "attribute", None) != ("vec_id",):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, int(f.value) + (not isinstance(f, LessThan)))
            if isinstance(f, In) and f.value:
                self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value) + 1)
            yield f

    def _head(self, store, path: str, size: int) -> tuple[int, int, int, int]:
        """(rows, dim, bytes before the rows, bytes of a row)."""
        import numpy as np

        item = np.dtype(_TYPES[self.kind][0]).itemsize
        if self.kind == "dat":
            dim = int(self.options["dim"])
            return size // (dim * item), dim, 0, dim * item
        offset = int(self.options.get("offset", 0))
        with store.open_input_file(path) as f:
            f.seek(offset)
            head = f.read(8)
        if self.kind.endswith("vecs"):
            if not size:
                return 0, 0, 0, 1
            dim = struct.unpack("<i", head[:4])[0]
            if dim <= 0 or size % (4 + dim * item):
                raise ValueError(f"{path} isn't {self.kind} of one dimension")
            return size // (4 + dim * item), dim, 0, 4 + dim * item
        rows, dim = struct.unpack("<ii", head)
        if size < offset + 8 + rows * dim * item:
            raise ValueError(f"{path} ends before its {rows} rows")
        return rows, dim, offset + 8, dim * item

    def partitions(self) -> list[Split]:
        store, parts = files(self.options["path"])
        start = int(self.options.get("start", 0))
        end = start + int(self.options["count"]) if "count" in self.options else 1 << 62
        start, end = max(start, self.low), min(end, self.high)
        most = int(self.options.get("rows_per_split", 100_000))
        out, ordinal = [], 0
        for (path, _), (rows, dim, head, stride) in zip(parts, side_by_side(lambda p: self._head(store, *p), parts), strict=True):
            low, high = max(0, start - ordinal), min(rows, end - ordinal)
            for at in range(low, high, most):
                out.append(Split(path, at, min(most, high - at), dim, ordinal + at, head, stride, rows))
            ordinal += rows
        return out or [Split("", 0, 0, 0, 0, 0, 1, 0)]

    def read(self, split: Split) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if not split.rows:
            return
        store, _ = opened(self.options["path"])
        dtype, kind = _TYPES[self.kind]
        with store.open_input_file(split.path) as f:
            raw = f.read_at(split.rows * split.stride, split.head + split.first * split.stride)
        table = np.frombuffer(raw, np.uint8).reshape(split.rows, split.stride)
        if self.kind.endswith("vecs"):
            if (table[:, :4] != np.frombuffer(struct.pack("<i", split.dim), np.uint8)).any():
                raise ValueError(f"{split.path} has rows of several dimensions")
            table = table[:, 4:]
        wide = {"smallint": np.int16, "bigint": np.int64}.get(kind)
        values = np.ascontiguousarray(table).view(dtype).reshape(-1)
        values = values.astype(wide) if wide else values
        lists = pa.ListArray.from_arrays(np.arange(0, values.size + 1, split.dim or 1, dtype=np.int32)[: split.rows + 1], pa.array(values))
        ids = pa.array(np.arange(split.ordinal, split.ordinal + split.rows))
        yield pa.RecordBatch.from_arrays([ids, lists], names=["vec_id", "embedding"])


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _PartsWriter(DataSourceArrowWriter):
    """Files that tasks write under names of their own, and that get their names once all tasks have ended."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def _store(self):
        store, at = opened(self.options["path"])
        store.create_dir(at, recursive=True)
        return store, at

    def commit(self, messages: list) -> None:
        store, at = self._store()
        moves = [line.split("\t") for m in messages if m and m.path for line in m.path.split("\n")]
        if self.overwrite:
            for path, _ in files(self.options["path"])[1]:
                store.delete_file(path)
        for temp, final in moves:
            store.move(temp, final)

    def abort(self, messages: list) -> None:
        store, _ = self._store()
        for m in messages:
            for line in m.path.split("\n") if m and m.path else []:
                store.delete_file(line.split("\t")[0])


class _VectorWriter(_PartsWriter):
    """A file of the format per task, named by the least id in it, so that sorted ranges stay in order."""

    def __init__(self, kind: str, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.kind = kind

    def write(self, batches: Iterator) -> WriterCommitMessage:
        import uuid

        import numpy as np

        store, at = self._store()
        dtype = np.dtype(_TYPES[self.kind][0])
        temp = f"{at}/.{uuid.uuid4().hex}"
        rows, dim, least = 0, -1, None
        with store.open_output_stream(temp) as f:
            held = []
            for batch in batches:
                vec = batch.column(batch.schema.get_field_index("embedding"))
                n = len(vec)
                if not n:
                    continue
                if vec.null_count:
                    raise ValueError("a vector is null")
                flat = vec.flatten().to_numpy(zero_copy_only=False)
                size = np.array([len(v) for v in vec])
                dim = int(size[0]) if dim < 0 else dim
                if (size != dim).any():
                    raise ValueError("vectors differ in length")
                body = flat.astype(dtype).reshape(n, dim)
                if "vec_id" in batch.schema.names and least is None:
                    least = batch.column(batch.schema.get_field_index("vec_id"))[0].as_py()
                rows += n
                if self.kind.endswith("vecs"):
                    head = np.full((n, 1), dim, "<i4").view(np.uint8).reshape(n, 4)
                    f.write(np.concatenate([head, body.view(np.uint8).reshape(n, -1)], axis=1).tobytes())
                elif self.kind == "dat":
                    f.write(body.tobytes())
                else:  # the row count comes first, so the task's rows are held
                    held.append(body)
            if self.kind not in ("fvecs", "ivecs", "bvecs", "dat"):
                f.write(struct.pack("<ii", rows, max(0, dim)))
                for body in held:
                    f.write(body.tobytes())
        if not rows:
            store.delete_file(temp)
            return _Written("")
        final = f"{at}/part-{least if least is not None else 0:020d}-{uuid.uuid4().hex[:8]}.{self.kind}"
        return _Written(f"{temp}\t{final}")


class _MatrixWriter(_PartsWriter):
    """Files of neighbour lists, a range of queries each: (qid, rank, id, dist[, tag]) rows that are sorted by query and rank, ``k`` a query.

    "truthset": a header and the matrices of ids, distances and tags; "results": a header and
    pairs of id and distance. A task holds 12 bytes a row, as the header counts them.
    """

    def __init__(self, kind: str, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.kind, self.k = kind, int(options["k"])

    def write(self, batches: Iterator) -> WriterCommitMessage:
        import uuid

        import numpy as np

        pair = np.dtype([("id", "<u4"), ("dist", "<f4")])
        rows, least = [], None
        for batch in (b for b in batches if b.num_rows):
            column = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            least = int(column["qid"][0]) if least is None else least
            rows.append((column["vec_id"].astype("<u4"), column["dist"].astype("<f4"), column["tag"].astype("<u4") if self.kind == "truthset" else None))
        if not rows:
            return _Written("")
        ids, dist = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        if self.kind == "truthset":
            body = [ids, dist, np.concatenate([r[2] for r in rows])]
        else:
            body = [np.rec.fromarrays([ids, dist], dtype=pair)]
        store, at = self._store()
        temp = f"{at}/.{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as f:
            f.write(struct.pack("<ii", len(ids) // self.k, self.k))
            for part in body:
                f.write(part.tobytes())
        return _Written(f"{temp}\t{at}/part-{least + (1 << 62):020d}-{uuid.uuid4().hex[:8]}.bin")


class _TraceWriter(_PartsWriter):
    """A file a batch from (batch, deletes, tag) rows that are sorted by batch, deletes first; streamed."""

    def write(self, batches: Iterator) -> WriterCommitMessage:
        import uuid

        import numpy as np

        store, at = self._store()
        moves, f, now = [], None, None
        for batch in (b for b in batches if b.num_rows):
            number, m, tag = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("batch", "m", "tag"))
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if now != number[i]:
                    if f is not None:
                        f.close()
                    now, temp = number[i], f"{at}/.{uuid.uuid4().hex}"
                    f = store.open_output_stream(temp)
                    f.write(struct.pack("<I", int(m[i])))
                    moves.append(f"{temp}\t{at}/batch-{int(now):010d}.bin")
                f.write(tag[i:j].astype("<u4").tobytes())
        if f is not None:
            f.close()
        return _Written("\n".join(moves))


class _Results(DataSource):
    """Search results to write: (qid, rank, vec_id, dist) rows, with the option k."""

    @classmethod
    def name(cls) -> str:
        return "results"

    def schema(self) -> str:
        return "qid bigint, rank bigint, vec_id bigint, dist float"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _MatrixWriter("results", dict(self.options), overwrite)


class _Truth(DataSource):
    """Rows (qid, rank, vec_id, dist, tag)."""

    @classmethod
    def name(cls) -> str:
        return "truthset"

    def schema(self) -> str:
        return "qid bigint, rank bigint, vec_id bigint, dist float, tag bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TruthReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _MatrixWriter("truthset", dict(self.options), overwrite)


class _TruthReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Split]:
        store, parts = files(self.options["path"])
        out, ordinal = [], 0
        for (path, size), (rows, k) in zip(parts, side_by_side(lambda p: _numbers(store, p[0], "<ii"), parts), strict=True):
            most = int(self.options.get("rows_per_split", 100_000))
            for at in range(0, rows, most):
                out.append(Split(path, at, min(most, rows - at), k, ordinal + at, 8, 4 * k, rows if size >= 8 + 12 * rows * k else -rows))
            ordinal += rows
        return out or [Split("", 0, 0, 0, 0, 0, 1, 0)]

    def read(self, split: Split) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if not split.rows:
            return
        store, _ = opened(self.options["path"])
        with store.open_input_file(split.path) as f:
            blocks = [np.frombuffer(f.read_at(split.rows * split.stride, 8 + b * abs(split.total) * split.stride + split.first * split.stride), t) for b, t in enumerate(("<u4", "<f4", "<u4")[: 3 if split.total > 0 else 2])]
        ids = blocks[0].astype(np.int64)
        qid = np.repeat(np.arange(split.ordinal, split.ordinal + split.rows), split.dim)
        rank = np.tile(np.arange(1, split.dim + 1), split.rows)
        tag = blocks[2].astype(np.int64) if len(blocks) > 2 else ids
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qid, rank, ids, blocks[1], tag)], names=["qid", "rank", "vec_id", "dist", "tag"])


class _Trace(DataSource):
    """Rows (batch, op, tag)."""

    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        return "batch bigint, op string, tag bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TraceReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _TraceWriter(dict(self.options), overwrite)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _TraceStream(dict(self.options))


def _trace_splits(options: dict, first: int = 0, end: int = 1 << 62) -> list[Split]:
    """Ranges of tags of the batches from ``first`` to before ``end``; a file is a batch, by its place among the names."""
    store, parts = files(options["path"])
    most = int(options.get("rows_per_split", 1_000_000))
    out = []
    some = list(enumerate(parts))[first:end]
    heads = side_by_side(lambda p: _numbers(store, p[1][0], "<I") if p[1][1] >= 4 else (0,), some)
    for (b, (path, size)), (m,) in zip(some, heads, strict=True):
        if size < 4 + 8 * m:
            raise ValueError(f"{path} ends before its {m} inserts")
        out += [Split(path, at, min(most, 2 * m - at), 0, b, 4, 4, m) for at in range(0, 2 * m, most)]
    return out or [Split("", 0, 0, 0, 0, 0, 1, 0)]


def _trace_rows(options: dict, split: Split) -> Iterator:
    import numpy as np
    import pyarrow as pa

    if not split.rows:
        return
    store, _ = opened(options["path"])
    with store.open_input_file(split.path) as f:
        tags = np.frombuffer(f.read_at(4 * split.rows, split.head + 4 * split.first), "<u4").astype(np.int64)
    insert = np.arange(split.first, split.first + split.rows) >= split.total
    ops = pa.array(["delete", "insert"]).take(pa.array(insert.astype(np.int64)))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tags), split.ordinal)), ops, pa.array(tags)], names=["batch", "op", "tag"])


class _TraceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Split]:
        return _trace_splits(self.options)

    def read(self, split: Split) -> Iterator:
        return _trace_rows(self.options, split)


class _TraceStream(DataSourceStreamReader):
    """The offset is the number of files read; files are to appear in the order of their names."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(files(self.options["path"])[1])}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return _trace_splits(self.options, start["files"], end["files"])

    def read(self, split: Split) -> Iterator:
        return _trace_rows(self.options, split)

    def commit(self, end: dict) -> None:
        """Nothing to let go of."""


def register(spark: SparkSession) -> SparkSession:
    """Make the formats known to the session."""
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for kind in _TYPES:
        spark.dataSource.register(type(kind, (_Vectors,), {"kind": kind, "__module__": __name__, "__reduce__": _Vectors.__reduce__}))
    spark.dataSource.register(_Truth)
    spark.dataSource.register(_Trace)
    spark.dataSource.register(_Results)
    return spark


def read_vectors(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A vector file by its suffix or by ``kind``."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1]
    kind = {"bin": "fbin"}.get(kind, kind)
    if kind not in _TYPES:
        raise ValueError(f"unknown vector format {kind!r}")
    return register(spark).read.format(kind).options(**{k: str(v) for k, v in options.items()}).load(path)


def write_vectors(df: DataFrame, path: str, kind: str, mode: str = "append", id_col: str = "vec_id", vec_col: str = "embedding", shards: int | None = None) -> None:
    """(id, vector) rows as part files in the order of the ids."""
    register(df.sparkSession)
    rows = df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS vec_id", f"CAST(`{vec_col}` AS ARRAY<{_TYPES[kind][1]}>) AS embedding")
    rows = rows.repartitionByRange(*([shards] if shards else []), "vec_id").sortWithinPartitions("vec_id")
    rows.write.format(kind).mode(mode).save(path)


def write_truthset(truth: DataFrame, path: str, tag_col: str | None = None, files: int | None = None) -> None:
    """(qid, rank, vec_id, dist) as truthset files, of a range of queries each, in a folder that is read as one.

    Tasks write them; with ``files`` = 1 there is one file, and one task, as the format's other
    readers want it.
    """
    per = truth.groupBy("qid").agg(F.count("*").alias("k")).agg(F.min("k"), F.max("k")).first()
    if per[0] != per[1]:
        raise ValueError("queries differ in their number of neighbours")
    rows = truth.select("qid", "rank", F.col("vec_id").cast("bigint").alias("vec_id"), F.col("dist").cast("float").alias("dist"), F.col(tag_col or "vec_id").cast("bigint").alias("tag"))
    _by_query(rows, files).write.format("truthset").option("k", per[0] or 1).mode("append").save(path)


def _by_query(rows: DataFrame, files: int | None) -> DataFrame:
    register(rows.sparkSession)
    return rows.repartitionByRange(*([files] if files else []), "qid").sortWithinPartitions("qid", "rank")


def save_matrix(df: DataFrame, path: str, kind: str = "fbin", offset: int = 0, id_col: str = "vec_id", vec_col: str = "embedding") -> int:
    """Rows in the order of their ids as one matrix with its header, from byte ``offset`` of a local file on; returns the bytes written.

    What the file has before stays. Read it with the option ``offset``. A file's inside can only
    be written from one place, so rows pass through the driver a partition at a time; use
    ``write_vectors`` for tables.
    """
    import os

    import numpy as np

    if not kind.endswith("bin"):
        raise ValueError(f"{kind} has no header")
    dtype = np.dtype(_TYPES[kind][0])
    rows, dim, written = 0, 0, 8
    with open(path, "r+b" if os.path.exists(path) else "w+b") as f:
        f.seek(offset + 8)
        for r in df.select(id_col, vec_col).orderBy(id_col).toLocalIterator():
            raw = np.array(r[1]).astype(dtype)
            if rows and len(raw) != dim:
                raise ValueError("vectors differ in length")
            rows, dim = rows + 1, len(raw)
            written += f.write(raw.tobytes())
        f.seek(offset)
        f.write(struct.pack("<ii", rows, dim))
    return written


def write_result_matrix(results: DataFrame, path: str, k: int, id_col: str = "vec_id", files: int | None = None) -> None:
    """(qid, rank, id, dist) as files of int32 queries, int32 k, then of each query in turn k pairs of uint32 id and float32 distance.

    Missing ranks are id 4294967295 and an infinite distance. Tasks write a range of queries each
    into a folder; with ``files`` = 1 there is one file.
    """
    have = results.where(F.col("rank") <= k).select("qid", F.col("rank").cast("bigint").alias("rank"), F.col(id_col).cast("bigint").alias("vec_id"), F.col("dist").cast("float").alias("dist"))
    every = have.groupBy("qid").agg(F.collect_list("rank").alias("there")).select("qid", F.explode(F.array_except(F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint")), "there")).alias("rank"))
    none = every.select("qid", "rank", F.lit(4294967295).cast("bigint").alias("vec_id"), F.lit(float("inf")).cast("float").alias("dist"))
    _by_query(have.unionByName(none), files).write.format("results").option("k", k).mode("append").save(path)


def write_trace(ops: DataFrame, path: str) -> None:
    """(batch, op, tag) rows as a trace: a file a batch, named in order. A batch has as many inserts as deletes.

    Tasks write whole batches, as a batch is one file; its rows stream through.
    """
    register(ops.sparkSession)
    is_delete = F.col("op") == "delete"
    counts = ops.groupBy("batch").agg(F.sum(is_delete.cast("bigint")).alias("m"), F.sum((F.col("op") == "insert").cast("bigint")).alias("i"))
    if bad := counts.where("m <> i").first():
        raise ValueError(f"batch {bad.batch} has {bad.m} deletes and {bad.i} inserts")
    rows = ops.where(F.col("op").isin("delete", "insert")).join(counts.select("batch", "m"), "batch").select(F.col("batch").cast("bigint").alias("batch"), "op", F.col("tag").cast("bigint").alias("tag"), "m")
    rows.repartition("batch").sortWithinPartitions("batch", "op", "tag").write.format("trace").mode("append").save(path)
