"""Vector code compression: codebooks of vector parts in whole numbers, and the codes they give.

Vectors become columns of NumPy blocks, a row of a stored table each. A round is one
``treeAggregate`` over an RDD of blocks, whose result is a sum and a count an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspan.session import importable

from .common import attach, pick, stored, trimmed

#: Vectors a block.
BLOCK = 4096
#: The largest component, after scaling, for which squared distances of a vector are sure to fit 64 bits.
MOST = 1 << 26


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers."""
    out = np.floor(vectors.astype(np.float64) * scale)
    if out.size and np.abs(out).max() > MOST:
        raise ValueError(f"a component is beyond {MOST // scale}")
    return out.astype(np.int64)


def nearest_entries(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each column of ``part``; ties go to the lower index.

    ``part`` is (components, vectors); distances accumulate component by component.
    """
    total = np.zeros((part.shape[1], len(entries)), np.int64)
    for column, values in zip(part, entries.T, strict=True):
        apart = column[:, None] - values[None, :]
        total += apart * apart
    index = total.argmin(1)
    return index, total[np.arange(len(index)), index]


def opened(data: bytes, dim: int) -> np.ndarray:
    """A block's (components, vectors) numbers."""
    return np.frombuffer(data, "<i4").reshape(dim, -1).astype(np.int64)


def moved(blocks: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, components) after a round: each entry the floor of the mean of its parts; unused ones stay."""
    parts, _, size = book.shape
    shared = blocks.sparkSession.sparkContext.broadcast(book)

    def add(total: tuple, data: bytes) -> tuple:
        sums, counts = total
        columns = opened(data, parts * size)
        for p in range(parts):
            part = columns[p * size : (p + 1) * size]
            index, _ = nearest_entries(part, shared.value[p])
            for c in range(size):
                np.add.at(sums[p, :, c], index, part[c])
            np.add.at(counts[p], index, 1)
        return sums, counts

    def merge(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1]

    zero = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)
    sums, counts = blocks.select("data").rdd.map(lambda r: bytes(r.data)).treeAggregate(zero, add, merge)
    shared.unpersist()
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], book)


def compress(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of each vector, and the codebooks (parts, entries, components).

    Components become floor(scale * x), vectors are cut into equal parts, and each part position
    has a codebook. It starts as that part of the vectors with the ``entries`` smallest ids (fewer
    where there are fewer; nulls come last, and rows that share an id go by their vectors). After
    ``rounds`` of assignment and means, code has the number of each part's nearest entry in
    hexadecimal, two digits a part; error is the sum of the squared distances, label_error
    that sum over all vectors of the label, those without one together.

    Left out are vectors that are null, that hold a null or non-finite component, or that differ
    in length from the one with the smallest id. Vectors of no components have code 0 and error 0
    throughout. A length that doesn't divide into the parts, more than 256 entries, or a component
    so large that sums might not fit 64 bits is an error. Rows that repeat an id or a vector give
    a row each; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    import pyarrow as pa

    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = pick(table, id=id_col, label=label_col, v=vec_col)
    spark = importable(rows.sparkSession)
    x = F.col("v").cast("array<double>")
    fine = F.col("v").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.select("id", "label", x.alias("v")).where(fine)
    first = rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    dim = len(first[0].v) if first else 0
    if dim % parts:
        raise ValueError(f"{dim} components don't divide into {parts} parts")
    first = [r.v for r in first if len(r.v) == dim]
    book = whole_numbers(np.array(first, np.float64).reshape(len(first), dim), scale).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                data = np.ascontiguousarray(whole_numbers(v, scale).T).astype("<i4").tobytes()
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in (part.column(0), part.column(1))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([data], pa.binary())], names=["ids", "labels", "data"])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                v = np.frombuffer(batch.column(2)[i].as_py(), "<i4").reshape(dim, len(ids)).astype(np.int64)
                found, error = np.empty((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p in range(parts):
                    found[:, p], far = nearest_entries(v[p * (dim // parts) : (p + 1) * (dim // parts)], of[p])
                    error += far
                text = found.tobytes().hex()
                code = [text[a : a + 2 * parts] for a in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    blocks = stored(rows.where(F.size("v") == dim).mapInArrow(trimmed(columns), f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, data binary"))
    for _ in range(rounds if first and dim else 0):
        book = moved(blocks, book)
    shared = spark.sparkContext.broadcast(book)
    coded = stored(blocks.mapInArrow(trimmed(codes), f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return attach(coded, stored(sums), "label"), book


def decode(codes: DataFrame, book: np.ndarray, scale: int = 256, code_col: str = "code", out_col: str = "decoded") -> DataFrame:
    """Adds the vector that a code stands for: its entries' components, each in the middle of what floor made one number."""

    def entry(p: int) -> Column:
        entries = F.lit([[(float(x) + 0.5) / scale for x in e] for e in book[p].tolist()]) if book[p].size else F.array().cast("array<array<double>>")
        return F.get(entries, F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int"))

    return codes.withColumn(out_col, F.concat(*[entry(p) for p in range(book.shape[0])]))


def fingerprint(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
