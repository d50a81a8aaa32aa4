"""Vector compression by product codes: codebooks of integer entries, found by an exact search in balls around entries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import narrow
from .store import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components are below this, so that squared distances of up to 256 positions are exact in 64 bits.
LIMIT = 1 << 26
#: Components that a task searches for at a time.
PASS = 1 << 20


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Components as integers, rounded down; an error if one is LIMIT or more from 0."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * scale))
    large = F.exists(x, lambda v: F.abs(v) >= LIMIT)
    return F.when(large, F.raise_error(F.lit(f"a component times {scale} is {LIMIT} or more"))).otherwise(x).cast("array<int>")


def usable(vector: Column) -> Column:
    """No null, and neither null nor infinite nor undefined components."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))


def balls(books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of each part all entries of the part by distance from it (ties by index), and those squared distances."""
    off = books[:, :, None, :] - books[:, None, :, :]
    far = (off * off).sum(3)
    near = np.argsort(far, axis=2, kind="stable")
    return near, np.take_along_axis(far, near, 2)


def nearest(x: np.ndarray, start: np.ndarray, books: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (rows, parts, width), start (rows, parts) -> index and squared distance of each part's nearest entry, the lowest index on ties.

    With u the distance to the start entry and v the least one so far, an entry no farther than v is within u + v of the start,
    and (u + v)^2 <= 2 (u^2 + v^2): whole numbers decide when a start's list, sorted by distance, holds nothing more."""
    rows, parts, width = x.shape
    x, part, at = x.reshape(-1, width), np.tile(np.arange(parts), rows), start.reshape(-1).astype(np.int64)
    off = x - books[part, at]
    first = (off * off).sum(1)
    index, least, live = at.copy(), first.copy(), np.arange(len(at))
    for j in range(books.shape[1]):
        live = live[far[part[live], at[live], j] <= 2 * (first[live] + least[live])]
        if not len(live):
            break
        entry = near[part[live], at[live], j]
        off = x[live] - books[part[live], entry]
        d = (off * off).sum(1)
        better = (d < least[live]) | ((d == least[live]) & (entry < index[live]))
        index[live[better]], least[live[better]] = entry[better], d[better]
    return index.reshape(rows, parts), least.reshape(rows, parts)


def cells(column: pa.Array, parts: int) -> np.ndarray:
    """A list column as (rows, parts, width), filled up with zeros to a multiple of parts."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)
    width = -(-flat.shape[1] // parts)
    return np.pad(flat, ((0, 0), (0, parts * width - flat.shape[1]))).reshape(rows, parts, width)


def _slices(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            step = max(1, PASS // max(1, len(batch.column("_x")[0])))
            for a in range(0, batch.num_rows, step):
                piece = batch.slice(a, step)
                yield piece, cells(piece.column("_x"), parts)


def _assign(books: np.ndarray) -> Callable:
    near, far = balls(books)
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _slices(batches, parts):
            start = np.frombuffer(b"".join(piece.column("_code").to_pylist()), np.uint8).reshape(len(x), parts)
            code, error = nearest(x, start, books, near, far)
            fresh = [bytes(c) for c in code.astype(np.uint8)]
            yield pa.record_batch([piece.column("vec_id"), piece.column("label"), piece.column("_x"), pa.array(fresh, pa.binary()), pa.array(error.sum(1), pa.int64())], names=["vec_id", "label", "_x", "_code", "error"])

    return run


def assigned(df: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, _x, _code -> the same with the nearest entries in _code and the squared distance in error; _code is where the search starts."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(_assign(books), f"vec_id {kind['vec_id']}, label {kind['label']}, _x array<int>, _code binary, error long")


def _sums(shape: tuple[int, int, int]) -> Callable:
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for piece, x in _slices(batches, parts):
            code = np.frombuffer(b"".join(piece.column("_code").to_pylist()), np.uint8).reshape(len(x), parts)
            at = (np.broadcast_to(np.arange(parts), code.shape), code)
            np.add.at(total, at, x)
            np.add.at(n, at, 1)
        cell = np.flatnonzero(np.repeat(n.reshape(-1), width))
        yield pa.record_batch([pa.array(cell, pa.int64()), pa.array(total.reshape(-1)[cell], pa.int64()), pa.array(np.repeat(n.reshape(-1), width)[cell], pa.int64())], names=["cell", "total", "n"])

    return run


def moved(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the mean of its parts, rounded down; unused ones stay.  Tasks send one sum for each entry's position."""
    sums = coded.select("_x", "_code").mapInArrow(_sums(books.shape), "cell long, total long, n long")
    out = books.reshape(-1).copy()
    for r in sums.groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def prepared(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, _x of the usable vectors."""
    own = narrow(vectors, "vec_id", "label", vector).filter(usable(F.col(vector)))
    return own.select("vec_id", "label", whole(F.col(vector), scale).alias("_x"))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vectors (vec_id, label, a vector) -> vec_id, label, code, error of all usable ones, and the codebooks (part, entry, position).

    Components times `scale` become integers, vectors `parts` equal parts (filled up with zeros if they aren't divisible).  The
    codebooks start as the parts of the `entries` smallest vec_ids; each of `rounds` rounds assigns all parts and moves the
    entries, then parts are assigned once more.  A search starts at the entry of the round before (in the first at
    entry 0) and scans that entry's neighbours by distance as far as one can be nearer; all distances are
    whole numbers and ties go to the lower index.  What a round needs of the driver is the codebooks, whose size is fixed; every
    round is a written table, so a lost executor costs a part of one.

    Dropped: null vectors, those with null or non-finite components, and those not as long as that of the smallest vec_id,
    which share no codebook with it.  A null vec_id comes after all others, rows that repeat one are vectors of their own (in order of
    their components).  A null label is a label.  An empty table gives an empty one and empty books; a component of LIMIT or more
    raises an error.  `entries` is at most 256; other columns aren't read."""
    if entries > 256:
        raise ValueError("an entry's index must fit a byte")
    order = [F.col("vec_id").asc_nulls_last(), F.col("_x")]
    base = cut(prepared(vectors, vector, scale))
    first = base.orderBy(*order).limit(1).collect()
    length = len(first[0]["_x"]) if first else 0
    base = base.filter(F.size("_x") == length)
    seeds = [r["_x"] for r in base.orderBy(*order).limit(entries).collect()]
    books = cells(pa.array(seeds, pa.list_(pa.int32())), parts).transpose(1, 0, 2).copy() if seeds and length else np.zeros((parts, len(seeds), 0), np.int64)
    now = base.withColumn("_code", F.lit(bytes(parts)))
    if not length:
        return now.select("vec_id", "label", F.col("_code").alias("code"), F.lit(0).cast("long").alias("error")), books
    for _ in range(rounds):
        now = cut(assigned(now, books).drop("error"))
        books = moved(now, books)
    return assigned(now, books).select("vec_id", "label", F.col("_code").alias("code"), "error"), books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """vec_id, label, code, error of further vectors under codebooks of train()."""
    length = books.shape[0] * books.shape[2]
    own = prepared(vectors, vector, scale).filter((F.size("_x") > length - books.shape[0]) & (F.size("_x") <= length))
    return assigned(own.withColumn("_code", F.lit(bytes(len(books)))), books).select("vec_id", "label", F.col("_code").alias("code"), "error")


def by_label(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over the rows of the same label, nulls together: one row for each label meets the rows."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
