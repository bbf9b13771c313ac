"""Codes for vectors: each part of a vector is named by the nearest entry of that part's codebook, in whole numbers.

Components become integers, so sums and distances are exact and every run gives the same codes, whatever the order of rows
and the number of tasks. In each round the codebooks (PARTS times ENTRIES entries, as many numbers as ENTRIES vectors hold) are
broadcast; tasks read Arrow batches, find all distances to all entries by the expansion |x|^2 - 2 x.c + |c|^2 with integer
matrix products, take the first smallest one and add up the parts of each entry; these sums (PARTS * ENTRIES rows for a task,
however many vectors it reads) are merged by a grouped shuffle, and only the merged sums reach the driver.

Defined results: rows are left out whose vector is null, empty, holds null or non-finite components, or has another length
than the vector of the smallest id (a length that PARTS doesn't divide is an error); components beyond +-32768 (2^27 as integers)
count as that, so that no distance overflows; with fewer than ENTRIES ids the codebooks have fewer entries; rows that repeat an
id are encoded each, the least vector of an id starts the codebooks; rows whose id is null are encoded and learnt from, but
start none; null labels are equal; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components are held within this bound: of 2^28 at most between two, eight parts of eight squares fit into 62 bits.
BOUND = 1 << 27
#: Vectors whose distances are held at once.
STEP = 4096


def integers(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows that hold whole vectors, and their components as integers."""
    vectors = pa.array(vectors) if isinstance(vectors, pa.ChunkedArray) else vectors
    begins = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values
    usable = np.isfinite(x := flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    bad = np.concatenate([[0], np.cumsum(~usable)])
    whole = vectors.is_valid().to_numpy(zero_copy_only=False) & (np.diff(begins) > 0) & (bad[begins[1:]] == bad[begins[:-1]])
    ints = np.clip(np.floor(np.where(usable, x, 0.0) * scale), -BOUND, BOUND).astype("<i4")
    rows = np.flatnonzero(whole)
    return rows, [ints[a:b] for a, b in zip(begins[rows].tolist(), begins[rows + 1].tolist(), strict=True)]


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, size, x (32-bit integers, little-endian) of rows with whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ints = integers(batch.column(2), scale)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([len(x) for x in ints], pa.int32()), pa.array([x.tobytes() for x in ints], pa.binary())], ["vec_id", "label", "size", "x"])

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, size int, x binary")


def first_vectors(ints: DataFrame, n: int = ENTRIES) -> np.ndarray:
    """The vectors of the n smallest ids, ascending: n rows at most from each task, merged by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            # of a batch only its n smallest ids can count
            edge = np.unique(ids)[:n][-1] if len(ids) else 0
            for i in np.flatnonzero(ids <= edge).tolist():
                key, x = int(ids[i]), batch.column(1)[i].as_py()
                if key not in least or _order(x) < _order(least[key]):
                    least[key] = x
            for key in sorted(least)[n:]:
                del least[key]
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array([np.frombuffer(x, "<i4") for x in least.values()], pa.list_(pa.int32()))], ["id", "v"])

    found = ints.where("vec_id is not null").select("vec_id", "x").mapInArrow(run, "id bigint, v array<int>")
    rows = found.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(n).collect()
    return [np.array(r.v, np.int64) for r in rows]


def _order(x: bytes) -> tuple:
    return tuple(np.frombuffer(x, "<i4").tolist())


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (the first of equals) and its squared distance, for each part of each row.

    x: rows, parts, width; books: parts, entries, width; both of 64-bit integers.
    """
    cross = np.matmul(x.transpose(1, 0, 2), books.transpose(0, 2, 1))
    far = (x * x).sum(axis=2).T[:, :, None] - 2 * cross + (books * books).sum(axis=2)[:, None, :]
    best = far.argmin(axis=2)
    return best.T, np.take_along_axis(far, best[:, :, None], axis=2)[:, :, 0].T


def _blocks(column: pa.Array, parts: int) -> Iterator[np.ndarray]:
    """Integer vectors of equal size as 64-bit arrays of STEP rows, cut into parts."""
    for low in range(0, len(column), STEP):
        part = column.slice(low, STEP)
        x = np.frombuffer(b"".join(part.to_pylist()), "<i4").astype(np.int64)
        yield x.reshape(len(part), parts, -1)


def entry_sums(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, place, n (parts of the entry), total (of the components at that place)."""
    shared = ints.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for x in _blocks(batch.column(0), parts):
                best, _ = nearest(x, shared.value)
                for p in range(parts):
                    n[p] += np.bincount(best[:, p], minlength=entries)
                    np.add.at(total[p], best[:, p], x[:, p])
        part, entry = np.nonzero(n)
        place = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), np.repeat(n[part, entry], width), total[part, entry].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(place, ("i4", "i4", "i4", "i8", "i8"), strict=True)], ["part", "entry", "place", "n", "total"])

    found = ints.select("x").mapInArrow(run, "part int, entry int, place int, n bigint, total bigint")
    return found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def learn(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks (parts, entries, width) after `rounds` rounds; ints: integer_vectors() of one size."""
    start = first_vectors(ints, entries)
    if not start:
        return None
    if len(start[0]) % parts:
        raise ValueError(f"vectors of {len(start[0])} components can't be cut into {parts} equal parts")
    books = np.stack([x.reshape(parts, -1) for x in start], axis=1)
    for _ in range(rounds):
        new = books.copy()
        for r in entry_sums(ints, books).collect():  # as many numbers as `entries` vectors hold
            new[r.part, r.entry, r.place] = r.total // r.n
        if (new == books).all():
            break
        books = new
    return books


def encode(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits for each part), error (squared distance) of every row."""
    shared = ints.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], [np.empty(0, np.int64)]
            for x in _blocks(batch.column(2), len(books)):
                best, far = nearest(x, shared.value)
                codes += [row.tobytes().hex() for row in best.astype(np.uint8)]
                errors.append(far.sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(np.concatenate(errors))], ["vec_id", "label", "code", "error"])

    return ints.select("vec_id", "label", "x").mapInArrow(run, f"vec_id bigint, label {ints.schema['label'].dataType.simpleString()}, code string, error bigint")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error (of all rows with the label) and codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("two hexadecimal digits name up to 256 entries")
    ints = written(integer_vectors(df, id_col, vector_col, label_col, scale), "integer-vectors")
    least = ints.where("vec_id is not null").agg(F.min(F.struct("vec_id", "size")).alias("m")).first().m
    ints = ints.where(F.col("size") == (least.size if least else -1))
    books = learn(ints, parts, entries, rounds)
    if books is None:
        return encode(ints, np.zeros((1, 1, 1), np.int64)).limit(0).withColumns({"label_error": F.lit(0).cast("bigint"), "codebooks_sha256": F.lit("")})
    rows = written(encode(ints, books), "codes")
    # sums first: a label may hold a third of all rows; as a written table its size is known and Spark broadcasts it if it is small
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    found = rows.join(sums.withColumnRenamed("label", "own"), F.col("label").eqNullSafe(F.col("own"))).drop("own")
    return found.withColumn("codebooks_sha256", F.lit(digest(books)))
