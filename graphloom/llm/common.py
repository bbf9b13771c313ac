"""Small helpers that the operators share: inputs, written tables, and texts as flat Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none (local runs and tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder and read them back.

    A lost executor then costs no more than the stage that runs; a table that feeds two branches is computed once.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_one(docs: DataFrame, name: str = "row", leave: tuple[str, ...] = ()) -> Column:
    """All columns of docs (but for those to leave out) as one struct with names of its own, so that no column can clash with what an operator adds."""
    kept = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in leave]
    return F.struct(*kept or [F.lit(0).alias("none")]).alias(name)


def columns_of(docs: DataFrame, name: str = "row", **instead: Column) -> list[Column]:
    """The columns of docs out of as_one(docs), under their names; `instead` gives another value for some."""
    return [instead.get(c, F.col(f"{name}.c{i}")).alias(c) for i, c in enumerate(docs.columns)]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more entry than texts). Null counts as empty."""
    texts = pa.array(texts).cast(pa.large_string()).fill_null("")
    begins = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[begins[0] : begins[-1]], begins - begins[0]


def slices(begins: np.ndarray, most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` texts that hold about `most` bytes each (a longer text stands alone), so that memory stays bounded."""
    low, n = 0, len(begins) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(begins, begins[low] + most, "right")) - 1)
        high = min(high, low + rows, n)
        yield low, high
        low = high


#: Two random numbers for each byte at each place in a piece of text.
PLACES = 64
_NUMBERS = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, (2, PLACES * 256), np.uint64)


def sums_by_place(raw: np.ndarray, begin: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each piece: sums of random numbers that stand for its bytes at their places.

    A piece ends where the next begins; bytes marked in `skip` don't count.
    """
    if not len(begin):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    raw, begin, skip = raw[begin[0] :], begin - begin[0], None if skip is None else skip[begin[0] :]
    place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    far = np.flatnonzero(place >= PLACES)
    turn = (place[far] // PLACES).astype(np.uint64)
    index = (place % PLACES << 8) | raw
    out = []
    for numbers in _NUMBERS:
        value = numbers[index]
        if len(far):  # places beyond the table: its numbers mixed with how often it was passed
            value[far] = mix(value[far] + turn * np.uint64(0x9E3779B97F4A7C15))
        if skip is not None:
            value[skip] = 0
        out.append(np.add.reduceat(value, begin))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def ragged(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions begins[0], begins[0]+1, ... of runs laid end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths)
