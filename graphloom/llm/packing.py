"""Packing: shortest-pack-first over the histogram of lengths, then patterns joined back to pieces by rank.

Documents become pieces of at most `capacity` tokens: whole windows of that length and one rest. The histogram of lengths
(at most `capacity` entries, whatever the corpus holds) is packed on the driver: lengths longest first, each put on the
shortest open packs that still have room, many at a time by updating the counts of packing patterns. A piece finds its place
by its rank among the pieces of its length: its number in its partition plus the counts of the partitions before it. Texts
never move; only (partition, length) counts and one narrow row for each piece are shuffled.

Defined results: null text is empty (one piece with the end id); repeated rows are packed once each; an empty table gives no
rows; null document ids are kept; a very long text becomes windows one after the other; columns beside the named ones
are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.tokens import VOCABULARY, PieceEncoder, encoded

CAPACITY = 1024
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, part int, nth bigint"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of all documents with their ids (little-endian unsigned 32-bit); `nth` numbers those of a length in a partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seen = TaskContext.get().partitionId(), PieceEncoder(vocabulary), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for low, ids, counts in encoded(batch.column(1), encoder):
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, counts[doc] - start)
                order = np.argsort(length, kind="stable")
                run = length[order]
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(run)) - np.searchsorted(run, run) + seen[run]
                seen += np.bincount(length, minlength=capacity + 1)
                places = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(counts)).take(pa.array(doc)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(counts[doc]),
                        pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(places), pa.py_buffer(ids.astype("<u4"))]),
                        pa.array(np.full(len(length), part, np.int32)),
                        pa.array(nth),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "ids", "part", "nth"],
                )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern. At most one more pattern for each length, so the result is bounded by capacity."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            room = max((r for r, packs in open_.items() if packs and r >= length), default=None)
            if room is None:  # no open pack takes it
                fits = capacity // length
                if whole := left // fits:
                    open_[capacity - fits * length].append((whole, (length,) * fits))
                if rest := left % fits:
                    open_[capacity - rest * length].append((1, (length,) * rest))
                break
            count, pattern = open_[room].pop()
            used = min(count, left)
            open_[room - length].append((used, (*pattern, length)))
            if count > used:
                open_[room].append((count - used, pattern))
            left -= used
    return [x for room in sorted(open_) for x in open_[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each slot, the sequence that takes it, and the place in that sequence."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for count, pattern in patterns:
        place = 0
        for length in pattern:
            found[length].append((taken[length], base, place))
            taken[length] += count
            place += length
        base += count
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset. `pieces` (a written table, as it is read twice) has length, part and nth."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = slots(shortest_pack_first(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length).tolist():
                own = np.flatnonzero(length == value)
                first, base, at = table[value]
                slot = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = base[slot] + rank[own] - first[slot], at[slot]
            names = [n for n in batch.schema.names if n not in ("rank", "part", "nth")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kept = [f for f in pieces.schema.fields if f.name not in ("part", "nth")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth")).drop("first")
    return ranked.select(*(f.name for f in kept), "part", "nth", "rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens and the ids of its pieces in order. A sequence has few pieces."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return rows.select("sequence_id", "n_tokens", F.expr("aggregate(pieces, X'', (a, p) -> a || p.ids)").alias("ids"))
