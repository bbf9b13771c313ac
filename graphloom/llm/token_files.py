"""Token-ID output as directly addressable codes: any token can be read without decoding a block.

A file holds segments, one per row: the documents' ids and token counts, and `payload`, which is laid out as

    "DAC1", n_tokens (u64), n_levels (u8), then for each level its length (u64), its chunks (one byte per number),
    and, unless it is the last, a continuation bitmap (a bit per number, lowest bit first) and a rank directory
    (u32: the ones before each block of 512 bits).

Level 0 has the lowest 8 bits of every id; a number whose bit is set goes on in the next level, at the rank of that bit.
All numbers are little-endian.

Defined results: null text is empty and gives the end id alone; null document ids come first; rows that repeat a document id
stay, ordered by text; a very long text is encoded in memory that grows with it and fills a segment of its own; an empty
table gives files without rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.tokens import VOCABULARY, PieceEncoder, encoded

MAGIC, BLOCK = b"DAC1", 512
SEGMENTS = "part int, segment int, doc_ids array<bigint>, doc_tokens array<bigint>, n_tokens bigint, payload binary"
DECODED = "part int, segment int, doc_id bigint, local_start bigint, n_tokens bigint, ids binary"


def pack_levels(ids: np.ndarray) -> bytes:
    """A segment's payload."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks, rest = (rest & 255).astype(np.uint8), rest >> 8
        more = rest > 0
        if not more.any():
            levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes())
            break
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more]
    return MAGIC + struct.pack("<QB", len(ids), len(levels)) + b"".join(levels)


class Segment:
    """Reads a payload: one token, a range, or all."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.n_tokens, n_levels = struct.unpack_from("<QB", payload, 4)
        at, self.levels = 13, []
        for level in range(n_levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            chunks, at = np.frombuffer(payload, np.uint8, n, at + 8), at + 8 + n
            bits = ranks = None
            if level < n_levels - 1:
                bits, at = np.frombuffer(payload, np.uint8, -(-n // 8), at), at + -(-n // 8)
                ranks, at = np.frombuffer(payload, "<u4", -(-n // BLOCK), at), at + 4 * -(-n // BLOCK)
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        """One id: a chunk per level, the way to the next by the rank directory and at most 64 bytes of the bitmap."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * level)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            within = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(ranks[block]) + int(within.sum())
        return out

    def tokens(self, low: int, high: int) -> list[int]:
        return [self.token(i) for i in range(low, high)]

    def all(self) -> np.ndarray:
        out = np.zeros(self.n_tokens, np.uint32)
        at: np.ndarray | None = None
        for level, (chunks, bits, _) in enumerate(self.levels):
            value = chunks.astype(np.uint32) << np.uint32(8 * level)
            if at is None:
                out = value
            else:
                out[at] |= value
            if bits is not None:
                own = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
                at = own if at is None else at[own]
        return out


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> None:
    """Encode whole texts and write segments in ascending document order; part and segment number that order."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment, encoder = TaskContext.get().partitionId(), 0, PieceEncoder(vocabulary)
        for batch in batches:
            keys = batch.column(0)
            for low, ids, counts in encoded(batch.column(1), encoder):
                rows = [[part], [segment], [keys.slice(low, len(counts)).to_pylist()], [counts.tolist()], [len(ids)], [pack_levels(ids)]]
                kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["part", "segment", "doc_ids", "doc_tokens", "n_tokens", "payload"])
                segment += 1

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "zstd").parquet(path)


def decode_segments(segments: DataFrame) -> DataFrame:
    """Per document: where it begins in its segment, its token count, and its ids as little-endian unsigned 32-bit."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                ids = Segment(batch.column(5)[i].as_py()).all().astype("<u4")
                ends = np.cumsum(counts)
                places = np.concatenate([[0], 4 * ends]).astype(np.int32)
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column(0)[i].as_py(), np.int32)),
                        pa.array(np.full(n, batch.column(1)[i].as_py(), np.int32)),
                        batch.column(2)[i].values,
                        pa.array(ends - counts),
                        pa.array(counts),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(places), pa.py_buffer(ids)]),
                    ],
                    ["part", "segment", "doc_id", "local_start", "n_tokens", "ids"],
                )

    return segments.mapInArrow(decode, DECODED)


def segment_starts(segments: DataFrame) -> DataFrame:
    """part, segment, base: the tokens of all segments before. Sums of parts meet in one window, a row for each part."""
    sizes = segments.select("part", "segment", "n_tokens")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    base = F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.join(parts.select("part", base.alias("part_base")), "part").select("part", "segment", (before + F.col("part_base")).alias("base"))
