"""Substring dedup by compaction of a De Bruijn graph of token k-mers.

The graph's edges are the k-mers of WINDOW words, its vertices the WINDOW - 1 words that two k-mers in a row share. A text is
cut into super-k-mers, runs of k-mers with the same minimizer (the least NODE-word k-mer in it), so that a run is one edge
whose two vertices are its first and last words and most k-mers never leave the task that read them. Joins by minimizer and by
two independent 64-bit hashes of an edge's words find the edges that more documents have. Where only the minimizer repeats, texts part
within the run: there every single k-mer becomes an edge. So a k-mer is found exactly if its words start in an
earlier document. Among the repeated edges, a vertex that one word leads into and one word leads out of doesn't branch: joins
with the degrees of their vertices tell where a path goes on, and a document's consecutive edges on one nonbranching path, with
the same source beside them, compact to one span with its source's coordinates. The words at these coordinates are read
and compared with the document's own (by SHA-256 of either): a span whose words differ doesn't count.

Defined results: null text has no words; rows that repeat a document id are judged each by its own text and only against
smaller ids (rows of one id with the same 32-bit hash of their text count as one); a row whose document id is null neither
removes nor loses words; texts under a window keep all words; an empty table gives no rows; a very
long text is hashed by itself, in memory that grows with it; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import flat, mix, slices, sums_by_place, written

WINDOW, NODE = 50, 20
#: Bytes of text that are hashed at once.
STEP = 1 << 20
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_EDGE = "doc_id bigint, tag int, at int, n int, node bigint, one bigint, two bigint, ends bigint, steps int"


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.bases, self.tables = (base, pow(base, -1, 1 << 64)), [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            for i, base in enumerate(self.bases):
                out = np.full(n, base, np.uint64)
                out[0] = 1
                self.tables[i] = np.multiply.accumulate(out)
        return self.tables


_POWERS = {_A: _Powers(_A), _B: _Powers(_B)}


class Stretches:
    """Hashes of any stretches of a row of numbers."""

    def __init__(self, values: np.ndarray, base: int):
        self.inverse = _POWERS[base].upto(len(values) + 1)[1]
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values + np.uint64(1)) * _POWERS[base].upto(len(values) + 1)[0][: len(values)], out=self.total[1:])

    def hashes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.total[high] - self.total[low]) * self.inverse[low] + (high - low).astype(np.uint64) * np.uint64(_B))


class Words:
    """The words of a slice of texts: where each begins and ends, and `first`, the number of the first word of each text."""

    def __init__(self, raw: np.ndarray, begins: np.ndarray):
        gap = np.ones(len(raw) + 1, bool)
        gap[:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.zeros(len(raw) + 1, bool)
        edge[begins] = True
        before = np.concatenate([[True], gap[:-1]]) | edge
        after = np.concatenate([gap[1:] | edge[1:], [True]])
        self.low, self.high = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
        self.first = np.searchsorted(self.low, begins)
        self.raw, self.gap = raw, gap[:-1]

    def streams(self) -> tuple[Stretches, Stretches]:
        """Two streams of words, each from a hash of its own of the words' bytes."""
        one, two = sums_by_place(self.raw, self.low, self.gap)
        return Stretches(mix(one), _A), Stretches(mix(two), _B)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n in a row."""
    span = 1
    while 2 * span <= n:
        x, span = np.minimum(x[: len(x) - span], x[span:]), 2 * span
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


def edges_of(words: Words, window: int, node: int) -> tuple[np.ndarray, ...]:
    """For each edge: the text it is in, its first k-mer there, how many k-mers, its minimizer, two hashes of its words, its
    vertices (in 32 bits each) and the words that lead out of the first and into the last (in 16 bits each)."""
    one, two = words.streams()
    n = len(words.low)
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 4 + (np.empty(0, np.uint32),)
    if n < window:
        return none
    at = np.arange(n - node + 1)
    least = _least(one.hashes(at, at + node), window - node + 1)
    text = np.searchsorted(words.first, np.arange(n), "right") - 1
    start = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if not len(start):
        return none
    least = least[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
    since = np.arange(len(start)) - np.maximum.accumulate(np.where(fresh, np.arange(len(start)), 0))
    cut = np.flatnonzero(since % (window - node + 1) == 0)
    size = np.diff(np.append(cut, len(start)))
    low = start[cut]
    high = low + size - 1 + window
    return text[low], low - words.first[text[low]], size, least[cut], one.hashes(low, high), two.hashes(low, high), *_ends(one, low, high, window)


def _ends(one: Stretches, low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    half, quarter = np.uint64(32), np.uint64(48)
    out, into = one.hashes(low + window - 1, low + window) >> quarter, one.hashes(high - window, high - window + 1) >> quarter
    return (one.hashes(low, low + window - 1) >> half << half) | (one.hashes(high - window + 1, high) >> half), (out << np.uint64(16) | into).astype(np.uint32)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """tag tells apart rows that repeat a document id."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.hash(text_col).alias("tag"), F.col(text_col).alias("text"))


def edges(rows: DataFrame, window: int = WINDOW, node: int = NODE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begins = flat(batch.column("text"))
            for low, high in slices(begins, STEP):
                own = begins[low : high + 1]
                text, at, size, *hashes = edges_of(Words(raw[own[0] : own[-1]], own - own[0]), window, node)
                take = pa.array(text + low)
                columns = [batch.column("doc_id").take(take), batch.column("tag").take(take), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))]
                columns += [pa.array(x.view(f"i{x.itemsize}")) for x in hashes]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "at", "n", "node", "one", "two", "ends", "steps"])

    return rows.where("doc_id is not null").mapInArrow(run, _EDGE)


def _in_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows with the spans (doc_id, tag, at, n) in them, as a list. Spans have no size bound, so they never broadcast."""
    grouped = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    return rows.join(grouped.hint("merge"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "spans")


def _repeats(batch: pa.RecordBatch) -> np.ndarray:
    """True for rows that repeat the row before them (rows come from a merge join, so equal keys lie together)."""
    ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
    return np.append(False, (ids[1:] == ids[:-1]) & (tags[1:] == tags[:-1]))[: len(ids)]


def _kmers(rows: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """An edge for each single k-mer in the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begins = flat(batch.column("text"))
            again = _repeats(batch)
            for low, high in slices(begins, STEP):
                own = begins[low : high + 1]
                words = Words(raw[own[0] : own[-1]], own - own[0])
                one, two = words.streams()
                found = [(i, s["at"], s["n"]) for i in range(low, high) if not again[i] for s in batch.column("spans")[i].as_py()]
                if not found:
                    continue
                text, begin, n = (np.array(x, np.int64) for x in zip(*found, strict=True))
                at = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
                text = np.repeat(text, n)
                place = at + words.first[text - low]
                take = pa.array(text)
                hashes = one.hashes(place, place + window), two.hashes(place, place + window), *_ends(one, place, place + window, window)
                columns = [batch.column("doc_id").take(take), batch.column("tag").take(take), pa.array(at.astype(np.int32)), pa.array(np.ones(len(at), np.int32)), pa.array(np.zeros(len(at), np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x.view(f"i{x.itemsize}")) for x in hashes)], ["doc_id", "tag", "at", "n", "node", "one", "two", "ends", "steps"])

    return _in_spans(rows, spans).mapInArrow(run, _EDGE)


def _sources(found: DataFrame, *more) -> DataFrame:
    """one, two, ends, steps, source (the least document that has the edge, and where) and last (the largest one) of each edge."""
    place = F.min(F.struct("doc_id", "tag", "at")).alias("source")
    return found.groupBy("one", "two").agg(place, F.max("doc_id").alias("last"), F.min("ends").alias("ends"), F.min("steps").alias("steps"), *more)


def goes_on(graph: DataFrame) -> DataFrame:
    """one, two, on: whether the path of each edge (one, two, ends, steps) goes on behind it: one word alone leads into its last vertex, and one out of it."""
    named = graph.select("one", "two", F.shiftright("ends", 32).alias("first"), F.shiftright(F.shiftleft("ends", 32), 32).alias("vertex"), F.shiftright("steps", 16).alias("out"), F.shiftright(F.shiftleft("steps", 16), 16).alias("into"))
    alone = lambda vertex, step: named.groupBy(F.col(vertex).alias("vertex")).agg(F.min(step).alias("a"), F.max(step).alias("b")).where("a = b").select("vertex")
    plain = written(alone("vertex", "into").join(alone("first", "out"), "vertex").withColumn("on", F.lit(True)), "plain-vertices")
    return named.join(plain, "vertex", "left").select("one", "two", F.coalesce("on", F.lit(False)).alias("on"))


def compact(spans: DataFrame) -> DataFrame:
    """Join edges that follow each other in a document, on one path and with sources that follow each other too, into one span."""
    order = Window.partitionBy("doc_id", "tag").orderBy("at", "n")
    moved = F.struct("source.doc_id", "source.tag", (F.col("source.at") - F.col("at")).alias("by"))
    rows = spans.select("doc_id", "tag", "at", "n", "on", moved.alias("moved")).repartition("doc_id", "tag").dropDuplicates(["doc_id", "tag", "at", "n"])
    before = lambda c: F.lag(c).over(order)
    fresh = F.when(before("on") & (before("moved") == F.col("moved")) & (before(F.col("at") + F.col("n")) == F.col("at")), 0).otherwise(1)
    numbered = rows.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order))
    joined = numbered.groupBy("doc_id", "tag", "span").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"), F.first("moved").alias("moved"))
    source = F.struct("moved.doc_id", "moved.tag", (F.col("at") + F.col("moved.by")).alias("at"))
    return joined.select("doc_id", "tag", "at", "n", source.alias("source"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, node: int = NODE) -> DataFrame:
    """doc_id, tag, at, n, source: n k-mers from word `at` on that start in smaller document ids too, the least being source.doc_id, where they start at word source.at."""
    rows = _documents(docs, id_col, text_col)
    found = written(edges(rows, window, node), "edges")
    # each table that several rows of a hot key meet is written before the join, which can then split that key
    shared = written(found.groupBy("node").agg(F.min("doc_id").alias("node_first"), F.max("doc_id").alias("node_last")).where("node_first < node_last").drop("node_last"), "shared-nodes")
    among = written(found.join(shared, "node"), "shared-edges")
    first = written(_sources(among, F.min("node").alias("node"), F.min("node_first").alias("node_first")), "distinct-edges")
    placed = written(among.drop("node_first").join(first.select("one", "two", "source"), ["one", "two"]), "placed-edges")
    # an edge's first document may have its k-mers from earlier ones, where the edges at its minimizer differ
    parted = written(first.where("node_first < source.doc_id").select("node").distinct(), "parted-nodes")
    single = placed.where("source.doc_id = doc_id").join(parted, "node", "left_semi")
    kmers = written(_kmers(rows, single, window), "k-mers")
    starts = written(_sources(kmers).where("source.doc_id < last"), "distinct-k-mers")
    graph = first.where("source.doc_id < last").select("one", "two", "ends", "steps").union(starts.select("one", "two", "ends", "steps"))
    named = written(goes_on(graph), "path-edges")
    columns = ["doc_id", "tag", "at", "n", "one", "two", "source"]
    again = placed.select(*columns).union(kmers.join(starts.select("one", "two", "source"), ["one", "two"]).select(*columns)).where("source.doc_id < doc_id")
    return compact(again.join(named, ["one", "two"]))


def _digest(words: list[bytes], at: int, n: int, window: int) -> bytes:
    return hashlib.sha256(b" ".join(words[at : at + n + window - 1])).digest()


def _source_words(rows: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, at, n, words: SHA-256 of the words at each distinct source's coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in np.flatnonzero(~_repeats(batch)).tolist():
                text, spans = (batch.column(name)[i].as_py() for name in ("text", "spans"))
                words = text.encode().split()  # of bytes: at ASCII white space alone
                size = len(spans)
                columns = [pa.array([batch.column(c)[i].as_py()] * size, t) for c, t in (("doc_id", pa.int64()), ("tag", pa.int32()))] + [pa.array([s[c] for s in spans], pa.int32()) for c in ("at", "n")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([_digest(words, s["at"], s["n"], window) for s in spans], pa.binary())], ["doc_id", "tag", "at", "n", "words"])

    sources = spans.select("source.doc_id", "source.tag", "source.at", "n").distinct()
    return _in_spans(rows, sources).mapInArrow(run, "doc_id bigint, tag int, at int, n int, words binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, node: int = NODE) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the other words, joined by one space) of every row."""
    rows = _documents(docs, id_col, text_col)
    spans = written(repeated_spans(docs, id_col, text_col, window, node), "spans")
    sources = written(_source_words(rows, spans, window), "source-words").select(F.struct("doc_id", "tag", "at").alias("source"), "n", "words")
    read = spans.join(sources, ["source", "n"]).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n", "words")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()
                cover = np.zeros(len(words) + 1, np.int32)
                for s in spans.as_py() or ():
                    if _digest(words, s["at"], s["n"], window) == s["words"]:
                        cover[s["at"]] += 1
                        cover[s["at"] + s["n"] + window - 1] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                counts.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(read.hint("merge"), ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
