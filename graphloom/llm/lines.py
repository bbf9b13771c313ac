"""Fuzzy line dedup by MinHash, keeping one line of each component.

Lines are stripped of ASCII white space at both ends and told apart by a 64-bit hash. The character shingles of each distinct
line give a one-permutation MinHash signature, and BANDS bands of ROWS values put similar lines into a common bucket (README
has the recall measured by length). In a bucket every line is compared with one of them by the exact Jaccard similarity of
their shingle sets. Buckets whose lines are then still in different components are compared in full, pairs that are in one
component already left out, so every candidate pair either is verified or can't change a component. Of open buckets above
TILE lines only pairs that can be similar meet: a line's cells are its rarest shingles, as many as any similar line can't
all miss (an exact prefix filter).
Of each component the first line (by document id, then line number) stays.

Defined results: null texts are empty; lines that are empty after stripping always stay and are never compared; lines shorter
than a shingle are one shingle; rows that repeat a document id and text count as one document; null document ids
come last; very long texts and lines are hashed by themselves; an empty table gives no rows; other columns are kept. Two different lines, or two texts of one id, with
the same 64-bit hash share their fate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import as_one, columns_of, written
from graphloom.llm.components import components

SHINGLE, BANDS, ROWS, LEAST, TILE = 8, 12, 5, 0.8, 512
#: Characters of lines that are hashed at once; lines that a task remembers so as not to hash them again; rows sorted at once.
STEP, REMEMBERED, HELD = 1 << 16, 1 << 20, 1 << 21
_NONE = np.iinfo(np.uint64).max


def _id(line: str) -> int:
    x = xxhash.xxh64_intdigest(line.encode())
    return x - (1 << 64) if x >> 63 else x


def line_list(text: str | None) -> list[str]:
    """The lines of a text, stripped; empty ones stay in place."""
    return [x.strip(" \t\n\r\x0b\x0c") for x in (text or "").split("\n")]


def shingles(line: str, k: int = SHINGLE) -> frozenset[str]:
    return frozenset([line[i : i + k] for i in range(max(1, len(line) - k + 1))])


def jaccard(a: frozenset[str], b: frozenset[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def shingle_hashes(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The line and the hash of each shingle, repeats included, of lines that aren't empty."""
    padded = [x if len(x) >= k else x.ljust(k, "\0") for x in lines]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4").astype(np.uint64)
    hashed = code[: len(code) - k + 1].copy()
    for j in range(1, k):
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        hashed += code[j : len(code) - k + 1 + j]
    for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        hashed ^= hashed >> np.uint64(shift)
        hashed *= np.uint64(factor)
    count = size - k + 1
    low = np.arange(count.sum()) + np.repeat(np.cumsum(size) - size - np.cumsum(count) + count, count)
    return np.repeat(np.arange(len(lines)), count), hashed[low]


def band_hashes(lines: list[str], k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A row of `bands` hashes for each (not empty) line."""
    own, hashed = shingle_hashes(lines, k)
    bins = bands * rows
    signature = np.full(len(lines) * bins, _NONE, np.uint64)
    # the upper bits choose the bin, so the value is mixed again
    np.minimum.at(signature, own * bins + ((hashed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64), hashed * np.uint64(0xD6E8FEB86659FD93))
    signature = signature.reshape(len(lines), bins)
    if (signature == _NONE).any():  # an empty bin takes the value of the next one that isn't
        place = np.where(np.tile(signature, 2) != _NONE, np.arange(2 * bins), 2 * bins)
        place = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :bins]
        signature = np.take_along_axis(signature, place % bins, axis=1) + (place - np.arange(bins)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.zeros((len(lines), bands), np.uint64)
    for r in range(rows):  # a band's bins are adjacent: a shingle that differs spoils a run of bins, so in short lines few bands
        mixed = (mixed ^ signature[:, r::rows]) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
    return mixed + np.arange(bands, dtype=np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)


def _shingle_keys(lines: list[str]) -> tuple[np.ndarray, np.uint64]:
    """Each line's distinct shingles as sorted numbers, the line's number in the lowest bits, and these bits; the others are a hash."""
    own, hashed = shingle_hashes(lines)
    width = np.uint64(max(1, (len(lines) - 1).bit_length()))
    keys = np.sort(hashed >> width << width | own.astype(np.uint64))
    return keys[np.append(True, keys[1:] != keys[:-1])], (np.uint64(1) << width) - np.uint64(1)


def pair_counts(one: list[str], two: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of lines how many distinct shingles either has, and how many they have in common, by hashes."""
    (a, low), (b, _) = _shingle_keys(one), _shingle_keys(two)
    both = np.sort(np.concatenate([a, b]))
    both = both[1:][both[1:] == both[:-1]]
    n, m, k = (np.bincount((x & low).astype(np.int64), minlength=len(one)) for x in (a, b, both))
    return n, m, k


def common_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles each line has, and how many each two have in common, by hashes."""
    keys, low = _shingle_keys(lines)
    own, column = (keys & low).astype(np.int64), np.cumsum(np.append(False, (keys[1:] ^ keys[:-1]) > low))
    size, shared = np.bincount(own, minlength=len(lines)), np.bincount(column) > 1
    own, column = own[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    both = np.zeros((len(lines), len(lines)), np.float32)
    for first in range(0, int(shared.sum()), 1 << 13):
        a, b = np.searchsorted(column, (first, first + (1 << 13)))
        block = np.zeros((len(lines), 1 << 13), np.float32)
        block[own[a:b], column[a:b] - first] = 1
        both += block @ block.T
    return size, both.astype(np.int64)


def may_reach(least: float, n: np.ndarray, m: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Pairs to be verified; one shingle more may be in common, should two hashes be equal."""
    return both + 1 >= least * (n + m - both - 1) - 1e-9


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """none is true for rows without an id; tag tells apart rows that repeat one."""
    return docs.select(*_keys(id_col, text_col), F.col(f"`{text_col}`").alias("text"))


def _keys(id_col: str, text_col: str) -> list:
    id_ = F.col(f"`{id_col}`")
    return [id_.isNull().alias("none"), F.coalesce(id_.cast("bigint"), F.lit(0)).alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("tag")]


def _occurrences(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = [(i, n, _id(line)) for i, text in enumerate(part.column(3).to_pylist()) for n, line in enumerate(line_list(text)) if line]
                if found:
                    row, number, line = (np.array(x) for x in zip(*found, strict=True))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(3)), pa.array(number.astype(np.int32)), pa.array(line)], ["none", "doc", "tag", "number", "line"])

    return rows.mapInArrow(run, "none boolean, doc bigint, tag bigint, number int, line bigint")


def _buckets(rows: DataFrame) -> DataFrame:
    """bucket, line of every line; a task leaves out most repetitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts, at = batch.column(0), 0
            while at < len(texts):
                held: dict[int, str] = {}
                size = 0
                while at < len(texts) and size < STEP:
                    for line in line_list(texts[at].as_py()):
                        if line and (key := _id(line)) not in seen:
                            seen.add(key)
                            held[key] = line
                            size += len(line)
                    at += 1
                if held:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    bands = band_hashes(list(held.values()))
                    yield pa.RecordBatch.from_arrays([pa.array(bands.ravel().view(np.int64)), pa.array(np.repeat(np.array(list(held)), bands.shape[1]))], ["bucket", "line"])

    return rows.select("text").mapInArrow(run, "bucket bigint, line bigint")


def _shared(buckets: DataFrame) -> DataFrame:
    """bucket, line, first for the other lines of buckets with several lines."""
    return _shared_rows(buckets).dropDuplicates(["bucket", "line"])


def _shared_rows(buckets: DataFrame) -> DataFrame:
    """bucket, line, first (the line of the bucket that its task saw first) for the other lines, repeats included.

    A task holds one line of each bucket and passes the others on, so it doesn't matter how many lines a bucket has. Which line
    is first depends on the order of arrival, so the rows are written before they are shuffled again: a bucket's rows are then
    those of one attempt of its task, whichever executors are lost later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rows = (np.empty(0, np.int64),) * 2
        for batch in chain(batches, [None]):
            if batch is not None:
                rows = tuple(np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(rows))
            if len(rows[0]) >= HELD or batch is None:
                bucket, line = (np.concatenate(x) for x in zip(known, rows, strict=True))
                order = np.argsort(bucket)
                start = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else order
                first = np.minimum.reduceat(order, start) if len(order) else order
                lead = line[np.repeat(first, np.diff(np.append(start, len(order))))]
                other = np.flatnonzero(line[order] != lead)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][other]), pa.array(line[order][other]), pa.array(lead[other])], ["bucket", "line", "first"])
                known, rows = (bucket[first], line[first]), (np.empty(0, np.int64),) * 2

    return written(buckets.repartition("bucket").mapInArrow(run, "bucket bigint, line bigint, first bigint"), "line-buckets")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """line, string: the text of each line in `wanted` (column line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                lines = list(dict.fromkeys(x for text in batch.column(0).slice(low, 500).to_pylist() for x in line_list(text) if x))
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([_id(x) for x in lines]), pa.array(lines, pa.string())], ["line", "string"])

    lines = rows.select("text").mapInArrow(run, "line bigint, string string")
    return lines.join(wanted, "line", "left_semi").groupBy("line").agg(F.min("string").alias("string"))


def _similar(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose lines are similar, by exact Jaccard: hashes choose the pairs, the shingles themselves decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                part = batch.slice(low, 100)
                x, y = (part.column(i).to_pylist() for i in (2, 3))
                may = np.flatnonzero(may_reach(least, *pair_counts(x, y))).tolist()
                found = [i for i in may if jaccard(shingles(x[i]), shingles(y[i])) >= least]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).take(pa.array(found, pa.int64()))

    one = pairs.join(texts.select(F.col("line").alias("a"), F.col("string").alias("x")), "a")
    two = one.join(texts.select(F.col("line").alias("b"), F.col("string").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _within(rows: DataFrame, least: float) -> DataFrame:
    """Links between lines of different components in each cell; rows (cell, line, component, string) sorted by cell.

    Hashes choose the pairs, the shingles themselves decide.
    """

    def links(group: list[tuple]) -> Iterator[tuple[int, int]]:
        parent: dict[int, int] = {}
        held: dict[int, frozenset[str]] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def of(i: int) -> frozenset[str]:
            if i not in held:
                held[i] = shingles(group[i][2])
            return held[i]

        group.sort(key=lambda x: x[:2])
        component = np.array([x[1] for x in group], np.int64)
        size, both = common_shingles([x[2] for x in group])
        may = may_reach(least, size[:, None], size, both) & (component[:, None] != component)
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(may))), strict=True):
            one, two = top(group[i][1]), top(group[j][1])
            if one != two and jaccard(of(i), of(j)) >= least:
                parent[two] = one
                yield group[i][0], group[j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, group = None, []
        for row in chain((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), [(None, 0, 0, "")]):
            if row[0] != cell and group:
                if found := list(links(group)):
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                group = []
            cell = row[0]
            group.append(row[1:])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _prefixes(rows: DataFrame, least: float) -> DataFrame:
    """cell, line of rows (bucket, line, string): a cell for each of a line's rarest shingles in the bucket.

    Two lines of a bucket whose similarity is `least` or more have at least that share of either line's shingles in common;
    so of n shingles the n - ceil(least n) + 1 first ones in any order can't all be missing in the other's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, line, string in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.unique(shingle_hashes([string])[1]).view(np.int64)
                same = lambda x: pa.array(np.full(len(own), x))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([same(bucket), same(line), pa.array(own), same(len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1)], ["bucket", "line", "shingle", "n"])

    found = written(rows.mapInArrow(run, "bucket bigint, line bigint, shingle bigint, n bigint"), "line-shingles")
    # written before it meets the rows: a shingle that all lines of a bucket have can then be split in the join
    often = written(found.groupBy("bucket", "shingle").agg(F.count("*").alias("often")).where("often > 1"), "shared-shingles")
    rank = F.row_number().over(Window.partitionBy("bucket", "line").orderBy("often", "shingle"))
    # shingles that no other line has count for the rank too, and come first
    each = found.join(often, ["bucket", "shingle"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    first = each.withColumn("rank", rank).where("rank <= n and often > 1")
    return first.select(F.xxhash64("bucket", "shingle").alias("cell"), "line")


def _parts(cells: DataFrame) -> DataFrame:
    """cell, n, main (its largest component), n_main and `lines` (a hash of its set of lines) of the cells with more than one component."""
    each = cells.groupBy("cell", "component").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("line")).alias("x"))
    largest = F.max(F.struct("k", "component")).alias("m")
    sizes = each.groupBy("cell").agg(F.count("*").alias("parts"), F.sum("k").alias("n"), largest, F.bit_xor("x").alias("lines")).where("parts > 1")
    return sizes.select("cell", "n", F.col("m.component").alias("main"), F.col("m.k").alias("n_main"), "lines")


def _dealt(rows: DataFrame, tile: int) -> DataFrame:
    """cell, line, component of rows that also have _parts(): a cell above `tile` lines becomes pairs of tiles.

    Lines of the largest component needn't meet each other: their tiles meet those of the other lines, and these each other.
    """
    tiles = lambda n: F.ceil(n / tile).cast("int")
    rows = rows.withColumns({"large": F.col("component") == F.col("main"), "tm": tiles(F.col("n_main")), "tr": tiles(F.col("n") - F.col("n_main"))})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("line"), F.when(F.col("large"), F.col("tm")).otherwise(F.col("tr"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda one, two: F.struct(one.alias("one"), two.alias("two"))
    own = F.col("own")
    rest = F.concat(
        F.transform(upto("tm"), lambda i: place(i, own)),
        F.transform(F.filter(upto("tr"), lambda i: i != own), lambda i: place(-1 - F.least(own, i), F.greatest(own, i))),
    )
    meet = F.when(F.col("large"), F.transform(upto("tr"), lambda i: place(own, i))).otherwise(rest)
    return rows.withColumn("x", F.explode(meet)).select(F.xxhash64("cell", "x.one", "x.two").alias("cell"), "line", "component")


def line_components(rows: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """line, component of every line that is similar to a lesser one. rows: _documents()."""
    shared = _shared_rows(_buckets(rows))
    pairs = shared.select(F.greatest("line", "first").alias("a"), F.least("line", "first").alias("b")).distinct()
    # as a written table its size is known: Spark broadcasts it where it is small, and else doesn't
    texts = written(_texts(rows, written(shared.select("line").union(shared.select("first")).distinct(), "wanted-lines")), "line-texts")
    joined = written(components(written(_similar(pairs, texts, least), "line-links")).select(F.col("id").alias("line"), "component"), "line-stars")
    # all these lines were compared with the first of their bucket; of buckets with the same other lines one is enough
    others = shared.dropDuplicates(["bucket", "line"]).join(joined, "line", "left")
    placed = written(others.select(F.col("bucket").alias("cell"), "line", F.coalesce("component", "line").alias("component")), "placed-lines")
    split = _parts(placed).groupBy("lines", "n").agg(F.min(F.struct("cell", "main", "n_main")).alias("x")).select("x.cell", "n", "x.main", "x.n_main")
    # written before it meets the rows, so that a large bucket can be split in the join
    open_ = written(placed.join(written(split, "split-buckets"), "cell"), "open-buckets")
    cells = _dealt(open_.where(F.col("n") - F.col("n_main") <= tile), tile)
    large = open_.where(F.col("n") - F.col("n_main") > tile).select(F.col("cell").alias("bucket"), "line", "component")
    if not large.isEmpty():
        narrow = _prefixes(large.join(texts, "line").select("bucket", "line", "string"), least).join(large.select("line", "component").distinct(), "line")
        narrow = written(narrow.select("cell", "line", "component"), "line-cells")
        cells = cells.unionByName(_dealt(narrow.join(written(_parts(narrow), "split-cells"), "cell"), tile))
    dealt = cells.join(texts, "line").select("cell", "line", "component", "string").repartition("cell").sortWithinPartitions("cell")
    stars = joined.select(F.col("line").alias("a"), F.col("component").alias("b"))
    return components(stars.union(_within(dealt, least))).select(F.col("id").alias("line"), "component")


def drop_fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs with the text that is left and `n_removed`, the number of lines that went. All columns are kept (an input column n_removed is replaced)."""
    rows = _documents(docs, id_col, text_col)
    joined = line_components(rows, least)
    found = written(_occurrences(rows), "lines")
    named = written(found.join(joined, "line", "left").withColumn("component", F.coalesce("component", "line")).drop("line"), "named-lines")
    place = F.struct("none", "doc", "tag", "number")
    first = written(named.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first"), "first-lines")
    later = named.join(first, "component").where(place > F.col("first"))
    keys = ["none", "doc", "tag"]
    gone = later.groupBy(*keys).agg(F.collect_set("number").alias("gone"))
    text = F.col(f"`{text_col}`")
    whole = docs.select(as_one(docs, leave=(text_col,)), *_keys(id_col, text_col), text.alias("text")).join(gone.hint("merge"), keys, "left")  # lines that go have no size bound
    # the lines are bound to a variable, so that they are split once
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    kept = F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.get(kept, F.lit(0)))
    n_removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")
    return whole.select(*(x for c, x in zip(docs.columns, columns_of(docs, **{text_col: left}), strict=True) if c != "n_removed"), n_removed)
