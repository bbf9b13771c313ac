"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Fingerprints that differ in at most
`most` bits are linked. Five bit blocks give ten block pairs, and two such fingerprints agree in at least one of them, so
the distinct fingerprints that share a block pair are the only candidates; each such bucket gets a table of Hamming
distances to reference fingerprints, pairs with a coordinate difference above `most` are discarded (the triangle
inequality), and the rest are verified bit by bit. A bucket keeps a spanning forest of its links, never all pairs.

Buckets above TILE fingerprints are first swept: sorted with their bits in a few seeded orders, each fingerprint meets its next
NEXT ones, which joins what is dense. What then is one component is done. Where at most TILE fingerprints are outside the
bucket's largest component, these meet all others, which are dealt into parts of TILE. Only buckets that are
sparser than that are blocked again by the bits that they don't agree on yet: cut into four blocks, two fingerprints that differ
in three bits agree in at least one of these too, and a sparse bucket's blocks are far smaller. So a dense bucket costs a
fingerprint a few copies and a sparse one four; no candidate is lost and no task holds an unbounded bucket. Alternating
star steps then join the links into components.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and are linked like any other;
fewer words than a shingle are one shingle; repeated rows share fingerprint and component; a row whose document id is null
links nothing and gets the component of the documents with its fingerprint, or null; an empty table gives no rows; very long
texts are hashed by themselves; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import as_one, columns_of, flat, written
from graphloom.llm.components import components, forest

SEED, SHINGLE, MOST, TILE = 42, 3, 3, 2048
#: How many orders a sweep takes, and how many following fingerprints each one meets.
TURNS, NEXT = 8, 32
#: First bit and width of each block.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def _references(n: int = 16) -> np.ndarray:
    """Reference fingerprints: XXH64 of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    digest, seed = xxhash.xxh64_intdigest, SEED
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.array([digest(p, seed) for p in parts], "<u8")
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[low : low + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tag (tells apart rows that repeat an id) and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begins = flat(batch.column(2))
            data, at = raw.tobytes(), begins.tolist()
            found = np.array([text_fingerprint(data[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "tag", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.hash(F.col(f"`{text_col}`")).alias("tag"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, tag int, fp bigint")


def block_masks(blocks: int = 2) -> list[int]:
    ones = [((1 << width) - 1) << low for low, width in BLOCKS]
    return [sum(x) for x in combinations(ones, blocks)]


def quarters(mask: int, blocks: int = 4) -> list[int]:
    """The bits that a mask lacks, cut into blocks; no blocks where these are too few to be cut."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return [sum(free[i * len(free) // blocks : (i + 1) * len(free) // blocks]) for i in range(blocks)] if len(free) >= 2 * blocks else []


def bucket_links(group: np.ndarray, fp: np.ndarray, most: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal `group`."""
    pivots = np.bitwise_count(fp[:, None] ^ references).astype(np.int8)
    left, right, held = [], [], 0
    near = np.arange(len(fp))
    label = np.arange(len(fp))
    for step in range(1, len(fp)):
        near = near[: np.searchsorted(near, len(fp) - step)]
        near = near[group[near] == group[near + step]]
        if not len(near):
            break
        pair = near
        for k in range(0, len(references), 4):
            pair = pair[(np.abs(pivots[pair, k : k + 4] - pivots[pair + step, k : k + 4]) <= most).all(axis=1)]
        pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + step]) <= most]
        if len(pair):
            left.append(pair)
            right.append(pair + step)
            held += len(pair)
        if held > 1 << 20:
            label = forest(len(fp), np.concatenate([*left, np.arange(len(fp))]), np.concatenate([*right, label]))
            left, right, held = [], [], 0
    if held:
        label = forest(len(fp), np.concatenate([*left, np.arange(len(fp))]), np.concatenate([*right, label]))
    own = np.flatnonzero(label != np.arange(len(fp)))
    return own, label[own]


def _orders(n: int) -> np.ndarray:
    """For n seeded orders of the 64 bits: what each value of each byte adds to a fingerprint whose bits are put in that order."""
    random = np.random.Generator(np.random.PCG64(SEED))
    out = np.zeros((n, 8, 256), np.uint64)
    for k in range(n):
        place = random.permutation(64).astype(np.uint64)
        for bit in range(64):
            byte, inside = divmod(bit, 8)
            out[k, byte, np.arange(256) >> inside & 1 == 1] |= np.uint64(1) << place[bit]
    return out


def sweep(fingerprints: DataFrame, most: int, turns: int = TURNS, following: int = NEXT) -> DataFrame:
    """a, b: some links between fingerprints (id, fp), of those near each other when sorted with their bits in a few seeded orders.

    Ranges of an order are dealt to tasks, so any number of fingerprints is many tasks; links across their borders may be missed here.
    """
    orders = _orders(turns)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            for turn in range(turns):
                place = np.bitwise_or.reduce([orders[turn, k][raw[:, k]] for k in range(8)]) if len(raw) else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), turn, np.int32)), pa.array(place.view(np.int64)), batch.column(0), batch.column(1)], ["turn", "place", "id", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h[-following:], batch.column(i).to_numpy()]) for i, h in zip((0, 2, 3), held, strict=True)]
            turn, ids, fp = held[0], held[1], held[2].view(np.uint64)
            found = []
            for step in range(1, min(following, len(fp) - 1) + 1):
                near = np.flatnonzero((turn[step:] == turn[:-step]) & (np.bitwise_count(fp[step:] ^ fp[:-step]) <= most))
                found.append((near, near + step))
            if found:
                left, right = (np.concatenate(x) for x in zip(*found, strict=True))
                label = forest(len(fp), np.concatenate([left, np.arange(len(fp))]), np.concatenate([right, np.arange(len(fp))]))
                own = np.flatnonzero(label != np.arange(len(fp)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[label[own]])], ["a", "b"])

    rows = fingerprints.select("id", "fp").mapInArrow(turned, "turn int, place bigint, id bigint, fp bigint")
    rows = rows.repartitionByRange("turn", "place").sortWithinPartitions("turn", "place")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def deal(distinct: DataFrame, most: int = MOST, tile: int = TILE) -> tuple[DataFrame, list[DataFrame]]:
    """Groups (bucket, id, fp) in which all fingerprints are to be compared, and tables of links (a, b) that are known already."""
    masks = block_masks()
    blocks = F.array(*map(F.lit, map(_signed, masks)))
    keyed = distinct.select("id", "fp", F.explode(blocks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    bucket = F.xxhash64("mask", "key").alias("bucket")
    parts, known = [], []
    while True:
        # few buckets are large, so this table is small and meets the rows without a shuffle where Spark finds it to be
        large = written(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("mask", "key"), "large-buckets")
        if large.isEmpty():
            parts.append(keyed.select(bucket, "id", "fp"))
            break
        parts.append(keyed.join(large, ["mask", "key"], "left_anti").select(bucket, "id", "fp"))
        open_ = written(keyed.join(large, ["mask", "key"]), "open-buckets")
        known.append(written(sweep(open_.select("id", "fp").distinct(), most), "swept-links"))
        joined = written(components(reduce(DataFrame.unionByName, known)), "swept-components")
        named = written(open_.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")), "named-buckets")
        each = named.groupBy("mask", "key", "component").agg(F.count("*").alias("k"))
        sizes = each.groupBy("mask", "key").agg(F.count("*").alias("parts"), F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("m")).where("parts > 1")
        sizes = written(sizes.select("mask", "key", "n", F.col("m.component").alias("main"), F.col("m.k").alias("n_main")), "split-buckets")
        rows = named.join(sizes, ["mask", "key"])
        left = F.col("n") - F.col("n_main")
        # what is outside the largest component meets all parts of that
        chunks = F.ceil(F.col("n_main") / tile).cast("int")
        own = F.pmod(F.xxhash64("id"), chunks).cast("int")
        place = F.explode(F.when(F.col("component") == F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0), chunks - 1)))
        parts.append(rows.where(left <= tile).select("mask", "key", "id", "fp", place.alias("chunk")).select(F.xxhash64("mask", "key", "chunk").alias("bucket"), "id", "fp"))
        sparse = rows.where(left > tile).select("mask", "key", "id", "fp")
        finer = {m: [m | q for q in quarters(m)] for m in masks}
        cut = [_signed(m) for m, xs in finer.items() if len(xs) > most]
        # too few bits are left to block by: such buckets hold few fingerprints, as each is there once
        parts.append(sparse.where(~F.col("mask").isin(cut)).select(bucket, "id", "fp"))
        if not cut:
            break
        steps = distinct.sparkSession.createDataFrame([(_signed(m), [_signed(x) for x in xs]) for m, xs in finer.items() if len(xs) > most], "mask bigint, finer array<bigint>")
        again = sparse.join(steps, "mask").select("id", "fp", F.explode("finer").alias("mask"))
        # a bucket may come by two masks
        keyed = written(again.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).dropDuplicates(["id", "mask"]), "blocked-again")
        masks = sorted({x for xs in finer.values() for x in xs if len(xs) > most})
    return reduce(DataFrame.unionByName, parts), known


def links(distinct: DataFrame, most: int = MOST, tile: int = TILE) -> DataFrame:
    """a, b (ids): links that join the same ids as all links between `distinct` (id, fp; each fp once) would."""
    if most > len(BLOCKS) - 2:
        raise ValueError("two of five blocks agree only up to three differing bits")
    dealt, known = deal(distinct, most, tile)
    references = _references()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            group, ids, fp = held
            end = len(group) if batch is None or not len(group) else int(np.searchsorted(group, group[-1]))
            if end:
                a, b = bucket_links(group[:end], fp[:end].view(np.uint64), most, references)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])
            held = [h[end:] for h in held]

    rows = dealt.repartition("bucket").sortWithinPartitions("bucket", "fp")
    return reduce(DataFrame.unionByName, [rows.mapInArrow(run, "a bigint, b bigint"), *known]).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, tag, fp and component_id (the smallest document id reachable) of every row."""
    found = written(fingerprints(docs, id_col, text_col), "fingerprints")
    first = written(found.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    joined = components(links(first.where("id is not null"), most))
    named = written(first.join(joined, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id")), "named-fingerprints")
    return found.join(named, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row of docs for each group of near duplicates, the one with the smallest id (then the smallest hash of its text)."""
    found = near_duplicates(docs, id_col, text_col, most)
    group = ["component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")]
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tag"))
    best = found.groupBy(*group).agg(F.min(F.coalesce(named, F.struct(F.lit(None).cast("bigint").alias("doc_id"), F.col("tag")))).alias("x"), F.min(named).alias("y"))
    kept = best.select(F.coalesce("y", "x").alias("z")).select(F.col("z.doc_id").alias("kept_id"), F.col("z.tag").alias("kept_tag"))
    whole = docs.select(as_one(docs), F.col(f"`{id_col}`").alias("own"), F.hash(F.col(f"`{text_col}`")).alias("own_tag"))
    rows = whole.join(kept, F.col("own").eqNullSafe(F.col("kept_id")) & (F.col("own_tag") == F.col("kept_tag")))
    once = F.row_number().over(Window.partitionBy("kept_id", "kept_tag").orderBy("kept_tag"))
    return rows.withColumn("once", once).where("once = 1").select(*columns_of(docs))
