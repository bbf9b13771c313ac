"""Connected components by union-find within tasks and alternating large-star and small-star steps between them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written


def _signature(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("high", "low")).alias("x")).first()
    return row.n, row.x or 0


#: Links that a task contracts at a time.
TOGETHER = 1 << 20


def _contract(links: DataFrame, n: int) -> DataFrame:
    """Each task joins the links of its partitions by union-find and keeps a star for each component it sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                high, low = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((high, low)))
            if len(high) and (batch is None or len(high) > 2 * TOGETHER):
                ids, place = np.unique(np.concatenate([high, low]), return_inverse=True)
                root = forest(len(ids), place[: len(high)], place[len(high) :])
                other = np.flatnonzero(root != np.arange(len(ids)))
                high, low = ids[other], ids[root[other]]
        yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low)], ["high", "low"])

    return links.coalesce(-(-n // TOGETHER) or 1).mapInArrow(run, "high bigint, low bigint")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`id`, `component` (the smallest id reachable) for every id that a link names, but the smallest of each component.

    Every round first contracts the links within tasks, about TOGETHER of them in each, then takes a large-star and a
    small-star step over all. Rounds grow with the logarithm of a component's size; where one task had all links, its stars
    are the result. Each round is written to the shared folder, so a lost executor costs one round. Links that are null
    or lead from an id to itself are ignored.
    """
    links = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("whole"))
    links = written(links.where("whole and high <> low").select("high", "low").distinct(), "links")
    seen = _signature(links)
    while True:
        n = seen[0]
        links = written(_contract(links, n), "contracted-links")
        if n <= TOGETHER:
            break
        both = links.select(F.col("high").alias("u"), F.col("low").alias("v")).union(links.select("low", "high"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        lowest = large.groupBy("high").agg(F.min("low").alias("m"))
        moved = large.join(lowest, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        links = written(moved.union(lowest).distinct(), "links")
        now = _signature(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("high").alias("id"), F.col("low").alias("component"))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links a-b: the smallest node of each one's component. For a block of links inside a task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            return label
