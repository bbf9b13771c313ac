"""Paths over forests: what nodes hand down to all below them, in a number of rounds that grows with the logarithm of the depth."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut


def composed(nodes: DataFrame, key: list[str], parent: list[str], parts: list[str]) -> DataFrame:
    """The nodes (key, parent, parts) with each of `parts`, an array, preceded by those of all nodes above, and `steps`, how many these are.

    Pointer doubling: in each round a node takes over what the node that it points to has gathered, and points to where that one
    points, so a chain of n nodes takes about log2(n) rounds. Nodes whose parent isn't there are roots; of several rows of a key
    one should be left before. A node on a cycle, or below one, has no root and is left out.
    """
    up = [f"_up{i}" for i in range(len(key))]
    state = cut(nodes.select(*key, *(F.col(p).alias(u) for p, u in zip(parent, up, strict=True)), *parts, F.lit(0).cast("long").alias("steps")))
    # parents that aren't there don't count
    there = state.select(*(F.col(k).alias(u) for k, u in zip(key, up, strict=True)), F.lit(True).alias("_there"))
    known = state.join(there, up, "left")
    state = cut(known.select(*key, *(F.when(F.col("_there"), F.col(u)).alias(u) for u in up), *parts, F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("steps")))
    done, open_ = state.where(f"{up[0]} is null"), state.where(f"{up[0]} is not null")
    n = open_.count()
    for step in count(1):
        if not n or 2**step > 4 * (n + 1) and step > 64:
            break
        above = state.select(*(F.col(k).alias(u) for k, u in zip(key, up, strict=True)), *(F.col(u).alias(f"_next{i}") for i, u in enumerate(up)), *(F.col(p).alias(f"_above_{p}") for p in parts), F.col("steps").alias("_more"))
        moved = open_.join(above, up).select(*key, *(F.col(f"_next{i}").alias(u) for i, u in enumerate(up)), *(F.concat(f"_above_{p}", p).alias(p) for p in parts), (F.col("steps") + F.col("_more")).alias("steps"))
        state = cut(done.unionByName(moved))
        done, open_ = state.where(f"{up[0]} is null"), state.where(f"{up[0]} is not null")
        now = open_.count()
        # where no chain ends within as many steps as there are nodes, what is left goes round in a cycle
        if now == n and 2**step > n:
            break
        n = now
    return done.select(*key, *parts, "steps")
