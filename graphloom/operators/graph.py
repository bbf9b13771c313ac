"""Graph algorithms as loops of joins: closure, strongly connected components, levels, ancestors.

Loops stop when nothing new is found, each round is checkpointed, and only counts come to the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from graphloom.operators.lineage import cut

#: So many links are followed to the end inside one task instead of in a round of jobs for each step.
FEW = 1 << 17


def levels(links: DataFrame, sources: DataFrame, longest: bool = False, most: int = 1000) -> DataFrame:
    """id, level: the fewest (or, on a graph without cycles, most) steps from a source. links: src_id, dst_id; sources: id.

    Only the last round's frontier is joined again. Fewest steps end by themselves however far a node is; where `longest`
    goes on for more than `most` steps, as on a cycle, that is an error.
    """
    pairs = cut(links.select("src_id", "dst_id").distinct())
    if not longest and pairs.count() <= FEW:
        return _levels_in_a_task(pairs, sources)
    found = cut(sources.select("id").distinct().withColumn("level", F.lit(0).cast("long")))
    frontier = found
    for step in count(1):
        reached = frontier.join(pairs, F.col("id") == F.col("src_id")).select(F.col("dst_id").alias("id")).distinct()
        new = reached if longest else reached.join(found, "id", "left_anti")
        frontier = cut(new.withColumn("level", F.lit(step).cast("long")))
        if frontier.isEmpty():
            break
        if longest and step > most:
            raise ValueError(f"longest levels: a path of more than {most} steps, so a cycle or `most` too low")
        found = cut(found.unionByName(frontier).groupBy("id").agg((F.max if longest else F.min)("level").alias("level")))
    return found


def _levels_in_a_task(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """levels() by fewest steps for FEW links at most: one task meets them all, and passes sources that lead nowhere on as they come."""
    kind = pairs.schema["src_id"].dataType
    starts = sources.select(F.col("id").cast(kind).alias("src_id")).distinct()
    leading = starts.join(pairs.select("src_id").distinct(), "src_id", "left_semi")
    rows = pairs.unionByName(leading.withColumn("dst_id", F.lit(None).cast(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, level = defaultdict(list), {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b is None:
                    level[a] = 0
                else:
                    to[a].append(b)
        frontier = list(level)
        for step in count(1):
            frontier = [b for b in dict.fromkeys(b for a in frontier for b in to[a]) if b not in level]
            if not frontier:
                break
            level.update(dict.fromkeys(frontier, step))
        yield pa.RecordBatch.from_arrays([pa.array(list(level), to_arrow_type(kind)), pa.array(list(level.values()), pa.int64())], ["id", "level"])

    reached = rows.coalesce(1).mapInArrow(run, StructType([StructField("id", kind)]).add("level", "long"))
    alone = starts.select(F.col("src_id").alias("id")).join(leading.select(F.col("src_id").alias("id")), "id", "left_anti").withColumn("level", F.lit(0).cast("long"))
    # a source that leads nowhere may be reached by others; it is its own source all the same
    return cut(reached.unionByName(alone).groupBy("id").agg(F.min("level").alias("level")))


def closure(links: DataFrame) -> DataFrame:
    """All (src_id, dst_id) with a path of one step or more. For graphs whose closure is wanted as a table."""
    pairs = links.select("src_id", "dst_id").distinct()
    found = cut(pairs)
    fresh = found
    while not fresh.isEmpty():
        step = fresh.alias("f").join(pairs.alias("p"), F.col("f.dst_id") == F.col("p.src_id")).select("f.src_id", "p.dst_id").distinct()
        fresh = cut(step.join(found, ["src_id", "dst_id"], "left_anti"))
        found = cut(found.unionByName(fresh))
    return found


def strong_components(links: DataFrame) -> DataFrame:
    """id, component (the least id) of every node on a cycle of two nodes or more; loops to itself don't count.

    Forward and backward colouring: nodes take the least colour that reaches them; those that also reach their colour's root
    backwards within the colour are its component and leave the graph; what can't be on a cycle is trimmed first.
    """
    left = cut(links.where("src_id <> dst_id").select("src_id", "dst_id").distinct())
    done = None
    while True:  # each round takes a component or more away
        if left.count() <= FEW:
            rest = cut(_strong_in_a_task(left))
            done = rest if done is None else cut(done.unionByName(rest))
            break
        while True:  # trim nodes without a way in or out
            kept = left.join(left.select(F.col("dst_id").alias("src_id")).distinct(), "src_id", "left_semi")
            kept = cut(kept.join(left.select(F.col("src_id").alias("dst_id")).distinct(), "dst_id", "left_semi"))
            n, left = left.count(), kept
            if kept.count() == n:
                break
        if left.isEmpty():
            break
        nodes = left.select(F.col("src_id").alias("id")).union(left.select("dst_id")).distinct()
        colour = cut(nodes.withColumn("colour", F.col("id")))
        while True:
            handed = left.join(colour, F.col("src_id") == F.col("id")).select(F.col("dst_id").alias("id"), "colour")
            now = cut(colour.unionByName(handed).groupBy("id").agg(F.min("colour").alias("colour")))
            changed = not now.join(colour, ["id", "colour"], "left_anti").isEmpty()
            colour = now
            if not changed:
                break
        a, b = colour.select(F.col("id").alias("src_id"), F.col("colour").alias("ca")), colour.select(F.col("id").alias("dst_id"), F.col("colour").alias("cb"))
        inside = left.join(a, "src_id").join(b, "dst_id").where("ca = cb").select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
        back = levels(inside, colour.where("id = colour").select("id"))
        component = cut(back.join(colour, "id").select("id", F.col("colour").alias("component")))
        done = component if done is None else cut(done.unionByName(component))
        gone = component.select("id")
        left = left.join(gone, F.col("src_id") == F.col("id"), "left_anti").join(gone, F.col("dst_id") == F.col("id"), "left_anti")
        left = cut(left)
    if done is None:
        done = links.select(F.col("src_id").alias("id"), F.col("src_id").alias("component")).limit(0)
    size = done.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return done.join(size, "component", "left_semi").select("id", "component")


def _strong_in_a_task(links: DataFrame) -> DataFrame:
    """strong_components() of FEW links at most, by depth-first search without recursion."""
    kind = links.schema["src_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to: dict = defaultdict(list)
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to[a].append(b)
        seen, low, open_, out = {}, {}, {}, []
        for start in list(to):
            work = [] if start in seen else [(start, iter(to[start]))]
            if work:
                seen[start] = low[start] = len(seen)
                open_[start] = None
            while work:
                node, rest = work[-1]
                for other in rest:
                    if other not in seen:
                        seen[other] = low[other] = len(seen)
                        open_[other] = None
                        work.append((other, iter(to.get(other, ()))))
                        break
                    if other in open_:
                        low[node] = min(low[node], seen[other])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[node])
                    if low[node] == seen[node]:  # all that was opened since then is one component
                        members = []
                        while not members or members[-1] != node:
                            members.append(open_.popitem()[0])
                        out += [(x, min(members)) for x in members] if len(members) > 1 else []
        ids, components = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(components, to_arrow_type(kind))], ["id", "component"])

    return links.coalesce(1).mapInArrow(run, StructType([StructField("id", kind), StructField("component", kind)]))


def follow(starts: DataFrame, links: DataFrame, ends: DataFrame) -> DataFrame:
    """id, end, steps: the first of `ends` on the way from each start, which may be one itself (null where the way stops or goes round).

    starts, ends: id; links: src_id, dst_id, of each src_id the least dst_id counts. In each round a node points to where the one that
    it points to points, so a way of n steps takes about log2(n) rounds, and one that goes round is told by its length.
    """
    one = links.groupBy("src_id").agg(F.min("dst_id").alias("dst_id"))
    stop = ends.select(F.col("id").alias("src_id")).distinct().withColumn("stop", F.lit(True))
    nodes = one.select("src_id").union(one.select("dst_id")).union(stop.select("src_id")).union(starts.select("id")).distinct()
    # an end points to itself in no steps
    at = nodes.join(one, "src_id", "left").join(stop, "src_id", "left")
    at = cut(at.select("src_id", F.when(F.col("stop"), F.col("src_id")).otherwise(F.col("dst_id")).alias("dst_id"), F.when(F.col("stop"), 0).otherwise(1).cast("long").alias("steps"), F.coalesce("stop", F.lit(False)).alias("done")))
    n = at.count()
    reach = 1
    while reach < n and not at.where("not done and dst_id is not null").isEmpty():
        onward = at.select(F.col("src_id").alias("dst_id"), F.col("dst_id").alias("next"), F.col("steps").alias("more"), F.col("done").alias("next_done"))
        moved = at.where("not done").join(onward, "dst_id", "left").select("src_id", F.col("next").alias("dst_id"), (F.col("steps") + F.col("more")).alias("steps"), F.coalesce("next_done", F.lit(False)).alias("done"))
        at = cut(at.where("done").unionByName(moved))
        reach *= 2
    found = at.where("done").select(F.col("src_id").alias("id"), F.col("dst_id").alias("end"), "steps")
    return starts.select("id").join(found, "id", "left")


def ancestors(path: Column, separator: str = "/") -> Column:
    """All prefixes of a path, whole segments each, the path itself last."""
    parts = F.filter(F.split(path, separator), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator)))
