"""Resolution joins: ranked candidates, longest prefixes, innermost intervals, route patterns, globs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators.graph import ancestors


def ranked_lookup(candidates: DataFrame, targets: DataFrame, key: str, by: str, rank: str = "rank") -> DataFrame:
    """For each `by` the target of its best candidate that exists. candidates: by, key, rank; targets: key and what is wanted."""
    found = candidates.join(targets, key)
    wanted = [c for c in targets.columns if c != key]
    best = found.groupBy(by).agg(F.min_by(F.struct(key, *wanted), F.struct(rank, key)).alias("best"))
    return best.select(by, f"best.{key}", *(f"best.{c}" for c in wanted))


def longest_prefix(paths: DataFrame, prefixes: DataFrame, path: str, prefix: str, *keep: str) -> DataFrame:
    """Each path with the longest of `prefixes` that is one of its ancestors, by an equal-key join on ancestors; null if none."""
    tried = paths.select(path, *keep, F.explode_outer(ancestors(F.col(path))).alias(prefix))
    found = tried.join(prefixes.select(prefix).distinct().withColumn("_hit", F.col(prefix)), prefix, "left")
    return found.groupBy(path, *keep).agg(F.max_by("_hit", F.when(F.col("_hit").isNotNull(), F.length("_hit"))).alias(prefix))


#: Positions of a group that are swept as one key.
RANGE = 1 << 16


def _swept(points: DataFrame, spans: DataFrame, by: str, at: str, low: str, high: str, value: Column, every: bool, width: int) -> DataFrame:
    """`by`, `_at`, `_value` of each distinct point: the value of its innermost span, or (every) a row for each span around it.

    Points and spans of a range of positions go through a task in order of position, and a stack keeps the spans that are open;
    a span is in each range that it reaches into. So no point meets a span that isn't around it, and a large group is many keys.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    reach = F.when(F.col(low) < F.col(high), F.sequence(cell(low), F.floor((F.col(high) - 1) / width).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    asked = points.select(by, at).where(F.col(by).isNotNull() & F.col(at).isNotNull()).distinct()
    # spans come before the points at the place where they begin, and the longer of them first
    rows = spans.where(F.col(by).isNotNull()).select(by, F.explode(reach).alias("_range"), F.col(low).cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col(high).cast("long").alias("_high"), value.alias("_value"))
    rows = rows.unionByName(asked.select(by, cell(at).alias("_range"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_high"), F.lit(None).cast("string").alias("_value")))
    ordered = rows.repartition(by, "_range").sortWithinPartitions(by, "_range", "_at", "_kind", F.desc("_high"), "_value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        open_: list[tuple[int, str]] = []
        for batch in batches:
            out: list[tuple[int, int, str | None]] = []
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if here != row[:2]:
                    here, open_ = row[:2], []
                if row[3] == 0:
                    open_.append((row[4], row[5]))
                    continue
                while open_ and open_[-1][0] <= row[2]:  # ended ones below the last are met when they come up
                    open_.pop()
                if every:
                    open_ = [x for x in open_ if x[0] > row[2]]
                    out += [(i, row[2], v) for _, v in open_]
                elif open_:
                    out.append((i, row[2], open_[-1][1]))
            if out:
                taken, places, values = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken)), pa.array(places, pa.int64()), pa.array(values, pa.string())], [by, "_at", "_value"])

    return ordered.mapInArrow(run, StructType([points.schema[by]]).add("_at", "long").add("_value", "string"))


def around(points: DataFrame, spans: DataFrame, by: str, at: str = "pos", low: str = "low", high: str = "high", width: int = RANGE) -> DataFrame:
    """Each point with each span [low, high) of its group that holds it (and the span's columns), by a sorted sweep."""
    others = [f for f in spans.schema.fields if f.name != by]
    found = _swept(points, spans, by, at, low, high, F.to_json(F.struct(*(f.name for f in others))), True, width)
    held = found.select(F.col(by).alias("_by"), F.col("_at").alias("_pos"), F.from_json("_value", StructType(others)).alias("_span"))
    return points.join(held, (F.col(by) == F.col("_by")) & (F.col(at).cast("long") == F.col("_pos"))).select(*points.columns, *(F.col(f"_span.{f.name}") for f in others if f.name not in points.columns))


def innermost(points: DataFrame, spans: DataFrame, by: str, at: str = "pos", low: str = "low", high: str = "high", name: str = "span", width: int = RANGE) -> DataFrame:
    """Each point with the span [low, high) of its group that begins last among those around it (null if none; of those that begin
    together the shortest), by a sorted sweep. Spans may nest and overlap in any way."""
    found = _swept(points, spans, by, at, low, high, F.to_json(F.struct(F.col(name).alias("v"))), False, width)
    kind = StructType().add("v", spans.schema[name].dataType)
    best = found.select(F.col(by).alias("_by"), F.col("_at").alias("_pos"), F.from_json("_value", kind)["v"].alias("_found"))
    kept = [points[c] for c in points.columns if c != name]
    return points.join(best, (F.col(by) == F.col("_by")) & (F.col(at).cast("long") == F.col("_pos")), "left").select(*kept, F.col("_found").alias(name))


def as_of(points: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str, values: list[str]) -> DataFrame:
    """Each point with `values` of the last mark of its group at or before it (nulls if none), by one sorted pass over both.

    marks: by, mark (a place), values; of several at a place the one with the largest values counts. Points keep their columns.
    """
    held = F.struct(*values)
    rows = points.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"), F.lit(None).cast(marks.select(held.alias("x")).schema["x"].dataType).alias("_held"))
    rows = rows.unionByName(marks.select(*by, F.col(mark).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema["_point"].dataType).alias("_point"), held.alias("_held")))
    so_far = Window.partitionBy(*by).orderBy("_at", "_kind", "_held").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.withColumn("_last", F.last("_held", ignorenulls=True).over(so_far)).where("_kind = 1")
    return last.select("_point.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def outside_counts(positions: DataFrame, spans: DataFrame, by: str, at: str = "pos", low: str = "low", high: str = "high") -> DataFrame:
    """The spans with n_inside and n_outside: positions of their group in [low, high), and all others of the group.

    Positions and the two ends of spans are sorted together once; a span holds what was counted up to its end less what was counted
    up to its beginning. No position meets a span.
    """
    numbered = spans.withColumn("_span", F.struct(*spans.columns))
    ends = lambda c: numbered.select(by, F.col(c).cast("long").alias("_at"), F.lit(0).alias("_kind"), F.lit(c == high).alias("_end"), "_span")
    plain = positions.select(by, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(False).alias("_end"), F.lit(None).cast(numbered.schema["_span"].dataType).alias("_span"))
    # an end stands before the positions at its place: they are at or behind it
    group = Window.partitionBy(by)
    so_far = F.sum("_kind").over(group.orderBy("_at", "_kind").rangeBetween(Window.unboundedPreceding, 0))
    counted = plain.unionByName(ends(low)).unionByName(ends(high)).withColumns({"_before": so_far, "_all": F.sum("_kind").over(group)}).where("_kind = 0")
    # spans that are equal in all columns are counted together and share the result
    sides = counted.groupBy("_span").agg(F.min(F.when(~F.col("_end"), F.col("_before"))).alias("_a"), F.min(F.when(F.col("_end"), F.col("_before"))).alias("_b"), F.first("_all").alias("_n"), F.count("*").alias("_k"))
    n = F.greatest(F.col("_b") - F.col("_a"), F.lit(0))
    found = sides.select("_span", n.alias("n_inside"), (F.col("_n") - n).alias("n_outside"), F.explode(F.sequence(F.lit(1), (F.col("_k") / 2).cast("int"))).alias("_copy"))
    return found.select("_span.*", "n_inside", "n_outside")


ROUTE = r"^[:*]"


def normal_route(path: Column) -> Column:
    """Without query and trailing slashes; `/` if nothing is left."""
    bare = F.regexp_replace(F.split_part(path, F.lit("?"), F.lit(1)), "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def match_routes(calls: DataFrame, routes: DataFrame, path: str = "path", pattern: str = "pattern") -> DataFrame:
    """Each call with the first route (by ord) that fits: `:x` and `*x` stand for one segment, a last `*x` for the rest.

    A pattern's key is its literal prefix, all segments before the first that stands for others, and a distinct path asks for all
    its prefixes. So paths meet only the patterns that agree with them as far as these are spelled out.
    """
    segments = lambda c: F.filter(F.split(normal_route(F.col(c)), "/"), lambda x: x != "")
    asked = calls.select(path).distinct().withColumn("_have", segments(path)).withColumn("_n", F.size("_have"))
    offered = routes.select(pattern, F.col("ord").alias("_ord")).withColumn("_want", segments(pattern)).withColumn("_open", F.coalesce(F.startswith(F.try_element_at("_want", F.lit(-1)), F.lit("*")), F.lit(False)))
    prefix = lambda c, n: F.array_join(F.slice(c, F.lit(1), n), "/")
    free = F.array_position(F.transform("_want", lambda w: w.rlike(ROUTE)), F.lit(True))
    literal = F.when(free == 0, F.size("_want")).otherwise(free.cast("int") - 1)
    offered = offered.withColumn("_key", prefix(F.col("_want"), literal))
    asked = asked.withColumn("_key", F.explode(F.transform(F.sequence(F.lit(0), F.col("_n")), lambda i: prefix(F.col("_have"), i))))
    fits = F.forall(F.zip_with("_want", F.slice("_have", F.lit(1), F.size("_want")), lambda w, h: w.rlike(ROUTE) | (w == h)), lambda x: x)
    long_enough = F.when(F.col("_open"), F.col("_n") >= F.size("_want")).otherwise(F.col("_n") == F.size("_want"))
    found = asked.join(offered, "_key").where(long_enough & fits)
    best = found.groupBy(path).agg(F.min_by(pattern, "_ord").alias(pattern))
    return calls.join(best, path, "left").select(*calls.columns, pattern)


def glob_regex(glob: str) -> str:
    """`**/` any folders, `**` anything, `*` anything within a segment."""
    marks = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}
    return "^" + "".join(marks.get(x, re.escape(x)) for x in re.split(r"(\*\*/|\*\*|\*)", glob)) + "$"


def regex_of_glob(glob: Column) -> Column:
    """glob_regex() of a column."""
    plain = F.regexp_replace(glob, r"([.+?^${}()|\[\]\\])", r"\\$1")
    stars = F.replace(F.replace(F.replace(plain, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02")), F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit("^"), F.replace(F.replace(stars, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*")), F.lit("$"))


def glob_match(df: DataFrame, path: str, include: list[str], exclude: list[str] = ()) -> DataFrame:
    hit = lambda globs: F.col(path).rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)
    return df.where(hit(include) & ~hit(exclude))


def carry_forward(df: DataFrame, value: Column, by: list[str], order: str, name: str) -> DataFrame:
    """The last value that isn't null so far: sections of line-based formats."""
    up_to = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(up_to))


def layout_chain(paths: DataFrame, layouts: DataFrame, path: str = "path", folder: str = "folder", name: str = "layout") -> DataFrame:
    """Each path with the layouts of all folders above it, the outermost first. layouts: a folder (`` for the root) and a name."""
    above = F.transform(F.array_insert(ancestors(F.regexp_replace(path, "/?[^/]*$", "")), 1, F.lit("")), lambda x: x)
    tried = paths.select(path).distinct().select(path, F.posexplode(above).alias("_depth", folder))
    chain = F.transform(F.array_sort(F.collect_list(F.struct("_depth", name))), lambda x: x[name])
    found = tried.join(layouts, folder).groupBy(path).agg(chain.alias("chain"))
    return paths.join(found, path, "left").withColumn("chain", F.coalesce("chain", F.array().cast("array<string>")))


def backfill(df: DataFrame, value: str, key: str, constants: DataFrame, order: str = "ord") -> DataFrame:
    """Where `value` is null, the constant that `key` names; of several declarations the first counts. constants: key, value, order."""
    first = constants.groupBy(key).agg(F.min_by(value, order).alias("_constant"))
    return df.join(first, key, "left").withColumn(value, F.coalesce(value, "_constant")).drop("_constant")
