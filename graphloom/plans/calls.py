"""Who calls whom: call sites and the bodies that they stand in, their targets by ranked candidates.

A call site becomes the names that it may mean, each with a rank; the best one that exists is its target. Receivers are known
by the text alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import resolve as R
from graphloom.operators.graph import ancestors
from graphloom.sources import facts as X

WORDS = ("if", "for", "while", "switch", "return", "func", "catch", "make", "len", "append", "super", "assert", "await")


def bodies(facts: DataFrame) -> DataFrame:
    """path, owner, name, line, low, high (places) of Go and Dart functions and methods."""
    go = X.found(facts, "function-go", owner=1, name=2)
    dart = X.found(facts, "callable-dart", name=1).where(~F.col("name").isin(*WORDS))
    classes = X.found(facts, "type-dart", kind=1, name=2).where("kind <> 'enum'").select("path", F.col("name").alias("owner"), F.col("pos").alias("low"), F.col("end").alias("high"))
    dart = R.innermost(dart.withColumn("owner", F.lit(None).cast("string")), classes, "path", name="owner")
    return go.unionByName(dart).select("path", "owner", "name", "line", F.col("pos").alias("low"), F.col("end").alias("high"))


def sites(facts: DataFrame, found: DataFrame) -> DataFrame:
    """path, ext, line, receiver, name of each call, with the function that it stands in (fn_owner, fn_name). found: bodies()."""
    calls = X.found(facts, "call", receiver=1, name=2).where(~F.col("name").isin(*WORDS)).select("path", "ext", "pos", "line", "receiver", "name")
    spans = found.select("path", F.struct("owner", "name", "line").alias("fn"), "low", "high")
    # a declaration isn't a call of itself
    inside = R.innermost(calls, spans, "path", name="fn").where("fn is not null and (fn.line < line or fn.name <> name)")
    return inside.select("path", "ext", "line", "receiver", "name", F.col("fn.owner").alias("fn_owner"), F.col("fn.name").alias("fn_name")).distinct()


def resolve(calls: DataFrame, methods: DataFrame, imports: DataFrame, components: DataFrame) -> DataFrame:
    """src_id, dst_id of calls between methods, and from Dart methods to components.

    calls: sites(); methods: id, path, owner, name; imports: path, target (files), package_folder (Go), name (the last word of the spec).
    Go: a function of an imported package, or a method of that name somewhere below it where the receiver is a chain; a function of
    the same file or folder; a method of the caller's own type. Dart: the own class, a class of an imported file, the only
    class of that name, a function of the same file, the only one of that name.
    """
    own = methods.select("path", F.col("owner").alias("fn_owner"), F.col("name").alias("fn_name"), F.col("id").alias("src_id"))
    return targets(_with_source(calls, own), methods, imports, components)


def handlers(routes: DataFrame, methods: DataFrame, imports: DataFrame, components: DataFrame) -> DataFrame:
    """id, handler_id: the method that serves a route of a Go router. routes: id, path, handler (as it is written)."""
    word = F.substring_index("handler", ".", -1)
    receiver = F.when(F.contains("handler", F.lit(".")), F.regexp_replace("handler", r"\.[^.]*$", ""))
    rows = routes.where("handler is not null").select(F.col("id").alias("src_id"), "path", F.lit("go").alias("ext"), F.lit(0).alias("line"), receiver.alias("receiver"), word.alias("name"), F.lit(None).cast("string").alias("fn_owner"), T.dir_name(F.col("path")).alias("folder"))
    return targets(rows, methods, imports, components).groupBy("src_id").agg(F.min("dst_id").alias("handler_id")).withColumnRenamed("src_id", "id")


def targets(rows: DataFrame, methods: DataFrame, imports: DataFrame, components: DataFrame) -> DataFrame:
    """src_id, dst_id of what `rows` (src_id, path, ext, line, receiver, name, fn_owner, folder) name, by the ranks of resolve()."""
    placed = methods.withColumn("folder", T.dir_name(F.col("path")))
    first = F.substring_index("receiver", ".", 1)
    by = ["src_id", "line", "name", "receiver"]
    go, dart = rows.where("ext = 'go'"), rows.where("ext = 'dart'")
    free, bound = placed.where("owner is null"), placed.where("owner is not null")
    near = imports.where("package_folder is not null").select("path", F.col("name").alias("first"), "package_folder").distinct()
    through = go.where("receiver is not null").withColumn("first", first).join(near, ["path", "first"])
    one = lambda df, rank: df.select(*by, F.col("id").alias("dst_id"), F.lit(rank).alias("rank"))
    below = bound.select("id", "name", F.explode(ancestors(F.col("folder"))).alias("package_folder"))
    tried = [
        one(through.join(free.select("id", "name", F.col("folder").alias("package_folder")), ["package_folder", "name"]), 0),
        one(through.where(F.contains("receiver", F.lit("."))).join(below, ["package_folder", "name"]), 1),
        one(go.where("receiver is null").join(free.select("id", "name", "path"), ["path", "name"]), 0),
        one(go.where("receiver is null").join(free.select("id", "name", "folder"), ["folder", "name"]), 1),
        one(go.where("receiver is not null and fn_owner is not null").join(bound.select("id", "name", "folder", F.col("owner").alias("fn_owner")), ["folder", "fn_owner", "name"]), 2),
    ]
    inner = dart.where("receiver is null or receiver = 'this'")
    static = dart.where(F.col("receiver").rlike("^[A-Z]")).withColumn("owner", F.col("receiver"))
    alone = lambda df, *k: df.withColumn("_n", F.count("*").over(Window.partitionBy(*k))).where("_n = 1").drop("_n")
    files = imports.where("target is not null").select("path", F.col("target").alias("there")).distinct()
    tried += [
        one(inner.where("fn_owner is not null").join(bound.select("id", "name", "path", F.col("owner").alias("fn_owner")), ["path", "fn_owner", "name"]), 0),
        one(static.join(bound.select("id", "name", "path", "owner"), ["path", "owner", "name"]), 0),
        one(static.join(files, "path").join(bound.select("id", "name", F.col("path").alias("there"), "owner"), ["there", "owner", "name"]), 1),
        one(static.join(alone(bound.where(F.endswith("path", F.lit(".dart"))), "owner", "name").select("id", "owner", "name"), ["owner", "name"]), 2),
        one(inner.join(free.select("id", "name", "path"), ["path", "name"]), 3),
        one(inner.join(alone(free.where(F.endswith("path", F.lit(".dart"))), "name").select("id", "name"), "name"), 4),
        one(inner.where(F.col("name").rlike("^[A-Z]")).join(components.select("id", "name"), "name"), 5),
    ]
    best = reduce(DataFrame.unionByName, tried).groupBy(*by).agg(F.min_by("dst_id", F.struct("rank", "dst_id")).alias("dst_id"))
    return best.where("src_id <> dst_id").select("src_id", "dst_id").distinct()


def _with_source(calls: DataFrame, own: DataFrame) -> DataFrame:
    """Calls with the id of the method that they stand in."""
    rows = calls.withColumn("folder", T.dir_name(F.col("path")))
    named = lambda df: df.withColumn("fn_key", F.coalesce("fn_owner", F.lit("")))
    ids = named(own).groupBy("path", "fn_name", "fn_key").agg(F.min("src_id").alias("src_id"))
    return named(rows).join(ids, ["path", "fn_name", "fn_key"]).drop("fn_key")


def dead_go(units: DataFrame, names: DataFrame) -> DataFrame:
    """id, reason: Go units that their package (folder) names once at most and, if exported, the whole tree too.

    units: id, name, path, exported; names: path, name, n.
    """
    go = names.where(F.endswith("path", F.lit(".go"))).withColumn("folder", T.dir_name(F.col("path")))
    near, total = go.groupBy("folder", "name").agg(F.sum("n").alias("near")), go.groupBy("name").agg(F.sum("n").alias("total"))
    rows = units.where(F.endswith("path", F.lit(".go")) & ~F.col("name").isin("main", "init")).withColumn("folder", T.dir_name(F.col("path"))).join(near, ["folder", "name"], "left").join(total, "name", "left").na.fill(0, ["near", "total"])
    unseen = (F.col("near") <= 1) & (~F.col("exported") | (F.col("total") <= 1))
    return rows.where(unseen).select("id", F.when(F.col("exported"), "no package names it").otherwise("its package names it once").alias("reason"))
