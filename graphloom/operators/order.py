"""Total orders over any number of rows: ranks without one task that holds all rows, and ordered trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import ancestors
from graphloom.operators.lineage import cut


def ranked(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """The rows with their place (from 1) in the order of columns that together are unique.

    Ranges of the order are dealt to tasks and written; each range is numbered by itself and goes on from the rows before it. Only a
    row for each range meets the others.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(sizes, "_range").withColumn(name, (F.col("_before") + within).cast("long")).select(*df.columns, name)


def ordered_tree(paths: DataFrame, path: str, dynamic: Column | None = None, depth: int | None = None) -> DataFrame:
    """path, depth, place, last, n: the tree of all folders of `paths` in pre-order, each with the place of its last descendant and how many rows lie in or below it.

    Under a node static segments come before dynamic ones, then by name. dynamic: whether a segment (column `segment`) stands for
    others; without it those that begin with `:` or `*`. depth: deeper folders count for the one at that depth.
    """
    marks = F.col("segment").rlike(r"^[:*\[]") if dynamic is None else dynamic
    above = ancestors(F.col(path))
    nodes = paths.select(F.explode(above if depth is None else F.slice(above, 1, depth)).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    level = F.size(F.split("path", "/"))
    nodes = nodes.withColumn("depth", level).withColumn("segment", F.element_at(F.split("path", "/"), -1))
    key = F.struct(marks.cast("int").alias("dynamic"), "segment")
    # a node's key is that of its parents and its own; siblings differ in the last step only, and a parent is a beginning of its children's
    steps = nodes.select("path", key.alias("key"))
    listed = nodes.select(F.col("path").alias("of"), F.posexplode(ancestors(F.col("path"))).alias("i", "path")).join(steps, "path")
    keys = listed.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "key"))), lambda x: x["key"]).alias("key"))  # as many as a path has segments
    placed = ranked(nodes.join(keys.withColumnRenamed("of", "path"), "path").select("path", "depth", "n", "key"), "key")
    size = nodes.select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("size"))
    return placed.join(size, "path").select("path", "depth", "place", (F.col("place") + F.col("size") - 1).alias("last"), "n")
