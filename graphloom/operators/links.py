"""Links between objects as one table of edges: link_type, src_id, dst_id, ord. Reverse links are the same rows read backwards."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each link type with the one that reads it backwards.
INVERSE = {
    "imports": "importedBy",
    "renders": "renderedBy",
    "implements": "implementedBy",
    "extends": "extendedBy",
    "overrides": "overriddenBy",
    "calls": "calledBy",
}
#: Links that `ontology.build` holds in both directions under one name.
TWO_WAY = ("registers", "usesStore", "usesHook", "usesGmApi", "injectsInto", "requestsTo", "belongsTo")
LINK_TYPES = (*INVERSE, *INVERSE.values(), "contains", "passesProps", "navigatesTo", *TWO_WAY)


def edges(df: DataFrame, link_type: str, src: Column | str, dst: Column | str, order: Column | str) -> DataFrame:
    pick = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(F.lit(link_type).alias("link_type"), pick(src).alias("src_id"), pick(dst).alias("dst_id"), pick(order).cast("long").alias("ord"))


def with_inverse(links: DataFrame) -> DataFrame:
    """The edges and, for types that have an inverse or go both ways, the edges read backwards."""
    names = INVERSE | {x: x for x in TWO_WAY}
    back = reduce(lambda c, kv: c.when(F.col("link_type") == kv[0], kv[1]), names.items(), F.when(F.lit(False), "")).otherwise(None)
    turned = links.select(back.alias("link_type"), F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "ord")
    return links.unionByName(turned.where("link_type is not null"))


def follow(links: DataFrame, link_type: str, src_id: str, objects: DataFrame | None = None) -> DataFrame:
    """What an object is linked to, in order; ids without an object are dropped, repeated ones stay."""
    if link_type not in LINK_TYPES:
        raise ValueError(f"unknown link type {link_type}; there are {', '.join(LINK_TYPES)}")
    found = links.where((F.col("link_type") == link_type) & (F.col("src_id") == src_id)).select("dst_id", "ord")
    return (found if objects is None else found.join(objects.withColumnRenamed("id", "dst_id"), "dst_id")).orderBy("ord", "dst_id")


def adjacency(links: DataFrame) -> DataFrame:
    """src_id and its targets as an array in order."""
    return links.groupBy("src_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst_id"))), lambda x: x["dst_id"]).alias("dst_ids"))


def explode_adjacency(objects: DataFrame, link_type: str, id_col: str, ids_col: str) -> DataFrame:
    rows = objects.select(F.col(id_col).alias("src_id"), F.posexplode(ids_col).alias("ord", "dst_id"))
    return edges(rows, link_type, "src_id", "dst_id", "ord")


def degrees(links: DataFrame) -> DataFrame:
    """id, n_out, n_in over distinct edges."""
    pairs = links.select("src_id", "dst_id").distinct()
    ends = pairs.select(F.col("src_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(pairs.select("dst_id", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def unique_ids(df: DataFrame, base: str, *order: str) -> DataFrame:
    """Add `id`: the base, then base@2, base@3 for later rows with the same base."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn("id", F.when(n == 1, F.col(base)).otherwise(F.concat(base, F.lit("@"), n.cast("string"))))


def all_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of one with each of the other. Both are dealt out, and a task pairs one part with one part, of which it holds the right one."""
    n = math.ceil(math.sqrt(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return left.repartition(n).hint("shuffle_replicate_nl").crossJoin(right.repartition(n))


def neighbours(links: DataFrame, id_: str, most: int = 20) -> DataFrame:
    """link_type, other of all links from an object; of each type that reads links backwards the first `most`. For a page on one object."""
    found = links.where(F.col("src_id") == id_).select("link_type", F.col("dst_id").alias("other"), "ord").distinct()
    place = F.row_number().over(Window.partitionBy("link_type").orderBy("ord", "other"))
    back = F.col("link_type").isin(*INVERSE.values())
    return found.withColumn("_n", place).where(~back | (F.col("_n") <= most)).select("link_type", "other")
