"""Aggregations of object graphs: priorities, dominant values, shares, flows, top lists, matrices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_of(value: Column, ranks: Mapping[str, int], other: int = -1) -> Column:
    out = F.lit(other)
    for k, n in ranks.items():
        out = F.when(value == k, F.lit(n)).otherwise(out)
    return out


def priority_merge(df: DataFrame, by: list[str], value: str, ranks: Mapping[str, int], order: str) -> DataFrame:
    """Per group the value of highest rank; the earlier row wins ties."""
    best = F.max_by(F.col(value), F.struct(rank_of(F.col(value), ranks), -F.col(order)))
    return df.groupBy(*by).agg(best.alias(value), F.count("*").alias("n"))


def dominant(df: DataFrame, by: str, value: str, least: float = 0.6, mixed: str = "mixed") -> DataFrame:
    """Per group the most frequent value (the least of equals), or `mixed` if it has less than `least` and isn't alone."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"))
    tops = counts.groupBy(by).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max("n").alias("top_n"), F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("top"))
    return tops.select(by, F.when((F.col("kinds") > 1) & (F.col("top_n") < least * F.col("total")), mixed).otherwise(F.col("top")).alias("dominant"), "top_n", "total")


def share(n: Column, total: Column) -> Column:
    """Per cent with one digit, halves up."""
    return F.floor(n * 1000.0 / total + 0.5) / 10


def shares(df: DataFrame, by: str) -> DataFrame:
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.withColumn("share", share(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))))


def flow(links: DataFrame, groups: DataFrame, skip_same: bool = False) -> DataFrame:
    """from_group, to_group, n over edges (src_id, dst_id). groups: id, grp."""
    one, two = groups.select(F.col("id").alias("src_id"), F.col("grp").alias("from_group")), groups.select(F.col("id").alias("dst_id"), F.col("grp").alias("to_group"))
    counted = links.join(one, "src_id").join(two, "dst_id")
    return (counted.where("from_group <> to_group") if skip_same else counted).groupBy("from_group", "to_group").agg(F.count("*").alias("n"))


def matrix(flows: DataFrame, names: list[str]) -> DataFrame:
    """Flows as a table with a column for each of `names`, 0 where there is none."""
    return flows.groupBy("from_group").pivot("to_group", names).agg(F.sum("n")).na.fill(0)


def heat(n: Column, most: Column) -> Column:
    return F.when(n == 0, "cold").when(n > 0.4 * most, "hot").otherwise("warm")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def round_robin(df: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """`most` rows dealt over groups in turn, larger groups first. The rows that can be dealt are cut to `most` a group before they meet."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_size"))
    ranked = df.withColumn("_turn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_turn") <= most)
    dealt = ranked.join(sizes, by).withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_turn", F.desc("_size"), by)))
    return dealt.where(F.col("_n") <= most).withColumn("place", F.col("_n").cast("long")).drop("_turn", "_size", "_n")


def first_names(value: str, order: str, most: int, separator: str = "、") -> Column:
    """The first distinct values of a group, joined."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return F.array_join(F.slice(F.array_distinct(ordered), 1, most), separator)


def top_lists(df: DataFrame, by: list[str], order: list[Column], value: str, most: int, name: str = "top") -> DataFrame:
    """by, n (rows of the group), and the first `most` values in order as an array: only these are ever gathered."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    firsts = df.withColumn("_place", place).where(F.col("_place") <= most)
    lists = firsts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", value))), lambda x: x[value]).alias(name))
    return df.groupBy(*by).agg(F.count("*").alias("n")).join(lists, by)
