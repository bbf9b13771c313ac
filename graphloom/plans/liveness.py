"""What nothing refers to: orphans, unused and undeclared things, risks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.registry import Catalogue, read

C = Catalogue()


@C.add("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-06-01') AND p_type <> 'PROMO'")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Nothing imports them since a date, and no exemption holds."""
    used = read(spark, d, "lineitem").where("l_returnflag = 'R' and l_shipdate >= timestamp_ntz'1998-06-01'").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, d, "part").where("p_type <> 'PROMO'").join(used, "p_partkey", "left_anti").select("p_partkey")


@C.add("""SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) AND p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) <= 60)""")
def unused_exports(spark: SparkSession, d: str) -> DataFrame:
    """The file is imported, the name isn't, and the name hardly occurs elsewhere."""
    items = read(spark, d, "lineitem")
    key = lambda df: df.select(F.col("l_partkey").alias("p_partkey"))
    rare = read(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).where("n <= 60").select("p_name")
    parts = read(spark, d, "part").join(key(items), "p_partkey", "left_semi").join(key(items.where("l_discount > 0.08")), "p_partkey", "left_anti")
    return parts.join(rare, "p_name", "left_semi").select("p_partkey", "p_name")


@C.add("""SELECT coalesce(u.pkg, x.pkg) AS pkg, coalesce(u.n, 0) AS import_count, CASE WHEN x.pkg IS NULL THEN 'undeclared' ELSE 'declared' END AS source, u.pkg IS NOT NULL AS used FROM
(SELECT p_brand AS pkg, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 30 AND p_size < 25 GROUP BY 1) u FULL JOIN (SELECT DISTINCT p_brand AS pkg FROM part WHERE p_brand LIKE '%1%' UNION ALL SELECT 'Brand#none') x ON u.pkg = x.pkg""")
def undeclared(spark: SparkSession, d: str) -> DataFrame:
    """Used and declared packages meet in a full join."""
    parts = read(spark, d, "part")
    items = read(spark, d, "lineitem").where("l_quantity > 30").select("l_partkey")
    used = items.join(parts.where("p_size < 25"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("pkg")).agg(F.count("*").alias("import_count"))
    declared = parts.where(F.contains("p_brand", F.lit("1"))).select(F.col("p_brand").alias("pkg")).distinct().unionAll(spark.createDataFrame([("Brand#none",)], "pkg string")).withColumn("d", F.lit(True))
    both = used.join(declared, "pkg", "full_outer")
    source = F.when(F.col("d").isNull(), "undeclared").otherwise("declared")
    return both.select("pkg", F.coalesce("import_count", F.lit(0)).alias("import_count"), source.alias("source"), F.col("import_count").isNotNull().alias("used"))


@C.add("""SELECT p_partkey, p_size FROM part LEFT JOIN (SELECT l_partkey, count(*) FILTER (l_linenumber = 1) AS own, count(*) AS total FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON p_partkey = l_partkey WHERE coalesce(own, 0) <= 1 AND coalesce(total, 0) <= 1""")
def ref_count_dead(spark: SparkSession, d: str) -> DataFrame:
    """Dead if its package and all others name it once at most."""
    refs = read(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_if(F.col("l_linenumber") == 1).alias("own"), F.count("*").alias("total"))
    found = read(spark, d, "part").join(refs, "p_partkey", "left").na.fill(0, ["own", "total"])
    return found.where("own <= 1 and total <= 1").select("p_partkey", "p_size")


ALLOWED = ("Brand#1", "Brand#2", "Brand#3")


@C.add(f"SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_type = 'STANDARD' THEN true ELSE p_brand IN {ALLOWED} END AS allowed FROM part")
def declared_tristate(spark: SparkSession, d: str) -> DataFrame:
    """Allowed, not allowed, or unknown: a wildcard allows all, what is dynamic can't be told."""
    declared = spark.createDataFrame([(b,) for b in ALLOWED], "p_brand string").withColumn("hit", F.lit(True))
    allowed = F.when(F.col("p_type") == "PROMO", F.lit(None)).when(F.col("p_type") == "STANDARD", True).otherwise(F.coalesce("hit", F.lit(False)))
    return read(spark, d, "part").join(declared, "p_brand", "left").select("p_partkey", allowed.alias("allowed"))


LEVELS = ("none", "low", "medium", "high")


@C.add(f"""SELECT o_orderkey, {list(LEVELS)}[max(level) + 1] AS risk, count(kind) AS n_risks FROM (SELECT o_orderkey, 3 AS level, 'large' AS kind FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT o_orderkey, 2, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 1, 'pending' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 0, NULL FROM orders) GROUP BY 1""")
def risk_union_max(spark: SparkSession, d: str) -> DataFrame:
    """Rules give rows; the worst one names the level."""
    rules = (("o_totalprice > 400000", 3, "large"), ("o_orderpriority = '1-URGENT'", 2, "urgent"), ("o_orderstatus = 'P'", 1, "pending"), ("true", 0, None))
    orders = read(spark, d, "orders")
    found = reduce(DataFrame.unionAll, (orders.where(w).select("o_orderkey", F.lit(n).alias("level"), F.lit(k).cast("string").alias("kind")) for w, n, k in rules))
    level = F.get(F.array(*map(F.lit, LEVELS)), F.col("most"))
    return found.groupBy("o_orderkey").agg(F.max("level").alias("most"), F.count("kind").alias("n_risks")).select("o_orderkey", level.alias("risk"), "n_risks")


@C.add("SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT p_partkey FROM part WHERE p_size > 25 EXCEPT SELECT p_partkey FROM part WHERE p_type = 'PROMO'")
def indirect_references(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part")
    used = read(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey")
    return used.intersect(parts.where("p_size > 25").select("p_partkey")).subtract(parts.where("p_type = 'PROMO'").select("p_partkey"))


QUERIES, ORACLE_SQL = C.queries, C.sql
