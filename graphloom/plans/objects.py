"""Object queries and link traversals over the star schema: regions, nations and customers contain, orders import parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import annotations as N
from graphloom.operators import links as L
from graphloom.operators.where import query, where
from graphloom.plans.explore import by_keyword
from graphloom.plans.registry import Catalogue, read

C = Catalogue()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "conversations")


@C.add("SELECT c_custkey, c_name FROM customer WHERE CAST(c_mktsegment AS VARCHAR) = 'BUILDING'")
def where_eq(spark: SparkSession, d: str) -> DataFrame:
    return where(read(spark, d, "customer"), "c_mktsegment=BUILDING").select("c_custkey", "c_name")


@C.add("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def where_contains(spark: SparkSession, d: str) -> DataFrame:
    return where(read(spark, d, "part"), "p_name~RING").select("p_partkey", "p_name")


@C.add("SELECT p_partkey, p_name, p_size FROM part WHERE p_brand = 'Brand#2' AND contains(lower(p_name), 'red') AND contains(CAST(p_size AS VARCHAR), '1')")
def where_and_mixed(spark: SparkSession, d: str) -> DataFrame:
    return where(read(spark, d, "part"), "p_brand:Brand#2,p_name~Red,p_size~1").select("p_partkey", "p_name", "p_size")


@C.add("SELECT c_custkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey WHERE coalesce(CAST(s_name AS VARCHAR), 'null') = 'null'")
def where_null_text(spark: SparkSession, d: str) -> DataFrame:
    customers, suppliers = read(spark, d, "customer"), read(spark, d, "supplier")
    return where(customers.join(suppliers, F.col("c_custkey") == F.col("s_suppkey"), "left"), "s_name=null").select("c_custkey")


def _worded(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").withColumn("words", F.split("p_name", " "))


@C.add("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def where_array_member(spark: SparkSession, d: str) -> DataFrame:
    return where(_worded(spark, d), "words=ring").select("p_partkey", "p_name")


@C.add("SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 'dge'))) > 0")
def where_array_contains(spark: SparkSession, d: str) -> DataFrame:
    return where(_worded(spark, d), "words~DGE").select("p_partkey", "p_name")


@C.add("SELECT (SELECT count(*) FROM region) AS eq_rows, 0::BIGINT AS contains_rows")
def where_unknown_key(spark: SparkSession, d: str) -> DataFrame:
    regions = read(spark, d, "region")
    n = F.count("*")
    eq = where(regions, "colour=undefined").agg(n.alias("eq_rows"))
    return eq.withColumn("one", F.lit(1)).join(where(regions, "colour~undef").agg(n.alias("contains_rows")).withColumn("one", F.lit(1)), "one").drop("one")


@C.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 50")
def query_limit_default(spark: SparkSession, d: str) -> DataFrame:
    return query(read(spark, d, "orders"), "o_orderstatus=P", order="o_orderkey").select("o_orderkey", "o_totalprice")


@C.add("SELECT count(*) AS total, least(count(*), 50) AS shown FROM orders WHERE o_orderstatus = 'F'")
def query_total(spark: SparkSession, d: str) -> DataFrame:
    return where(read(spark, d, "orders"), "o_orderstatus=F").agg(F.count("*").alias("total"), F.least(F.count("*"), F.lit(50).cast("long")).alias("shown"))


@C.add("""SELECT p_partkey, p_name, p_type FROM part WHERE len(list_filter([p_name, p_brand, p_type, CAST(p_partkey AS VARCHAR)], lambda x: contains(lower(x), 'econ'))) > 0
ORDER BY p_partkey LIMIT 20""")
def query_keyword(spark: SparkSession, d: str) -> DataFrame:
    return by_keyword(read(spark, d, "part"), "econ", ("p_name", "p_brand", "p_type", "p_partkey"), "p_partkey").select("p_partkey", "p_name", "p_type")


@C.add(" UNION ALL ".join(f"SELECT '{t}' AS type, count(*) AS n FROM {t}" for t in TABLES))
def object_counts(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionAll, (read(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("type"), "n") for t in TABLES))


def _contains(spark: SparkSession, d: str) -> DataFrame:
    """contains: a region its nations; a nation its customers, then its suppliers."""
    part = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    region = L.edges(read(spark, d, "nation"), "contains", part("region:", "n_regionkey"), part("nation:", "n_nationkey"), F.lit(0))
    customers = L.edges(read(spark, d, "customer"), "contains", part("nation:", "c_nationkey"), part("customer:", "c_custkey"), F.lit(0))
    suppliers = L.edges(read(spark, d, "supplier"), "contains", part("nation:", "s_nationkey"), part("supplier:", "s_suppkey"), F.lit(1))
    return region.unionAll(customers).unionAll(suppliers)


_CONTAINS = """(SELECT 'region:' || n_regionkey AS src_id, 'nation:' || n_nationkey AS dst_id, 0::BIGINT AS ord FROM nation
UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 0 FROM customer UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 1 FROM supplier)"""


@C.add(f"SELECT dst_id, ord FROM {_CONTAINS} WHERE src_id = 'region:1'")
def link_contains_region(spark: SparkSession, d: str) -> DataFrame:
    return L.follow(_contains(spark, d), "contains", "region:1")


@C.add(f"SELECT dst_id, ord FROM {_CONTAINS} WHERE src_id = 'nation:3'")
def link_contains_nation(spark: SparkSession, d: str) -> DataFrame:
    return L.follow(_contains(spark, d), "contains", "nation:3")


@C.add(f"SELECT split_part(src_id, ':', 1) AS src_type, split_part(dst_id, ':', 1) AS dst_type, count(*) AS n FROM {_CONTAINS} GROUP BY ALL")
def link_contains_polymorphic(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda c: F.substring_index(c, ":", 1)
    return _contains(spark, d).groupBy(kind("src_id").alias("src_type"), kind("dst_id").alias("dst_type")).agg(F.count("*").alias("n"))


def _imports(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first"))
    return L.edges(items, "imports", "l_orderkey", "l_partkey", "first")


@C.add("SELECT l_orderkey AS src_id, l_partkey AS dst_id, min(l_linenumber)::BIGINT AS ord FROM lineitem GROUP BY ALL")
def link_imports(spark: SparkSession, d: str) -> DataFrame:
    return _imports(spark, d).select("src_id", "dst_id", "ord")


@C.add("SELECT l_partkey AS src_id, count(DISTINCT l_orderkey) AS n_importers FROM lineitem GROUP BY 1")
def link_imported_by(spark: SparkSession, d: str) -> DataFrame:
    back = L.with_inverse(_imports(spark, d)).where("link_type = 'importedBy'")
    return back.groupBy("src_id").agg(F.count("*").alias("n_importers"))


@C.add("""SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey WHERE c.c_nationkey = 4 AND c.c_mktsegment = 'MACHINERY'
UNION SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey = 4""")
def link_registers_or(spark: SparkSession, d: str) -> DataFrame:
    """Either of two keys links; as a union of equal-key joins, not a join on OR.

    Keys are made distinct before they are paired, and what both joins would give is left to the first: no task remembers pairs.
    """
    customers = read(spark, d, "customer").where("c_nationkey = 4").groupBy("c_custkey").agg(F.max(F.expr("c_mktsegment <=> 'MACHINERY'")).alias("c_near"))
    suppliers = read(spark, d, "supplier").groupBy("s_suppkey").agg(F.max(F.expr("s_nationkey <=> 4")).alias("s_near"))
    near = L.all_pairs(customers.where("c_near").select("c_custkey"), suppliers.where("s_near").select("s_suppkey"))
    same = customers.join(suppliers, F.col("c_custkey") == F.col("s_suppkey")).where("not (c_near and s_near)")
    return near.unionAll(same.select("c_custkey", "s_suppkey"))


@C.add("""SELECT DISTINCT o_custkey AS file_id, p_brand AS store FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'P' AND p_size > 45""")
def link_uses_via_file(spark: SparkSession, d: str) -> DataFrame:
    """usesStore: what an object's imports hold."""
    files = read(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    stores = read(spark, d, "part").where("p_size > 45").select("p_partkey", "p_brand")
    items = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return items.join(stores, F.col("l_partkey") == F.col("p_partkey")).join(files, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("file_id"), F.col("p_brand").alias("store")).distinct()


@C.add("""SELECT r_name AS domain, 'customer' AS kind, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
UNION ALL SELECT r_name, 'supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def link_belongs_to(spark: SparkSession, d: str) -> DataFrame:
    bridge = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("domain"))
    kinds = {"customer": "c_nationkey", "supplier": "s_nationkey"}
    members = reduce(DataFrame.unionAll, (read(spark, d, k).select(F.col(v).alias("n_nationkey"), F.lit(k).alias("kind")) for k, v in kinds.items()))
    return members.join(bridge, "n_nationkey").groupBy("domain", "kind").agg(F.count("*").alias("n"))


@C.add("""SELECT CASE WHEN n = 1 THEN base ELSE base || '@' || n END AS id, p_partkey FROM
(SELECT 'comp:' || p_name AS base, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def unique_id_suffix(spark: SparkSession, d: str) -> DataFrame:
    return L.unique_ids(read(spark, d, "part").withColumn("base", F.concat(F.lit("comp:"), "p_name")), "base", "p_partkey").select("id", "p_partkey")


@C.add("""SELECT src_id, string_agg(CAST(dst_id AS VARCHAR), ',' ORDER BY ord, dst_id) AS dst_ids FROM
(SELECT l_orderkey AS src_id, l_partkey AS dst_id, min(l_linenumber) AS ord FROM lineitem GROUP BY ALL) GROUP BY src_id""")
def adjacency_build(spark: SparkSession, d: str) -> DataFrame:
    return L.adjacency(_imports(spark, d)).select("src_id", F.array_join(F.transform("dst_ids", lambda x: x.cast("string")), ",").alias("dst_ids"))


@C.add("SELECT p_partkey AS src_id, unnest(string_split(p_name, ' ')) AS dst_id, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS ord FROM part")
def adjacency_explode(spark: SparkSession, d: str) -> DataFrame:
    return L.explode_adjacency(_worded(spark, d), "renders", "p_partkey", "words").select("src_id", "dst_id", "ord")


@C.add("SELECT DISTINCT l_orderkey AS src_id, l_partkey AS dst_id FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 10)")
def dangling_drop(spark: SparkSession, d: str) -> DataFrame:
    """Edges to objects that aren't there (here: parts above size 10) are dropped."""
    there = read(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("dst_id"))
    return _imports(spark, d).join(there, "dst_id", "left_semi").select("src_id", "dst_id")


@C.add("""SELECT p_brand AS base_id, p_type AS target, max(p_partkey) AS overrides_id, count(DISTINCT p_partkey) AS n_overridden FROM part WHERE p_size < 20 GROUP BY ALL""")
def link_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Of several parents the last wins; all count backwards."""
    return read(spark, d, "part").where("p_size < 20").groupBy(F.col("p_brand").alias("base_id"), F.col("p_type").alias("target")).agg(F.max_by("p_partkey", "p_partkey").alias("overrides_id"), F.countDistinct("p_partkey").alias("n_overridden"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as notes on them; an answer reviews."""
    return read(spark, d, "conversations").select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("object_id"), F.col("turn").cast("bigint").alias("seq"), F.col("text").alias("note"), (F.col("role") == "assistant").alias("reviewed"))


@C.add("SELECT 'conv:' || conv_id AS object_id, arg_max(text, turn) AS note, bool_or(role = 'assistant') AS reviewed FROM conversations GROUP BY 1")
def annotations_latest(spark: SparkSession, d: str) -> DataFrame:
    return N.latest(_notes(spark, d))


@C.add("SELECT 'conv:' || conv_id AS object_id, string_agg(text, chr(10) ORDER BY turn) AS notes FROM conversations GROUP BY 1")
def notes_append(spark: SparkSession, d: str) -> DataFrame:
    return N.whole(_notes(spark, d))


QUERIES, ORACLE_SQL = C.queries, C.sql
