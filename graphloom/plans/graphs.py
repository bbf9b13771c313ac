"""Graph queries: the trade graph of nations, the path tree of urls, degrees and hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import url_path
from graphloom.operators import aggregates as A
from graphloom.operators import graph as G
from graphloom.operators import links as L
from graphloom.plans.registry import Catalogue, read

C = Catalogue()

#: A customer's nation leads to the four nations that supply most of its lines (the smaller key first among equals).
_TRADE = """WITH RECURSIVE lines AS (SELECT c_nationkey AS src_id, s_nationkey AS dst_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
trade AS (SELECT src_id, dst_id FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY n DESC, dst_id) AS r FROM lines) WHERE r <= 4),
"""


def _trade(spark: SparkSession, d: str) -> DataFrame:
    items, orders = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), read(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers, suppliers = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src_id")), read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst_id"))
    joined = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    counts = joined.groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))
    return A.top_per_group(counts, ["src_id"], [F.desc("n"), F.col("dst_id")], 4).select("src_id", "dst_id")


@C.add(_TRADE + """edges AS (SELECT * FROM trade WHERE src_id <> dst_id), reach AS (SELECT src_id, dst_id FROM edges UNION SELECT r.src_id, e.dst_id FROM reach r JOIN edges e ON r.dst_id = e.src_id)
SELECT a.src_id AS id, least(a.src_id, min(a.dst_id)) AS component FROM reach a JOIN reach b ON a.src_id = b.dst_id AND a.dst_id = b.src_id WHERE a.src_id <> a.dst_id GROUP BY a.src_id""")
def scc_cycles(spark: SparkSession, d: str) -> DataFrame:
    return G.strong_components(_trade(spark, d))


@C.add(_TRADE + """back AS (SELECT dst_id AS src_id, src_id AS dst_id FROM trade), top AS (SELECT dst_id AS id FROM trade GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  reach AS (SELECT dst_id FROM back JOIN top ON src_id = id UNION SELECT e.dst_id FROM reach r JOIN back e ON r.dst_id = e.src_id)
SELECT dst_id AS id FROM reach WHERE dst_id NOT IN (SELECT id FROM top)""")
def transitive_impact(spark: SparkSession, d: str) -> DataFrame:
    """All that depends on the nation that most others lead to, step by step backwards."""
    back = _trade(spark, d).select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    top = back.groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")
    return G.levels(back, top).where("level > 0").select("id")


@C.add(_TRADE + """walk AS (SELECT 0 AS id, 0::BIGINT AS level UNION SELECT t.dst_id, w.level + 1 FROM walk w JOIN trade t ON w.id = t.src_id WHERE w.level < 25)
SELECT id, min(level) AS level FROM walk GROUP BY id""")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return G.levels(_trade(spark, d), spark.createDataFrame([(0,)], "id int"))


@C.add(_TRADE + """up AS (SELECT src_id, dst_id FROM trade WHERE src_id < dst_id), walk AS (SELECT DISTINCT src_id AS id, 0::BIGINT AS level FROM up WHERE src_id NOT IN (SELECT dst_id FROM up)
  UNION SELECT u.dst_id, w.level + 1 FROM walk w JOIN up u ON w.id = u.src_id)
SELECT id, max(level) AS level FROM walk GROUP BY id""")
def longest_level(spark: SparkSession, d: str) -> DataFrame:
    up = _trade(spark, d).where("src_id < dst_id")
    roots = up.select(F.col("src_id").alias("id")).distinct().join(up.select(F.col("dst_id").alias("id")), "id", "left_anti")
    return G.levels(up, roots, longest=True)


@C.add(_TRADE + "closed AS (SELECT src_id, dst_id FROM trade UNION SELECT c.src_id, t.dst_id FROM closed c JOIN trade t ON c.dst_id = t.src_id) SELECT src_id, count(*) AS n_reached FROM closed GROUP BY 1")
def closure_sizes(spark: SparkSession, d: str) -> DataFrame:
    return G.closure(_trade(spark, d)).groupBy("src_id").agg(F.count("*").alias("n_reached"))


_PREFIXES = """(SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS depth FROM
(SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages))"""


def _prefixes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.explode(G.ancestors(url_path(F.col("url")))).alias("path"))


@C.add(f"SELECT DISTINCT array_to_string(parts[1:depth], '/') AS path, depth::INTEGER AS depth, CASE WHEN depth > 1 THEN array_to_string(parts[1:depth - 1], '/') END AS parent FROM {_PREFIXES}")
def path_trie_nodes(spark: SparkSession, d: str) -> DataFrame:
    depth = F.size(F.split("path", "/"))
    return _prefixes(spark, d).select("path", depth.alias("depth"), F.when(depth > 1, F.regexp_replace("path", "/[^/]*$", "")).alias("parent")).distinct()


@C.add(f"SELECT array_to_string(parts[1:depth], '/') AS path, count(*) AS subtree FROM {_PREFIXES} GROUP BY 1")
def ancestors_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _prefixes(spark, d).groupBy("path").agg(F.count("*").alias("subtree"))


@C.add(f"SELECT r_name || '/' || n_name || '/' || c_name AS path FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'")
def tree_walk_paths(spark: SparkSession, d: str) -> DataFrame:
    """Names from the roots down, a join for each level."""
    level = read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("path"))
    children = (read(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name"), read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_nationkey", "c_custkey", "c_name"))
    for child in children:
        parent, own, name = child.columns
        level = level.join(child, F.col("id") == F.col(parent)).select(F.col(own).alias("id"), F.concat_ws("/", "path", name).alias("path"))
    return level.select("path")


def _uses(spark: SparkSession, d: str) -> DataFrame:
    return L.edges(read(spark, d, "lineitem"), "imports", "l_orderkey", "l_partkey", "l_linenumber")


@C.add("SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS in_degree FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def hub_topk(spark: SparkSession, d: str) -> DataFrame:
    pairs = _uses(spark, d).select("src_id", "dst_id").distinct()
    return pairs.groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "id").limit(15)


@C.add(_TRADE + "ends AS (SELECT src_id AS id, 1 AS o, 0 AS i FROM trade UNION ALL SELECT dst_id, 0, 1 FROM trade) SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM ends GROUP BY 1")
def fan_in_out_degree(spark: SparkSession, d: str) -> DataFrame:
    return L.degrees(_trade(spark, d))


@C.add("""WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem WHERE l_quantity > 49), n AS (SELECT p_partkey AS id FROM part),
g AS (SELECT id, (SELECT count(*) FROM e WHERE s = id) AS o, (SELECT count(*) FROM e WHERE t = id) AS i FROM n)
SELECT count(*) FILTER (i = 0 AND o > 0) AS entries, count(*) FILTER (i = 0 AND o = 0) AS orphans, count(*) AS total FROM g""")
def entry_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    found = L.degrees(_uses(spark, d.rstrip("/")).join(read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id")), ["src_id", "dst_id"], "left_semi"))
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("id")).join(found, "id", "left").na.fill(0)
    return nodes.agg(F.count_if((F.col("n_in") == 0) & (F.col("n_out") > 0)).alias("entries"), F.count_if((F.col("n_in") == 0) & (F.col("n_out") == 0)).alias("orphans"), F.count("*").alias("total"))


@C.add("""SELECT place, p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (ORDER BY turn, size DESC, p_brand) AS place FROM
(SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS turn, count(*) OVER (PARTITION BY p_brand) AS size FROM part)) WHERE place <= 48""")
def topk_per_group_roundrobin(spark: SparkSession, d: str) -> DataFrame:
    return A.round_robin(read(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", [F.desc("p_size"), F.col("p_partkey")], 48).select("place", "p_brand", "p_partkey")


@C.add("""SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5""")
def topk_per_domain(spark: SparkSession, d: str) -> DataFrame:
    return A.top_per_group(read(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 5).select("c_nationkey", "c_custkey", "c_acctbal")


@C.add("""SELECT user_id, event_id, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS repeated FROM events""")
def call_chain_repeats(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return read(spark, d, "events").select("user_id", "event_id", F.coalesce(F.col("event_type") == before, F.lit(False)).alias("repeated"))


QUERIES, ORACLE_SQL = C.queries, C.sql
