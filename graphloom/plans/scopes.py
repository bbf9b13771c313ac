"""Queries on scopes, forests and open data: what is handed down, what was declared last, what lies outside, ordered trees, nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import url_path
from graphloom.operators import aggregates as A
from graphloom.operators import graph as G
from graphloom.operators import resolve as R
from graphloom.operators.forest import composed
from graphloom.operators.order import ordered_tree
from graphloom.plans.graphs import _TRADE, _trade
from graphloom.plans.registry import Catalogue, read

C = Catalogue()


@C.add("""WITH RECURSIVE turns AS (SELECT DISTINCT conv_id, turn, min(role) OVER (PARTITION BY conv_id, turn) AS role FROM conversations),
walk AS (SELECT conv_id, turn, role AS path, 0::BIGINT AS steps FROM turns t WHERE NOT EXISTS (SELECT 1 FROM turns p WHERE p.conv_id = t.conv_id AND p.turn = t.turn - 1)
  UNION ALL SELECT t.conv_id, t.turn, w.path || '/' || t.role, w.steps + 1 FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.turn = w.turn + 1)
SELECT conv_id, turn, path, steps FROM walk""")
def forest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation with the roles of all turns that lead to it."""
    turns = read(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    nodes = turns.select("conv_id", "turn", F.col("conv_id").alias("up_conv"), (F.col("turn") - 1).alias("up_turn"), F.array("role").alias("roles"))
    return composed(nodes, ["conv_id", "turn"], ["up_conv", "up_turn"], ["roles"]).select("conv_id", "turn", F.array_join("roles", "/").alias("path"), "steps")


@C.add("""SELECT p.user_id, p.event_id, c.event_id AS click_id, c.value AS click_value FROM (SELECT user_id, event_id FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, event_id, value FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.event_id >= c.event_id""")
def declared_before(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the last click of its user before it."""
    events = read(spark, d, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    points = events.where("event_type = 'purchase'").select("user_id", "event_id")
    return R.as_of(points, clicks, ["user_id"], "event_id", "at", ["click_id", "click_value"])


@C.add("""SELECT s.user_id, s.span, s.low, s.high, count(e.event_id) FILTER (e.event_id >= s.low AND e.event_id < s.high) AS n_inside, count(e.event_id) FILTER (e.event_id < s.low OR e.event_id >= s.high) AS n_outside
FROM (SELECT user_id, event_id AS span, event_id AS low, event_id + 200 AS high FROM events WHERE event_type = 'signup') s LEFT JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'click') e ON s.user_id = e.user_id GROUP BY ALL""")
def references_outside(spark: SparkSession, d: str) -> DataFrame:
    """How many clicks of a user lie inside and outside of each span of 200 events that a signup opens."""
    events = read(spark, d, "events")
    low = F.col("event_id")
    spans = events.where("event_type = 'signup'").select("user_id", low.alias("span"), low.alias("low"), (low + 200).alias("high"))
    return R.outside_counts(events.where("event_type = 'click'").select("user_id", low.alias("pos")), spans, "user_id")


@C.add(_TRADE + """best AS (SELECT src_id, min(dst_id) AS dst_id FROM trade WHERE src_id <> dst_id GROUP BY 1), own AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 2),
walk AS (SELECT n_nationkey AS id, n_nationkey AS here, 0::BIGINT AS steps FROM nation UNION ALL SELECT w.id, b.dst_id, w.steps + 1 FROM walk w JOIN best b ON w.here = b.src_id WHERE w.here NOT IN (SELECT id FROM own) AND w.steps < 60)
SELECT n.n_nationkey AS id, w.here AS declared_by, w.steps FROM nation n LEFT JOIN (SELECT * FROM walk WHERE here IN (SELECT id FROM own)) w ON n.n_nationkey = w.id""")
def names_followed(spark: SparkSession, d: str) -> DataFrame:
    """From each nation along the least of its main partners to the first one of a region, as names lead through re-exports to a declaration."""
    nations = read(spark, d, "nation")
    own = nations.where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"))
    return G.follow(nations.select(F.col("n_nationkey").alias("id")), _trade(spark, d).where("src_id <> dst_id"), own).withColumnRenamed("end", "declared_by")


@C.add("""WITH paths AS (SELECT list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
nodes AS (SELECT array_to_string(k, '/') AS path, len(k)::INTEGER AS depth, list_transform(k, lambda s: (CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '1' ELSE '0' END) || s) AS key, count(*) AS n
  FROM (SELECT parts[1:i] AS k FROM (SELECT parts, unnest(range(1, least(len(parts), 3) + 1)) AS i FROM paths)) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (ORDER BY key) AS place FROM nodes)
SELECT path, depth, place, place + size - 1 AS last, n FROM (SELECT a.path, a.depth, a.place, a.n, count(b.path) AS size FROM placed a JOIN placed b ON b.path = a.path OR starts_with(b.path, a.path || '/') GROUP BY ALL)""")
def route_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree of url paths in pre-order, three levels deep; numbers come after names."""
    paths = read(spark, d, "pages").select(url_path(F.col("url")).alias("path"))
    return ordered_tree(paths, "path", F.col("segment").rlike("^[0-9]+$"), 3)


@C.add("""SELECT key, json_type AS kind, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, k AS key, CASE json_type(props, '$.' || k) WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(props, '$.' || k) END AS json_type
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)) GROUP BY ALL""")
def open_schema(spark: SparkSession, d: str) -> DataFrame:
    """Keys of embedded data whose schema isn't known, with their types; the first event that has a key names it."""
    rows = read(spark, d, "events").select("event_id", F.try_parse_json("props").alias("v"))
    each = rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    kind = F.regexp_replace(F.schema_of_variant("value"), "^(TINYINT|SMALLINT|INT)$", "BIGINT")
    return each.select("event_id", "key", kind.alias("kind")).groupBy("key", "kind").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@C.add("""WITH big AS (SELECT c_nationkey, c_name, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_acctbal > 5000)
SELECT n_name AS name, count(b.c_name) AS n, CASE WHEN count(b.c_name) > 0 THEN array_to_string(list(b.c_name ORDER BY b.r) FILTER (b.r <= 5), ',') END AS top FROM nation LEFT JOIN big b ON n_nationkey = b.c_nationkey GROUP BY 1""")
def view_model(spark: SparkSession, d: str) -> DataFrame:
    """Nations as nested rows with their count of large accounts and the names of the first five, null where there is none."""
    large = read(spark, d, "customer").where("c_acctbal > 5000").select("c_nationkey", "c_custkey", "c_name", "c_acctbal")
    tops = A.top_lists(large, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], "c_name", 5)
    rows = read(spark, d, "nation").join(tops, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select(F.col("n_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n"), F.array_join("top", ",").alias("top"))


QUERIES, ORACLE_SQL = C.queries, C.sql
