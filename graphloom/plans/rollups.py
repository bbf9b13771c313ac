"""Aggregation and resolution queries: dominant values, flows, roles, intervals, prefixes, route patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import url_path
from graphloom.operators import aggregates as A
from graphloom.operators import resolve as R
from graphloom.plans.registry import Catalogue, read

C = Catalogue()
RANKS = {"purchase": 6, "signup": 5, "click": 4, "view": 3, "error": 0}
_RANK = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANKS.items()) + " END"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int") % 10)


@C.add(f"SELECT user_id, CAST(props->>'$.k' AS INTEGER) % 10 AS k, arg_max(event_type, {_RANK} * 1000000000::BIGINT - event_id) AS event_type, count(*) AS n FROM events GROUP BY ALL")
def priority_merge(spark: SparkSession, d: str) -> DataFrame:
    return A.priority_merge(_keyed(spark, d), ["user_id", "k"], "event_type", RANKS, "event_id")


@C.add("""SELECT c_nationkey, CASE WHEN count(*) > 1 AND max(n) < 0.25 * sum(n) THEN 'mixed' ELSE arg_max(c_mktsegment, n * 10 - rank) END AS dominant, max(n) AS top_n, sum(n)::BIGINT AS total
FROM (SELECT *, dense_rank() OVER (ORDER BY c_mktsegment) AS rank FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)) GROUP BY 1""")
def argmax_layer_mixed(spark: SparkSession, d: str) -> DataFrame:
    return A.dominant(read(spark, d, "customer"), "c_nationkey", "c_mktsegment", 0.25)


_REGIONS = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey"""


def _flows(spark: SparkSession, d: str, skip_same: bool = False) -> DataFrame:
    items = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    edges = items.join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    groups = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("grp"))
    return A.flow(edges.select(F.col("c_nationkey").alias("src_id"), F.col("s_nationkey").alias("dst_id")), groups, skip_same)


@C.add(f"SELECT cr.r_name AS from_group, sr.r_name AS to_group, count(*) AS n {_REGIONS} GROUP BY ALL")
def flow_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d)


@C.add(f"SELECT cr.r_name AS from_group, sr.r_name AS to_group, count(*) AS n {_REGIONS} WHERE cr.r_name <> sr.r_name GROUP BY ALL")
def cross_domain_edges(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d, skip_same=True)


@C.add(f"SELECT cr.r_name AS from_group, count(*) FILTER (sr.r_name = 'AFRICA') AS AFRICA, count(*) FILTER (sr.r_name = 'AMERICA') AS AMERICA, count(*) FILTER (sr.r_name = 'ASIA') AS ASIA {_REGIONS} GROUP BY ALL")
def pivot_matrix(spark: SparkSession, d: str) -> DataFrame:
    return A.matrix(_flows(spark, d), ["AFRICA", "AMERICA", "ASIA"])


@C.add(f"SELECT from_group, to_group, CASE WHEN n = 0 THEN 'cold' WHEN n > 0.4 * max(n) OVER () THEN 'hot' ELSE 'warm' END AS heat FROM (SELECT cr.r_name AS from_group, sr.r_name AS to_group, count(*) AS n {_REGIONS} GROUP BY ALL)")
def flow_heat(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).select("from_group", "to_group", A.heat(F.col("n"), F.max("n").over(Window.partitionBy(F.lit(0)))).alias("heat"))


@C.add("SELECT o_orderstatus, count(*) AS n, floor(count(*) * 1000.0::DOUBLE / (SELECT count(*) FROM orders) + 0.5) / 10 AS share FROM orders GROUP BY 1")
def layer_share(spark: SparkSession, d: str) -> DataFrame:
    return A.shares(read(spark, d, "orders"), "o_orderstatus")


@C.add("""SELECT c_nationkey, array_to_string(list(c_mktsegment ORDER BY first)[1:3], '、') AS capability FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS first FROM customer GROUP BY ALL) GROUP BY 1""")
def capability_join(spark: SparkSession, d: str) -> DataFrame:
    first = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first"))
    return first.groupBy("c_nationkey").agg(A.first_names("c_mktsegment", "first", 3).alias("capability"))


@C.add("SELECT from_role, to_role, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_role, event_type AS to_role FROM events) WHERE from_role IS NOT NULL AND from_role <> to_role GROUP BY ALL")
def role_flow_matrix(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = read(spark, d, "events").select(before.alias("from_role"), F.col("event_type").alias("to_role"))
    return rows.where("from_role <> to_role").groupBy("from_role", "to_role").agg(F.count("*").alias("n"))


@C.add("""SELECT user_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN p > 45 THEN 'render' END, CASE WHEN v > 45 THEN 'data' END, CASE WHEN c > 45 THEN 'state' END, CASE WHEN e > 45 THEN 'event' END], lambda x: x IS NOT NULL)[1:2], ','), ''), 'logic') AS roles FROM
(SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)""")
def role_infer(spark: SparkSession, d: str) -> DataFrame:
    """At most two roles in a fixed order; `logic` if none."""
    kinds = {"purchase": "render", "view": "data", "click": "state", "error": "event"}
    counts = read(spark, d, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    roles = F.slice(F.array_compact(F.array(*(F.when(F.col(k) > 45, v) for k, v in kinds.items()))), 1, 2)
    return counts.select("user_id", F.when(F.size(roles) == 0, "logic").otherwise(F.array_join(roles, ",")).alias("roles"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Signups open spans of 200 events, purchases of 20."""
    rows = read(spark, d, "events").where("event_type in ('signup', 'purchase')")
    return rows.select("user_id", F.col("event_id").alias("span"), F.col("event_id").alias("low"), (F.col("event_id") + F.when(F.col("event_type") == "signup", 200).otherwise(20)).alias("high"))


_SPANS = "(SELECT user_id, event_id AS span, event_id AS low, event_id + CASE event_type WHEN 'signup' THEN 200 ELSE 20 END AS high FROM events WHERE event_type IN ('signup', 'purchase'))"


@C.add(f"SELECT e.user_id, e.event_id AS pos, max(s.span) AS span FROM events e LEFT JOIN {_SPANS} s ON s.user_id = e.user_id AND e.event_id >= s.low AND e.event_id < s.high WHERE e.event_type = 'click' GROUP BY ALL")
def interval_innermost(spark: SparkSession, d: str) -> DataFrame:
    points = read(spark, d, "events").where("event_type = 'click'").select("user_id", F.col("event_id").alias("pos"))
    return R.innermost(points, _spans(spark, d), "user_id")


@C.add(f"SELECT s.span, count(e.event_id) AS n_events, count(e.event_id) FILTER (e.event_type = 'error') AS n_errors FROM {_SPANS} s LEFT JOIN events e ON s.user_id = e.user_id AND e.event_id >= s.low AND e.event_id < s.high GROUP BY 1")
def interval_counts(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select("user_id", "event_id", "event_type")
    inside = R.around(events, _spans(spark, d), "user_id", "event_id")
    return inside.groupBy("span").agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


PREFIXES = ("en", "en/1", "fr", "de/2", "es")
_VALUES = ", ".join(f"('{p}')" for p in PREFIXES)
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@C.add(f"""SELECT p.page_id, p.path, max_by(x.prefix, length(x.prefix)) AS prefix FROM (SELECT page_id, trim({_PATH}, '/') AS path FROM pages) p LEFT JOIN (VALUES {_VALUES}) x(prefix)
ON p.path = x.prefix OR starts_with(p.path, x.prefix || '/') GROUP BY ALL""")
def prefix_longest_join(spark: SparkSession, d: str) -> DataFrame:
    paths = read(spark, d, "pages").select("page_id", F.trim(url_path(F.col("url")), F.lit("/")).alias("path"))
    return R.longest_prefix(paths, spark.createDataFrame([(p,) for p in PREFIXES], "prefix string"), "path", "prefix", "page_id")


@C.add("""SELECT o_orderkey, arg_min(p_partkey, rank * 100000000 + p_partkey) AS p_partkey, arg_min(p_name, rank * 100000000 + p_partkey) AS p_name FROM (SELECT o_orderkey, unnest([o_orderkey + 1000000, o_orderkey, o_custkey]) AS k, unnest([0, 1, 2]) AS rank FROM orders) JOIN part ON p_partkey = k GROUP BY 1""")
def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Probes in order; the first that names a part wins."""
    orders = read(spark, d, "orders")
    probes = orders.select("o_orderkey", F.posexplode(F.array(F.col("o_orderkey") + 1_000_000, F.col("o_orderkey"), F.col("o_custkey"))).alias("rank", "p_partkey"))
    return R.ranked_lookup(probes, read(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "o_orderkey")


PATTERNS = ((0, "/en/:id"), (1, "/:lang/:id"), (2, "/blog/*rest"), (3, "/fr/*rest"))
_ROUTES = "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in PATTERNS) + ") r(ord, pattern)"
_CALLS = f"(SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS have FROM (SELECT page_id, {_PATH} AS path FROM pages UNION ALL SELECT -page_id - 1, '/fr/a/' || page_id || '/x' FROM pages UNION ALL SELECT -page_id - 1000000000, '/none/' || page_id || '/y' FROM pages))"
_MATCHED = f"""(SELECT c.page_id, c.path, arg_min(r.pattern, r.ord) AS pattern FROM {_CALLS} c LEFT JOIN (SELECT ord, pattern, list_filter(string_split(pattern, '/'), lambda x: x <> '') AS want FROM {_ROUTES}) r
ON (len(c.have) = len(r.want) OR (starts_with(r.want[-1], '*') AND len(c.have) >= len(r.want)))
AND len(list_filter(range(1, len(r.want) + 1), lambda i: NOT (r.want[i][1] IN (':', '*') OR r.want[i] = c.have[i]))) = 0 GROUP BY ALL)"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    pages, own = read(spark, d, "pages"), F.col("page_id")
    calls = pages.select(own, url_path(F.col("url")).alias("path"))
    # beside each page's own path two more calls, one that a deep pattern fits and one that none does
    calls = calls.unionAll(pages.select(-own - 1, F.concat(F.lit("/fr/a/"), own.cast("string"), F.lit("/x"))))
    calls = calls.unionAll(pages.select(-own - 1_000_000_000, F.concat(F.lit("/none/"), own.cast("string"), F.lit("/y"))))
    return R.match_routes(calls, spark.createDataFrame(PATTERNS, "ord int, pattern string"))


@C.add(f"SELECT page_id, pattern FROM {_MATCHED} WHERE pattern IS NOT NULL")
def route_pattern_join(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).where("pattern is not null").select("page_id", "pattern")


@C.add(f"SELECT page_id, path FROM {_MATCHED} WHERE pattern IS NULL")
def route_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).where("pattern is null").select("page_id", "path")


@C.add("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def section_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role")
    return R.carry_forward(rows, F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], "turn", "section")


@C.add("SELECT CAST(props->>'$.k' AS INTEGER) AS k, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return read(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@C.add("""SELECT lower(raw) AS key, arg_min(raw, ord) AS name, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM (SELECT upper(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')[2]) AS raw, 0 AS ord, 'path' AS source FROM pages
UNION ALL SELECT lang, 1, 'lang' FROM documents) WHERE raw <> '' GROUP BY 1""")
def domain_merge_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for domains from two places; the first spelling names the domain."""
    paths = read(spark, d, "pages").select(F.upper(F.get(F.split(url_path(F.col("url")), "/"), F.lit(1))).alias("raw"), F.lit(0).alias("ord"), F.lit("path").alias("source"))
    langs = read(spark, d, "documents").select(F.col("lang").alias("raw"), F.lit(1), F.lit("lang"))
    rows = paths.unionAll(langs).where("raw <> ''")
    return rows.groupBy(F.lower("raw").alias("key")).agg(F.min_by("raw", "ord").alias("name"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n"))


@C.add("""SELECT (SELECT count(*) FROM orders) AS files, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) AS orphans,
(SELECT count(*) FROM events WHERE event_type = 'error') AS errors""")
def health_profile(spark: SparkSession, d: str) -> DataFrame:
    one = F.lit(1).alias("one")
    used = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    parts = (
        read(spark, d, "orders").agg(F.count("*").alias("files"), F.count_if(F.col("o_orderstatus") == "P").alias("pending")).select(one, "*"),
        read(spark, d, "part").join(used, "p_partkey", "left_anti").agg(F.count("*").alias("orphans")).select(one, "*"),
        read(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors")).select(one, "*"),
    )
    return parts[0].join(parts[1], "one").join(parts[2], "one").drop("one")


@C.add("""SELECT l_returnflag AS kind, l_linestatus AS target, count(*) AS call_count, bool_or(l_discount > 0.09) AS interpolated, array_to_string(list(DISTINCT l_linenumber ORDER BY l_linenumber)[1:5], ',') AS lines FROM lineitem GROUP BY ALL""")
def injection_groups(spark: SparkSession, d: str) -> DataFrame:
    """Call sites by kind and target: count, whether any is interpolated, the first five lines."""
    lines = F.slice(F.sort_array(F.collect_set("l_linenumber")), 1, 5)
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("target")).agg(
        F.count("*").alias("call_count"), F.bool_or(F.col("l_discount") > 0.09).alias("interpolated"), F.array_join(F.transform(lines, lambda x: x.cast("string")), ",").alias("lines")
    )


QUERIES, ORACLE_SQL = C.queries, C.sql
