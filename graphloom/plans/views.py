"""Derived views over the star schema: domains, module profiles, layouts, look-ups, scores, links of one object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import aggregates as A
from graphloom.operators import links as L
from graphloom.operators import resolve as R
from graphloom.plans import explore as E
from graphloom.plans import semantics as S
from graphloom.plans.registry import Catalogue, read

C = Catalogue()

#: Customers as files in folders region/segment.
_PLACED = "(SELECT c_custkey, r_name, c_mktsegment, c_acctbal, r_name || '/' || c_mktsegment AS folder, r_name || '/' || c_mktsegment || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = read(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    folder = F.concat_ws("/", "r_name", "c_mktsegment")
    return rows.select(F.concat(F.lit("file:"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey", "r_name", "c_acctbal", F.col("c_mktsegment").alias("layer"), folder.alias("folder"), F.concat_ws("/", "r_name", "c_mktsegment", "c_name").alias("path"))


def _modules(files: DataFrame) -> DataFrame:
    paths = files.select(F.explode(F.array("r_name", "folder")).alias("path")).distinct()
    return paths.select(F.concat(F.lit("mod:"), "path").alias("id"), "path")


@C.add(f"""WITH p AS (SELECT * FROM {_PLACED}), f AS (SELECT 'dom:' || r_name AS domain_id, 'file:' || c_custkey AS id, 'file' AS kind, path, folder FROM p UNION ALL SELECT 'dom:' || c_mktsegment, 'file:' || c_custkey, 'file', path, folder FROM p)
SELECT domain_id, id, kind FROM f UNION ALL SELECT DISTINCT 'dom:' || r_name, 'mod:' || r_name, 'module' FROM p UNION ALL SELECT DISTINCT 'dom:' || r_name, 'mod:' || folder, 'module' FROM p
UNION ALL SELECT DISTINCT 'dom:' || c_mktsegment, 'mod:' || folder, 'module' FROM p UNION ALL SELECT f.domain_id, 'order:' || o_orderkey, 'order' FROM f JOIN orders ON f.id = 'file:' || o_custkey""")
def domain_members(spark: SparkSession, d: str) -> DataFrame:
    """A path belongs to the domains that its segments name, in whatever spelling; units belong by their file."""
    files = _placed(spark, d)
    raw = files.select(F.explode(F.array("r_name", "layer")).alias("raw")).distinct().select("raw", F.lit(0).alias("rank"), F.lit("").alias("ord"))
    owners = files.select(F.col("c_custkey").alias("o_custkey"), "path")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(owners, "o_custkey").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), "path", F.lit("order").alias("kind"))
    none = spark.createDataFrame([], "id string, domain string")
    return S.memberships(S.candidates(raw), none, _modules(files), files.select("id", "path"), spark.createDataFrame([], "id string, path string"), orders)


_ABOVE = f"(SELECT c_custkey, c_acctbal, c_mktsegment, unnest([r_name, folder]) AS module FROM {_PLACED})"


@C.add(f"""WITH a AS (SELECT * FROM {_ABOVE}), i AS (SELECT c.module, c.c_custkey AS dst, c.c_custkey - 1 AS src FROM a c)
SELECT m.module AS path, m.n_files, coalesce(u.n, 0) AS n_units, coalesce(r.n, 0) AS n_routes, coalesce(x.n, 0) AS n_imported FROM (SELECT module, count(*) AS n_files FROM a GROUP BY 1) m
LEFT JOIN (SELECT module, count(*) AS n FROM a JOIN orders ON o_custkey = c_custkey GROUP BY 1) u USING (module) LEFT JOIN (SELECT module, count(*) AS n FROM a WHERE c_acctbal > 9000 GROUP BY 1) r USING (module)
LEFT JOIN (SELECT i.module, count(*) AS n FROM i JOIN customer s ON s.c_custkey = i.src WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.c_custkey = i.src AND a.module = i.module) GROUP BY 1) x USING (module)""")
def module_profiles(spark: SparkSession, d: str) -> DataFrame:
    """What lies in and below each folder, and how often customers outside lead (by their number) to one inside."""
    files = _placed(spark, d)
    owners = files.select(F.col("c_custkey").alias("o_custkey"), "path")
    units = read(spark, d, "orders").join(owners, "o_custkey").select("path", F.col("o_orderstatus").alias("kind"))
    name = lambda c: F.concat(F.lit("file:"), c.cast("string"))
    known = files.select(F.col("id").alias("src_id"))
    steps = files.select(name(F.col("c_custkey") - 1).alias("src_id"), F.col("id").alias("dst_id")).join(known, "src_id", "left_semi")
    sizes = files.select(F.explode(F.array("r_name", "folder")).alias("path")).groupBy("path").agg(F.count("*").alias("n_files"))
    modules = _modules(files).join(sizes, "path").withColumn("layer", F.lit("mixed"))
    return S.module_profiles(modules, files, units, files.where("c_acctbal > 9000").select("id", "path"), steps).select("path", "n_files", "n_units", "n_routes", "n_imported")


@C.add("SELECT o_orderpriority, n, CASE WHEN p > 0 THEN 'x: ' || p || CASE WHEN p > 1 THEN ' waits' ELSE ' wait' END || ', ' || n || ' orders.' ELSE 'x: ' || n || ' orders.' END AS summary FROM (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1) WHERE n > 1")
def summary_sentences(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p")).where("n > 1")
    return counts.select("o_orderpriority", "n", S.summary({"wait": F.col("p"), "order": F.col("n")}, F.lit("x")).alias("summary"))


LAYOUTS = (("", "root"), ("en", "english"), ("en/1", "first"), ("fr", "french"))
_LAYOUTS = ", ".join(f"('{f}', '{n}')" for f, n in LAYOUTS)
_PATH = "trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')"


@C.add(f"""SELECT page_id, path, array_to_string(list(name ORDER BY length(folder)), '>') AS chain FROM (SELECT page_id, {_PATH} AS path FROM pages) JOIN (VALUES {_LAYOUTS}) l(folder, name) ON folder = '' OR starts_with(path, folder || '/') GROUP BY ALL""")
def layout_chains(spark: SparkSession, d: str) -> DataFrame:
    paths = read(spark, d, "pages").select("page_id", F.trim(T.url_path(F.col("url")), F.lit("/")).alias("path"))
    found = R.layout_chain(paths, spark.createDataFrame(LAYOUTS, "folder string, layout string"))
    return found.select("page_id", "path", F.array_join("chain", ">").alias("chain"))


@C.add("SELECT p_partkey, coalesce(CASE WHEN p_size <= 25 THEN p_type END, first) AS kind FROM part LEFT JOIN (SELECT p_brand, arg_min(p_type, p_partkey) AS first FROM part GROUP BY 1) USING (p_brand)")
def constant_backfill(spark: SparkSession, d: str) -> DataFrame:
    """What isn't spelled out is the first constant of its name."""
    parts = read(spark, d, "part")
    constants = parts.select("p_brand", F.col("p_type").alias("kind"), F.col("p_partkey").alias("ord"))
    rows = parts.select("p_partkey", "p_brand", F.when(F.col("p_size") <= 25, F.col("p_type")).alias("kind"))
    return R.backfill(rows, "kind", "p_brand", constants).select("p_partkey", "kind")


@C.add("SELECT e.user_id, e.event_id, count(s.event_id) AS depth FROM events e LEFT JOIN (SELECT user_id, event_id, event_id + CASE event_type WHEN 'signup' THEN 2000 ELSE 70 END AS high FROM events WHERE event_type IN ('signup', 'purchase')) s ON s.user_id = e.user_id AND e.event_id >= s.event_id AND e.event_id < s.high WHERE e.event_type = 'view' GROUP BY ALL HAVING count(s.event_id) > 0")
def interval_depth(spark: SparkSession, d: str) -> DataFrame:
    """How many spans lie around each event."""
    events = read(spark, d, "events").select("user_id", "event_id", "event_type")
    spans = events.where("event_type in ('signup', 'purchase')").select("user_id", F.col("event_id").alias("low"), (F.col("event_id") + F.when(F.col("event_type") == "signup", 2000).otherwise(70)).alias("high"))
    return R.around(events.where("event_type = 'view'").select("user_id", "event_id"), spans, "user_id", "event_id").groupBy("user_id", "event_id").agg(F.count("*").alias("depth"))


@C.add("""SELECT l_linenumber, 'inject:' || l_linenumber || '#' || row_number() OVER (PARTITION BY l_linenumber ORDER BY n DESC, l_returnflag, l_linestatus) AS id, l_returnflag AS kind, l_linestatus AS target, n
FROM (SELECT l_linenumber, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)""")
def ranked_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids by rank within a group: by falling count, then by name."""
    counts = read(spark, d, "lineitem").groupBy("l_linenumber", F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("target")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("l_linenumber").orderBy(F.desc("n"), "kind", "target"))
    return counts.select("l_linenumber", F.concat(F.lit("inject:"), F.col("l_linenumber").cast("string"), F.lit("#"), place.cast("string")).alias("id"), "kind", "target", "n")


_NATIONS = "(SELECT 'nation:' || n_nationkey AS id, n_name AS name, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey)"


@C.add(f"""WITH n AS (SELECT * FROM {_NATIONS}), k AS (SELECT id, 0 AS rank, id AS key FROM n UNION ALL SELECT id, 1, 'nation:' || lower(name) FROM n UNION ALL SELECT id, 2, path FROM n),
  w AS (SELECT id AS query FROM n UNION SELECT 'Nation:' || name FROM n UNION SELECT path FROM n UNION SELECT 'none:' || name FROM n)
SELECT query, arg_min(id, rank * 1000 + CAST(split_part(id, ':', 2) AS INTEGER)) AS id FROM w LEFT JOIN k ON key = query OR key = lower(query) GROUP BY query""")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """An id, `type:name` or a path names an object, in this order."""
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    objects = rows.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("Nation").alias("type"), F.col("n_name").alias("name"), F.concat_ws("/", "r_name", "n_name").alias("path"))
    wanted = objects.select(F.explode(F.array("id", F.concat(F.lit("Nation:"), "name"), "path", F.concat(F.lit("none:"), "name"))).alias("query")).distinct()
    return E.look_up(objects, wanted)


@C.add("""SELECT link_type, other FROM (SELECT link_type, other, row_number() OVER (PARTITION BY link_type ORDER BY other) AS r FROM (SELECT 'importedBy' AS link_type, 'order:' || l_orderkey AS other FROM lineitem WHERE l_partkey = 7
UNION SELECT 'usesStore', 'brand:' || p_brand FROM part WHERE p_partkey = 7)) WHERE r <= 20 OR link_type <> 'importedBy'""")
def links_of_one(spark: SparkSession, d: str) -> DataFrame:
    """All links of part 7, in both directions; of those that are read backwards the first twenty."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    imports = L.edges(read(spark, d, "lineitem"), "imports", name("order", "l_orderkey"), name("part", "l_partkey"), F.lit(0))
    stores = L.edges(read(spark, d, "part"), "usesStore", name("brand", "p_brand"), name("part", "p_partkey"), F.lit(0))
    return L.neighbours(L.with_inverse(imports.unionByName(stores)), "part:7")


@C.add("""SELECT link_type, count(*) AS n FROM (SELECT DISTINCT unnest(['registers', 'registers']) AS link_type, unnest(['c' || o_custkey, 'o' || o_orderkey]) AS a, unnest(['o' || o_orderkey, 'c' || o_custkey]) AS b FROM orders
UNION ALL SELECT DISTINCT unnest(['calls', 'calledBy']), unnest(['o' || l_orderkey, 's' || l_suppkey]), unnest(['s' || l_suppkey, 'o' || l_orderkey]) FROM lineitem) GROUP BY 1""")
def links_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Links with an inverse get its name backwards, two-way ones keep theirs."""
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    one = L.edges(read(spark, d, "orders"), "registers", name("c", "o_custkey"), name("o", "o_orderkey"), F.lit(0))
    two = L.edges(read(spark, d, "lineitem"), "calls", name("o", "l_orderkey"), name("s", "l_suppkey"), F.lit(0))
    return L.with_inverse(one.unionByName(two)).distinct().groupBy("link_type").agg(F.count("*").alias("n"))


@C.add("SELECT user_id, 3 * count(DISTINCT CAST(props->>'$.k' AS INTEGER)) + count(*) + 2 * count(*) FILTER (event_type = 'purchase') + count(*) FILTER (event_type = 'click') AS score FROM events GROUP BY 1")
def activity_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return read(spark, d, "events").groupBy("user_id").agg((3 * F.countDistinct(k) + F.count("*") + 2 * F.count_if(F.col("event_type") == "purchase") + F.count_if(F.col("event_type") == "click")).alias("score"))


@C.add("SELECT event_type, count(*) AS n, floor(count(*) * 1000.0::DOUBLE / (SELECT count(*) FROM events WHERE event_type <> 'error') + 0.5) / 10 AS share FROM events WHERE event_type <> 'error' GROUP BY 1")
def source_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Shares of sources; one kind doesn't count."""
    return A.shares(read(spark, d, "events").where("event_type <> 'error'"), "event_type")


@C.add("""SELECT r_name AS domain, p_brand AS store, count(DISTINCT c_custkey) AS n_users FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def store_usage_by_domain(spark: SparkSession, d: str) -> DataFrame:
    files = _placed(spark, d).select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("domain"))
    uses = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")), "o_orderkey")
    uses = uses.join(read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("store")), "p_partkey").select("o_custkey", "store").distinct()
    return uses.join(files, "o_custkey").groupBy("domain", "store").agg(F.count("*").alias("n_users"))


@C.add("SELECT row_number() OVER (ORDER BY n DESC, name) AS place, name, n FROM (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1)")
def sorted_by_locale(spark: SparkSession, d: str) -> DataFrame:
    """By falling count, then by name as a reader sorts it."""
    counts = read(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.collate("name", "UNICODE")))
    return counts.select(place.cast("bigint").alias("place"), "name", "n")


@C.add("SELECT o_custkey AS id, count(DISTINCT l_partkey) AS degree FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY degree DESC, id LIMIT 48")
def degree_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 48 nodes with most links: the feature is the limit."""
    pairs = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src_id"), F.col("l_partkey").alias("dst_id")).distinct()
    return pairs.groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(48)


QUERIES, ORACLE_SQL = C.queries, C.sql
