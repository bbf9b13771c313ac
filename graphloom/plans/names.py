"""Scalar functions over names, urls and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.text import url_path
from graphloom.operators.resolve import glob_match, glob_regex, normal_route
from graphloom.plans.registry import Catalogue, read
from graphloom.sources.markup import page_links, page_tags

C = Catalogue()
_CAMEL = "array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '[-_ ]+'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), '')"


@C.add(f"SELECT p_partkey, {_CAMEL.format(x='p_name')} AS pascal FROM part")
def pascal_case(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.pascal_case(F.col("p_name")).alias("pascal"))


@C.add("SELECT p_partkey, regexp_replace(lower(replace(p_name, ' ', '_') || '.' || p_brand), '[-_.]', '', 'g') AS key FROM part")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), "p_brand")
    return read(spark, d, "part").select("p_partkey", T.normal_name(raw).alias("key"))


_KIND = "CASE " + " ".join(f"WHEN ends_with(n, '{k}') THEN '{v}'" for k, v in T.KIND_SUFFIXES.items()) + " ELSE 'common' END"


@C.add(f"SELECT p_partkey, {_KIND} AS kind FROM (SELECT p_partkey, {_CAMEL.format(x='p_name')} AS n FROM part)")
def kind_suffix(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.kind_of(T.pascal_case(F.col("p_name"))).alias("kind"))


@C.add("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain FROM pages")
def url_domain_extract(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.url_domain(F.col("url")).alias("domain"))


@C.add("SELECT page_id, coalesce(nullif(regexp_replace(string_split(regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1), '?')[1], '/+$', ''), ''), '/') AS path FROM pages")
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", normal_route(F.regexp_extract("url", r"^[a-z]+://[^/]*(/.*)$", 1)).alias("path"))


@C.add("""SELECT page_id, coalesce(list_filter(parts, lambda x: NOT regexp_matches(x, '^(apis?|v[0-9]+)$'))[1], parts[-1], 'root') AS domain FROM
(SELECT page_id, list_filter(string_split('/api/v1' || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages)""")
def route_domain(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.route_domain(F.concat(F.lit("/api/v1"), T.url_path(F.col("url")))).alias("domain"))


@C.add("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(\\.user\\.js|\\.[^.]*)$', '') AS stem, regexp_replace(url, '/[^/]*$', '') AS dir FROM pages")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", T.base_name(url).alias("base"), T.stem(url).alias("stem"), T.dir_name(url).alias("dir"))


@C.add("SELECT tag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9-]*)', 1))) AS tag FROM pages) GROUP BY 1")
def html_tags(spark: SparkSession, d: str) -> DataFrame:
    return page_tags(read(spark, d, "pages")).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


@C.add("SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return page_links(read(spark, d, "pages")).select("page_id", "href")


@C.add("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def meta_pairs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"))


INCLUDE, EXCLUDE = ["**/en/*", "**/fr/**"], ["**/*7*"]
_GLOB = " OR ".join(f"regexp_matches(url, '{glob_regex(g)}')" for g in INCLUDE)


@C.add(f"SELECT page_id FROM pages WHERE ({_GLOB}) AND NOT regexp_matches(url, '{glob_regex(EXCLUDE[0])}')")
def glob_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return glob_match(read(spark, d, "pages"), "url", INCLUDE, EXCLUDE).select("page_id")


@C.add("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@C.add("SELECT conv_id, turn, CASE WHEN length(t) > 60 THEN left(t, 57) || '...' ELSE t END AS shown FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS t FROM conversations)")
def signature_cap(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", T.capped(F.col("text"), 60).alias("shown"))


@C.add("SELECT page_id, (length(left(html, strpos(html, '<body') - 1)) - length(replace(left(html, strpos(html, '<body') - 1), chr(10), '')) + 1)::INTEGER AS line FROM pages WHERE strpos(html, '<body') > 0")
def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The line on which a page's body begins."""
    at = F.instr("html", "<body")
    return read(spark, d, "pages").where(at > 0).select("page_id", T.line_of(F.col("html"), at - 1).alias("line"))


@C.add("SELECT p_partkey, CASE WHEN starts_with(spec, '@') THEN string_split(spec, '/')[1] || '/' || string_split(spec, '/')[2] ELSE string_split(spec, '/')[1] END AS package FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '@' ELSE '' END || lower(p_type) || '/' || replace(p_name, ' ', '/') AS spec FROM part)")
def package_names(spark: SparkSession, d: str) -> DataFrame:
    spec = F.concat(F.when(F.col("p_size") % 2 == 0, "@").otherwise(""), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")))
    return read(spark, d, "part").select("p_partkey", T.package_name(spec).alias("package"))


@C.add("SELECT p_partkey, (p_size, p_partkey % 7, 0) > (25, 3, 1) AS newer FROM part")
def version_compare(spark: SparkSession, d: str) -> DataFrame:
    version = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"))
    return read(spark, d, "part").select("p_partkey", (T.version_parts(version) > T.version_parts(F.lit("25.3.1"))).alias("newer"))


_MARKED = "(SELECT page_id, unnest(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS s FROM pages)"


@C.add(f"""SELECT DISTINCT segment, CASE kind WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN ':' || s WHEN 3 THEN ':' || s || '*' WHEN 4 THEN ':' || s || '?' ELSE s END AS route FROM (SELECT s, page_id % 6 AS kind,
CASE page_id % 6 WHEN 0 THEN '(' || s || ')' WHEN 1 THEN '@' || s WHEN 2 THEN '[' || s || ']' WHEN 3 THEN '[...' || s || ']' WHEN 4 THEN '[[...' || s || ']]' ELSE s END AS segment FROM {_MARKED})""")
def next_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of all urls as a file convention spells groups, slots, parameters and plain ones, and the routes that these mean."""
    s = F.col("s")
    rows = read(spark, d, "pages").select("page_id", F.explode(F.filter(F.split(url_path(F.col("url")), "/"), lambda x: x != "")).alias("s"))
    marks = [("(", ")"), ("@", ""), ("[", "]"), ("[...", "]"), ("[[...", "]]")]
    segment = s
    for i, (before, after) in enumerate(marks):
        segment = F.when(F.col("page_id") % 6 == i, F.concat(F.lit(before), s, F.lit(after))).otherwise(segment)
    return rows.select(segment.alias("segment")).distinct().select("segment", T.next_segment(F.col("segment")).alias("route"))


QUERIES, ORACLE_SQL = C.queries, C.sql
