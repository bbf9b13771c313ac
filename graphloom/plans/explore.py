"""Questions that a person asks of a built graph: objects of a type, one object and its links, statistics, what is dead.

Each answer is a DataFrame over the tables of `ontology.build` or of a saved folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import annotations as N
from graphloom.operators import links as L
from graphloom.operators.aggregates import shares
from graphloom.operators.where import query
from graphloom.plans import ontology, report
from graphloom.plans.types import TYPES

Tables = dict[str, DataFrame]


def of_type(tables: Tables, kind: str) -> DataFrame:
    if kind not in tables or kind not in TYPES:
        raise ValueError(f"unknown type {kind}; there are {', '.join(TYPES)}")
    return tables[kind]


def find(tables: Tables, kind: str, where: str | None = None, limit: int | None = 50) -> DataFrame:
    """Objects of a type that a clause of the `where` language fits."""
    return query(of_type(tables, kind), where, "id", limit)


def by_keyword(df: DataFrame, keyword: str, columns: tuple[str, ...] = ("name", "id", "path"), order: str = "id", limit: int = 20) -> DataFrame:
    """Up to `limit` (50 at most) objects with the keyword in one of the columns, whatever its case."""
    hit = lambda c: F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(keyword.lower()))
    return df.where(reduce(lambda a, b: a | b, (hit(c) for c in columns if c in df.columns))).orderBy(order).limit(min(limit, 50))


def named(tables: Tables) -> DataFrame:
    """id, type, name, path of all objects."""
    text = lambda df, c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    return reduce(DataFrame.unionByName, (df.select("id", F.lit(k).alias("type"), text(df, "name").alias("name"), text(df, "path").alias("path")) for k, df in tables.items() if k in TYPES))


def look_up(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted text (column query) with the id that it names: an id, `type:name`, or a path, in this order; null if none.

    objects: named().
    """
    key = lambda rank, text: F.struct(F.lit(rank).alias("rank"), text.alias("query"))
    keys = F.array(key(0, F.col("id")), key(1, F.concat(F.lower("type"), F.lit(":"), F.lower("name"))), key(2, F.col("path")))
    known = objects.select("id", F.explode(keys).alias("k")).select("id", "k.rank", "k.query").where("query is not null")
    asked = wanted.select("query", F.explode(F.array_distinct(F.array(F.col("query"), F.lower("query")))).alias("key"))
    hits = asked.join(known.withColumnRenamed("query", "key"), "key")
    return wanted.join(hits.groupBy("query").agg(F.min_by("id", F.struct("rank", "id")).alias("id")), "query", "left")


def details(tables: Tables, id_: str) -> dict | None:
    """One object with its fields that aren't empty, and its links."""
    kind = next((k for k, (prefix, *_) in TYPES.items() if id_.startswith(prefix) and k in tables), None)
    row = tables[kind].where(F.col("id") == id_).first() if kind else None
    if row is None:
        return None
    fields = {k: v for k, v in row.asDict(recursive=True).items() if v not in (None, "", [], {})}
    return {"type": kind, **fields, "links": [r.asDict() for r in L.neighbours(tables["edges"], id_).orderBy("link_type", "other").collect()]}


def stats(tables: Tables) -> DataFrame:
    """type, n, level, category."""
    kinds = tables["counts"].sparkSession.createDataFrame([(k, level, category) for k, (_, level, category) in TYPES.items()], "type string, level string, category string")
    return tables["counts"].join(kinds, "type")


def layers(tables: Tables) -> DataFrame:
    return shares(tables["SourceFile"], "layer")


def tallies(tables: Tables) -> DataFrame:
    """by, value, n: types and methods by their file's language and layer, and by their kind; calls that cross languages."""
    files = tables["SourceFile"].select("path", "ext", "layer")
    units = reduce(DataFrame.unionByName, (tables[k].select("path", F.lit(k).alias("kind")) for k in ("Interface", "Class", "Method"))).join(files, "path")
    parts = [units.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("by"), "value", "n") for c in ("ext", "layer", "kind")]
    ends = named(tables).join(files, "path").select("id", "ext")
    calls = tables["edges"].where("link_type = 'calls'").join(ends.withColumnsRenamed({"id": "src_id", "ext": "one"}), "src_id").join(ends.withColumnsRenamed({"id": "dst_id", "ext": "two"}), "dst_id")
    parts.append(calls.where("one <> two").agg(F.count("*").alias("n")).select(F.lit("calls").alias("by"), F.lit("other language").alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def dead(tables: Tables, kind: str | None = None, limit: int = 40) -> DataFrame:
    """What nothing refers to: files, exports, types and functions, script functions; of one kind or all."""
    parts = {
        "file": tables["orphans"].select("id", F.lit("no file imports it").alias("reason")),
        "export": tables["unused_exports"].select(F.concat("id", F.lit("#"), "name").alias("id"), F.lit("no import names it").alias("reason")),
        "type": tables["dead"].where(F.col("id").rlike("^(iface|class):")), "function": tables["dead"].where(F.startswith("id", F.lit("method:"))), "script": tables["dead"].where(F.startswith("id", F.lit("fn:"))),
    }
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("kind"), "id", "reason") for k, df in parts.items() if kind in (None, k)))
    return rows.orderBy("kind", "id").limit(limit)


def refresh(spark: SparkSession, root: str, snapshot: str, roots: tuple[str, ...] = (".",)) -> Tables:
    """Build a tree's graph and save it; notes at the snapshot stay. Facts stay with it: only files that have changed are read for them again."""
    tables = ontology.scan_project(spark, root, roots, stored=f"{snapshot}/source_facts")
    report.save(tables, snapshot)
    return report.load(spark, snapshot)


def analyse_file(spark: SparkSession, root: str, path: str) -> Tables:
    """The graph of one file alone."""
    return ontology.build(ontology.read_sources(spark, root).where(F.col("path") == path))


def annotate(spark: SparkSession, snapshot: str, object_id: str, note: str | None = None, reviewed: bool = False) -> None:
    """Add a note to an object or mark it as reviewed; later notes have larger numbers."""
    path = f"{snapshot}/notes"
    known = _notes(spark, path)
    last = known.agg(F.max("seq").alias("n")).first().n
    N.append(spark, path, [(object_id, (last or 0) + 1, note, reviewed)])


def _notes(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(N.SCHEMA).parquet(path)
    except Exception as e:  # no note was written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], N.SCHEMA)


def with_notes(spark: SparkSession, snapshot: str, objects: DataFrame) -> DataFrame:
    return N.annotated(objects, _notes(spark, f"{snapshot}/notes"))
