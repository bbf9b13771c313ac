"""Written views of a graph: saved tables, a Markdown report, and JSON that is safe inside a page.

Only counts and top lists come to the driver; each list has a limit of its own.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.aggregates import flow, shares
from graphloom.plans.types import TYPES


def save(tables: dict[str, DataFrame], path: str) -> None:
    """A Parquet folder for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


class NoSnapshot(Exception):
    """There is no saved graph at a path."""


def load(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables saved at `path`, all that a build gives or those named."""
    out = {}
    for name in names or (*TYPES, *EXTRA):
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as e:
            raise NoSnapshot(f"no saved graph at {path}: {name} is missing") from e
    return out


#: Tables of a build that hold no objects.
EXTRA = ("edges", "unmatched", "frontend_calls", "risks", "failed", "cycles", "orphans", "dead", "unused_exports", "counts", "top_calls")


def summary(tables: dict[str, DataFrame], top: int = 15) -> dict[str, list[dict]]:
    """A list of rows for each section; lists are cut to a length of their own."""
    rows = lambda df, n=top: [r.asDict(recursive=True) for r in df.limit(n).collect()]
    edges = tables["edges"]
    link = lambda t: edges.where(F.col("link_type") == t)
    into = lambda t, name: link(t).groupBy(F.col("dst_id").alias("id")).agg(F.countDistinct("src_id").alias(name)).orderBy(F.desc(name), "id")
    listed = lambda t, name: link(t).groupBy(F.col("src_id").alias("id")).agg(F.sort_array(F.collect_set("dst_id")).alias(name)).orderBy("id")
    domain_of = link("belongsTo").where(F.startswith("dst_id", F.lit("dom:"))).select(F.col("src_id").alias("id"), F.col("dst_id").alias("grp"))
    layer_of = tables["SourceFile"].select("id", F.col("layer").alias("grp"))
    scripts = tables["UserScript"]
    return {
        "project": rows(tables["Project"]),
        "counts": rows(tables["counts"].orderBy("type"), 100),
        "layers": rows(shares(tables["SourceFile"], "layer").orderBy(F.desc("n"), "layer"), 100),
        "layer flow": rows(flow(link("imports"), layer_of).orderBy("from_group", "to_group"), 200),
        "domains": rows(tables["Domain"].select("name", "sources", "n_route", "n_module", "n_file", "line_count", "capability", "summary").orderBy(F.desc("n_file"), "name"), 100),
        "domain flow": rows(flow(link("renders"), domain_of, skip_same=True).orderBy(F.desc("n"), "from_group", "to_group"), 100),
        "modules": rows(tables["Module"].select("path", "layer", "n_files", "units", "n_routes", "n_imported", "summary").orderBy(F.desc("n_files"), "path"), 30),
        "hubs": rows(into("imports", "imported_by")),
        "routes": rows(tables["Route"].orderBy("ord").select("id", "kind", "domain", "path", "description"), 100),
        "route kinds": rows(shares(tables["Route"], "kind").orderBy(F.desc("n"), "kind"), 20),
        "frontend calls": rows(tables["frontend_calls"].orderBy("path", "url"), 50),
        "unmatched": rows(tables["unmatched"].orderBy("path", "url"), 50),
        "navigation": rows(listed("navigatesTo", "leads_to"), 100),
        "props": rows(tables["PropEdge"].select("src_id", "dst_id", F.transform("props", lambda p: F.concat(p["name"], F.lit(" ("), p["source"], F.lit(")"))).alias("props")).orderBy("src_id", "dst_id"), 120),
        "prop sources": rows(tables["PropEdge"].select(F.explode("props.source").alias("source")).where("source <> 'spread'").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source"), 10),
        "most given": rows(into("passesProps", "given_by"), 20),
        "most rendered": rows(into("renders", "rendered_by"), 20),
        "stores": rows(into("usesStore", "n").where(F.startswith("id", F.lit("store:")))),
        "interfaces": rows(listed("implementedBy", "implemented_by"), 300),
        "overrides": rows(listed("overrides", "overrides"), 200),
        "classes": rows(listed("extends", "extends"), 300),
        "callers": rows(into("calls", "called_by"), 30),
        "scripts": rows(scripts.select("name", "risk_level", "n_risks", "host", "line_count", "matches").orderBy("name"), 50),
        "script functions": rows(tables["ScriptFunction"].select("id", "roles", "calls", "called_by", "score", "dead").orderBy(F.desc("score"), "id"), 30),
        "injections": rows(tables["InjectionPoint"].select("id", "kind", "target", "call_count", "interpolated", "fns").orderBy(F.desc("call_count"), "id"), 20),
        "endpoints": rows(tables["NetworkEndpoint"].select("id", "kind", "domain", "call_count", "allowed").orderBy(F.desc("call_count"), "id"), 12),
        "risks": rows(tables["risks"].orderBy("path", "kind", "detail"), 100),
        "cycles": rows(tables["cycles"].orderBy("component"), 50),
        "orphans": rows(tables["orphans"].orderBy("path"), 50),
        "dead": rows(tables["dead"].orderBy("id"), 50),
        "unused exports": rows(tables["unused_exports"].orderBy("path", "name"), 50),
        "packages": rows(tables["Dependency"].orderBy(F.desc("import_count"), "name"), 30),
        "failed": rows(tables["failed"].orderBy("path"), 50),
    }


def text_table(found: list[dict], widest: int = 40) -> str:
    """Rows as columns of text; the first row names the columns, long values are cut."""
    if not found:
        return "(no rows)"
    cells = [[k for k in found[0]]] + [["" if r.get(k) is None else str(r[k]) for k in found[0]] for r in found]
    widths = [min(widest, max(len(row[i]) for row in cells)) for i in range(len(cells[0]))]
    return "\n".join("  ".join((v if len(v) <= w else v[: w - 1] + "…").ljust(w) for v, w in zip(row, widths, strict=True)).rstrip() for row in cells)


def markdown(found: dict[str, list[dict]], title: str = "Report") -> str:
    cell = lambda v: str(", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else v).replace("|", "\\|")
    out = [f"# {title}"]
    for name, rows in found.items():
        out.append(f"\n## {name.capitalize()}\n")
        if not rows:
            out.append("None.")
            continue
        keys = list(rows[0])
        out += ["| " + " | ".join(keys) + " |", "|" + "---|" * len(keys), *("| " + " | ".join(cell(r[k]) for k in keys) + " |" for r in rows)]
    return "\n".join(out) + "\n"


def page_json(found: dict[str, list[dict]]) -> str:
    """JSON that may stand in a script element."""
    return json.dumps(found, ensure_ascii=False, default=str).replace("<", "\\u003c").replace("-->", "--\\u003e")


def page(found: dict[str, list[dict]], title: str = "Report") -> str:
    """One HTML page that needs nothing else: the data as JSON, and a table for each part."""
    script = "for(const[k,rows]of Object.entries(data)){const h=document.createElement('h2');h.textContent=k;document.body.append(h);const t=document.createElement('table');for(const r of rows){const tr=t.insertRow();for(const v of Object.values(r))tr.insertCell().textContent=v}document.body.append(t)}"
    name = title.replace("&", "&amp;").replace("<", "&lt;")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{name}</title></head><body><h1>{name}</h1><script>const data={page_json(found)};{script}</script></body></html>'
