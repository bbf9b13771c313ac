"""Meaning above files: functional domains, what modules and domains hold, and the project as one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import aggregates as A
from graphloom.operators.graph import ancestors

# Folder names that tell a technique, not a domain.
TECHNICAL = (
    "src", "srcs", "app", "apps", "packages", "package", "lib", "libs", "node_modules", "routes", "route", "pages", "page", "views", "screens",
    "layouts", "layout", "components", "component", "ui", "widgets", "overlays", "templates", "features", "feature", "entities", "processes",
    "containers", "modules", "module", "stores", "store", "state", "redux", "zustand", "pinia", "globals", "providers", "presentation", "services",
    "service", "domain", "domains", "business", "usecases", "engines", "api", "apis", "clients", "client", "http", "network", "gateways", "adapters",
    "repositories", "hooks", "composables", "utils", "helpers", "shared", "common", "tools", "kit", "core", "types", "type", "models", "interfaces",
    "schemas", "typings", "config", "configs", "constants", "env", "settings", "options", "tests", "test", "__tests__", "e2e", "spec", "specs", "mocks",
    "fixtures", "testing", "scripts", "userscripts", "assets", "styles", "style", "scss", "css", "static", "public", "entry", "bootstrap", "startup",
    "main", "dist", "build", "coverage", "docs", "examples", "demo", "demos", "src-tauri", "electron", "extensions", "dao",
)


def candidates(names: DataFrame) -> DataFrame:
    """key, name: spellings of one name are one domain, and the first (by rank and order) is shown. names: raw, rank, ord."""
    return names.groupBy(T.normal_name(F.col("raw")).alias("key")).agg(F.min_by("raw", F.struct("rank", "ord", "raw")).alias("name")).where("key <> ''")


def domain_names(routes: DataFrame, modules: DataFrame) -> DataFrame:
    """key, name of domains: of routes first, then of folders with a name of their own under a technical folder or at the top.

    routes: domain; modules: path.
    """
    shown = routes.where(~F.col("domain").isin("", "root") & ~F.startswith("domain", F.lit(":"))).groupBy(F.col("domain").alias("raw")).agg(F.min("ord").alias("at"))
    shown = shown.select("raw", F.lit(0).alias("rank"), F.to_json(F.struct("at")).alias("ord"))
    parts = F.split("path", "/")
    depth, name, above = F.size(parts), F.lower(F.element_at(parts, -1)), F.lower(F.try_element_at(parts, F.lit(-2)))
    folders = modules.where(~name.isin(*TECHNICAL) & ((depth <= 2) | above.isin(*TECHNICAL)))
    folders = folders.select(F.element_at(F.split("path", "/"), -1).alias("raw"), F.lit(1).alias("rank"), F.col("path").alias("ord"))
    return candidates(shown.unionByName(folders))


def memberships(names: DataFrame, routes: DataFrame, modules: DataFrame, files: DataFrame, route_files: DataFrame, units: DataFrame) -> DataFrame:
    """domain_id, id, kind (module, route, file, or the unit's) of all that belongs to a domain.

    A module belongs by any segment of its path, a file by its folders or by a route of the domain that it shows, a unit by its
    file. A path meets domains on its normalised segments, so no module is compared with every domain.
    routes: id, domain; modules: id, path; files: id, path; route_files: id (of a route), path; units: id, path, kind.
    """
    domain = names.select("key", F.concat(F.lit("dom:"), "name").alias("domain_id"), "name")
    segments = lambda c: F.explode(F.transform(F.array_distinct(F.split(c, "/")), T.normal_name)).alias("key")
    by_module = modules.select("id", "path", segments("path")).join(domain, "key").select("domain_id", "id").distinct()
    by_route = routes.join(domain, routes["domain"] == domain["name"]).select("domain_id", "id")
    by_folder = files.select("id", "path", segments(T.dir_name(F.col("path")))).join(domain, "key").select("domain_id", "id", "path")
    shown = by_route.join(route_files, "id").join(files.withColumnRenamed("id", "file_id"), "path").select("domain_id", F.col("file_id").alias("id"), "path")
    in_files = by_folder.unionByName(shown).distinct()
    of_units = in_files.select("domain_id", "path").join(units, "path").select("domain_id", "id", "kind")
    one = lambda df, kind: df.select("domain_id", "id", F.lit(kind).alias("kind"))
    return reduce(DataFrame.unionByName, (one(by_module, "module"), one(by_route, "route"), one(in_files, "file"), of_units)).distinct()


UNITS = ("module", "route", "file", "component", "store", "hook", "service", "script")


def domains(names: DataFrame, members: DataFrame, files: DataFrame, routes: DataFrame) -> DataFrame:
    """id, name, sources, a count for each kind of member, line_count, capability (up to three descriptions of routes) and summary."""
    counts = members.groupBy("domain_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in UNITS))
    lines = members.where("kind = 'file'").join(files.select("id", "line_count"), "id").groupBy("domain_id").agg(F.sum("line_count").alias("line_count"))
    told = members.where("kind = 'route'").join(routes.where("description is not null").select("id", "description", "ord"), "id").groupBy("domain_id").agg(A.first_names("description", "ord", 3).alias("capability"))
    rows = names.select(F.concat(F.lit("dom:"), "name").alias("domain_id"), "name").join(counts, "domain_id", "left").join(lines, "domain_id", "left").join(told, "domain_id", "left").na.fill(0)
    sources = F.array_compact(F.array(F.when(F.col("n_route") > 0, "route"), F.when(F.col("n_module") > 0, "module")))
    return rows.withColumnRenamed("domain_id", "id").withColumns({"sources": sources, "summary": summary({k: F.col(f"n_{k}") for k in UNITS}, F.col("capability"))})


def summary(counts: dict[str, Column], head: Column | None = None) -> Column:
    """`head: 2 routes, 5 files.` with the counts that aren't 0."""
    said = F.array_join(F.array_compact(F.array(*(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {k}"), F.when(n > 1, "s").otherwise(""))) for k, n in counts.items()))), ", ")
    return F.concat(F.coalesce(F.concat(head, F.lit(": ")), F.lit("")) if head is not None else F.lit(""), F.when(said == "", "nothing").otherwise(said), F.lit("."))


def module_profiles(modules: DataFrame, files: DataFrame, units: DataFrame, routes: DataFrame, imports: DataFrame) -> DataFrame:
    """Modules with what lies in and below them: files and units by kind, layers, routes, and imports from outside.

    modules: id, path; files: id, path, folder, layer; units: id, path, kind; routes: id, path; imports: src_id, dst_id (files).
    """
    above = files.select("id", "path", "layer", F.explode(ancestors(F.col("folder"))).alias("module"))
    layers = above.groupBy("module", "layer").agg(F.count("*").alias("n")).groupBy("module").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("layer", "n")))).alias("layers"), F.sum("n").alias("n_files"))
    kinds = above.join(units.select("path", "kind"), "path").groupBy("module", "kind").agg(F.count("*").alias("n")).groupBy("module").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("units"), F.sum("n").alias("n_units"))
    shown = above.join(routes.select("path"), "path").groupBy("module").agg(F.count("*").alias("n_routes"))
    inside = above.select(F.col("id").alias("src_id"), F.col("module").alias("src_module"))
    into = imports.join(above.select(F.col("id").alias("dst_id"), "module"), "dst_id")
    outside = into.join(inside, (into["src_id"] == inside["src_id"]) & (into["module"] == inside["src_module"]), "left_anti").groupBy("module").agg(F.count("*").alias("n_imported"))
    rows = modules.withColumnRenamed("path", "module")
    for df in (layers.drop("n_files"), kinds, shown, outside):
        rows = rows.join(df, "module", "left")
    rows = rows.na.fill(0, ["n_units", "n_routes", "n_imported"]).withColumnRenamed("module", "path")
    counts = {"file": F.col("n_files"), "unit": F.col("n_units"), "route": F.col("n_routes"), "use from outside": F.col("n_imported")}
    return rows.withColumn("summary", summary(counts, F.col("layer")))


def health(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is wrong with a project, a table for each sort."""
    return {
        "cycles": tables["cycles"], "orphans": tables["orphans"], "dead": tables["dead"], "unmatched": tables["unmatched"], "unused_exports": tables["unused_exports"],
        "undeclared": tables["Dependency"].where("source = 'undeclared'"), "high_risk_scripts": tables["UserScript"].where("risk_level = 'high'"), "failed_files": tables["failed"],
    }


HEALTH = ("cycles", "orphans", "dead", "unmatched", "unused_exports", "undeclared", "high_risk_scripts", "failed_files")
SIZES = {"files": "SourceFile", "modules": "Module", "domains": "Domain", "routes": "Route", "components": "Component"}


def project(name: str, kind: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """One row: framework, variants, counts of objects, health and style. kind: projects.framework(); sizes: of health() and all types of objects."""
    counts = {f"n_{k}": F.lit(sizes[k]).cast("long") for k in HEALTH} | {f"n_{k}": F.lit(sizes[v]).cast("long") for k, v in SIZES.items()}
    style = F.when(F.col("framework") == "userscript", "script-collection").when(counts["n_routes"] > 0, "layered-spa").otherwise("component-app")
    wrong = summary({k.replace("_", " ").rstrip("s"): counts[f"n_{k}"] for k in HEALTH})
    return kind.select(F.lit(f"proj:{name}").alias("id"), F.lit(name).alias("name"), "*", *(v.alias(k) for k, v in counts.items()), style.alias("style"), wrong.alias("health"))
