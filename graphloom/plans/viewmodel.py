"""What a page on a project shows, as nested rows: lists are kept to their length while Spark gathers them, parts without content are null.

`parts` gives a table for each part (or None); `view` collects these, SHOWN rows at most of each, into one dictionary that JSON can hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import aggregates as A
from graphloom.operators import links as L
from graphloom.operators.order import ordered_tree

Tables = dict[str, DataFrame]
#: Rows of a part that a page shows, names in a list, steps of the route tree.
SHOWN, LISTED, DEPTH = 200, 12, 6
#: What the roles of script functions are called.
ROLES = {"render": "Rendering", "data": "Data", "state": "State", "event": "Events", "ui": "Interface", "logic": "Logic"}
#: The parts of the view.
KEYS = (
    "viewerVersion", "generatedAt", "blueprint", "project", "domainCount", "domains", "scriptDomains", "dataMap", "scriptDataMap", "logicFlow", "scriptFlow", "scriptBlueprint", "entities", "routeMap",
    "propFlow", "quality",
)


def members_of_domains(tables: Tables) -> DataFrame:
    """domain_id, id, kind, name of the units that belong to domains."""
    kinds = ("Component", "Store", "Hook", "Service", "Route", "UserScript")
    name = lambda k: F.col("route" if k == "Route" else "name").alias("name")
    units = reduce(DataFrame.unionByName, (tables[k].select("id", F.lit(k).alias("kind"), name(k)) for k in kinds))
    belongs = tables["edges"].where("link_type = 'belongsTo' and dst_id like 'dom:%'").select(F.col("src_id").alias("id"), F.col("dst_id").alias("domain_id")).distinct()
    return belongs.join(units, "id")


def domains(tables: Tables) -> DataFrame:
    """Domains with the names of up to LISTED members of each kind."""
    lists = A.top_lists(members_of_domains(tables), ["domain_id", "kind"], [F.col("name"), F.col("id")], "name", LISTED, "names")
    held = lists.groupBy("domain_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", F.struct("n", "names"))))).alias("members"))
    rows = tables["Domain"].join(held, tables["Domain"]["id"] == held["domain_id"], "left").drop("domain_id")
    return rows.orderBy(F.desc("n_route"), F.desc("n_component"), "id")


def store_usage(tables: Tables) -> DataFrame:
    """store, domain (null: none), n: how many components of a domain use a store."""
    uses = tables["edges"].where("link_type = 'usesStore' and src_id like 'comp:%' and dst_id like 'store:%'").select(F.col("src_id").alias("id"), F.col("dst_id").alias("store")).distinct()
    of = members_of_domains(tables).where("kind = 'Component'").select("id", F.col("domain_id").alias("domain"))
    return uses.join(of, "id", "left").groupBy("store", "domain").agg(F.countDistinct("id").alias("n"))


def data_map(tables: Tables) -> DataFrame:
    """Stores with their domains, those with most users first, and how many components use them in all."""
    usage = store_usage(tables)
    lists = A.top_lists(usage.withColumn("use", F.struct("domain", "n")), ["store"], [F.desc("n"), F.asc_nulls_last("domain")], "use", LISTED, "domains")
    users = tables["edges"].where("link_type = 'usesStore' and src_id like 'comp:%'").groupBy(F.col("dst_id").alias("store")).agg(F.countDistinct("src_id").alias("n_users"))
    rows = tables["Store"].select(F.col("id").alias("store"), "name", "path", "provider").join(users, "store", "left").join(lists.select("store", "domains"), "store", "left")
    return rows.na.fill(0, ["n_users"]).orderBy(F.desc("n_users"), "store")


def layer_flow(tables: Tables) -> DataFrame:
    """from_layer, to_layer, n: imports between files of different layers."""
    layer = tables["SourceFile"].select("id", "layer")
    imports = tables["edges"].where("link_type = 'imports'").select("src_id", "dst_id").distinct()
    both = imports.join(layer.withColumnsRenamed({"id": "src_id", "layer": "from_layer"}), "src_id").join(layer.withColumnsRenamed({"id": "dst_id", "layer": "to_layer"}), "dst_id")
    return both.where("from_layer <> to_layer").groupBy("from_layer", "to_layer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_layer", "to_layer")


def _role(df: DataFrame, id_: str, name: str) -> DataFrame:
    return df.select(F.col("id").alias(id_), F.get("roles", F.lit(0)).alias(name))


def script_flow(tables: Tables) -> DataFrame:
    """from_role, to_role, n: calls between script functions by their first roles."""
    functions = tables["ScriptFunction"]
    calls = tables["edges"].where("link_type = 'calls' and src_id like 'fn:%'").select("src_id", "dst_id")
    both = calls.join(_role(functions, "src_id", "from_role"), "src_id").join(_role(functions, "dst_id", "to_role"), "dst_id")
    return both.groupBy("from_role", "to_role").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_role", "to_role")


def script_hubs(tables: Tables) -> DataFrame:
    """Script functions that most others call."""
    return tables["ScriptFunction"].where("called_by > 0").select("id", "name", "path", "roles", "called_by", "calls").orderBy(F.desc("called_by"), "id")


def script_domains(tables: Tables) -> DataFrame:
    """Script functions by their first role: how many, what they do, and the highest scored ones."""
    rows = tables["ScriptFunction"].withColumn("role", F.get("roles", F.lit(0)))
    sums = rows.groupBy("role").agg(F.sum(F.col("html") + F.col("mounts")).alias("n_injections"), F.sum("requests").alias("n_requests"), F.sum(F.col("listeners") + F.col("observers") + F.col("timers")).alias("n_listeners"), F.sum("gm").alias("n_gm"))
    lists = A.top_lists(rows.withColumn("item", F.struct("name", "path", "kind", "line", "line_count", "calls", "called_by")), ["role"], [F.desc("score"), F.col("id")], "item", LISTED, "functions")
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), F.col("role")), F.col("role"))
    return sums.join(lists, "role").select("role", label.alias("name"), "n", "n_injections", "n_requests", "n_listeners", "n_gm", "functions").orderBy(F.desc("n"), "role")


def storage_hubs(tables: Tables) -> DataFrame:
    """User scripts that keep something: the script manager's storage functions that they call, and their functions that hold state."""
    kept = tables["GmApiUsage"].where("kind = 'storage'").withColumn("api", F.struct("name", "n"))
    apis = A.top_lists(kept, ["path"], [F.desc("n"), F.col("name")], "api", LISTED, "apis").select("path", "apis")
    state = tables["ScriptFunction"].where("array_contains(roles, 'state')")
    functions = A.top_lists(state, ["path"], [F.desc("score"), F.col("id")], "name", LISTED, "functions").select("path", "functions")
    stored = tables["ScriptFunction"].groupBy("path").agg(F.sum("stored").alias("n_stored"))
    rows = tables["UserScript"].select("name", "path").join(apis, "path", "left").join(functions, "path", "left").join(stored, "path", "left").na.fill(0, ["n_stored"])
    return rows.where("apis is not null or n_stored > 0").orderBy("path")


def entities(tables: Tables) -> DataFrame:
    """Classes and interfaces with how many others they relate to, the most related ones first, and names of their methods."""
    kinds = ("extends", "implements", "overrides")
    between = tables["edges"].where(F.col("link_type").isin(*kinds[:2])).select("src_id", "dst_id")
    relations = L.degrees(between)
    lists = A.top_lists(tables["Method"].where("owner_id is not null"), ["owner_id"], [F.col("name"), F.col("id")], "name", LISTED, "methods").withColumnRenamed("n", "n_methods")
    rows = tables["Class"].select("id", "name", "path", "kind").unionByName(tables["Interface"].select("id", "name", "path", "kind")).join(relations, "id", "left").join(lists.withColumnRenamed("owner_id", "id"), "id", "left")
    rows = rows.na.fill(0, ["n_out", "n_in", "n_methods"])
    return rows.orderBy(F.desc(F.col("n_out") + F.col("n_in")), F.desc("n_methods"), "id")


def route_map(tables: Tables) -> DataFrame:
    """The tree of routes in pre-order, with the routes that end at each node."""
    shown = tables["Route"].where("kind <> 'command'").withColumn("bare", F.regexp_replace("route", "^/+|/+$", ""))
    tree = ordered_tree(shown, "bare", depth=DEPTH)
    ends = A.top_lists(shown.withColumn("item", F.struct("id", "kind", "method")), ["bare"], [F.col("id")], "item", LISTED, "routes").select(F.col("bare").alias("path"), "routes")
    return tree.join(ends, "path", "left").orderBy("place")


def prop_flow(tables: Tables) -> DataFrame:
    """Components by how many others they hand props to and take them from."""
    degrees = L.degrees(tables["PropEdge"].select("src_id", "dst_id"))
    return degrees.join(tables["Component"].select("id", "name", "path"), "id").orderBy(F.desc(F.col("n_out") + F.col("n_in")), "id")


def parts(tables: Tables) -> dict[str, DataFrame]:
    return {
        "domains": domains(tables), "scriptDomains": script_domains(tables), "dataMap": data_map(tables), "scriptDataMap": storage_hubs(tables), "logicFlow": layer_flow(tables), "scriptFlow": script_flow(tables),
        "scriptBlueprint": tables["UserScript"].orderBy("path"), "entities": entities(tables), "routeMap": route_map(tables), "propFlow": prop_flow(tables), "scriptHubs": script_hubs(tables),
    }


def view(tables: Tables, version: str = "1.0", generated_at: str | None = None) -> dict:
    """The KEYS. A part without rows is null; so are the views by script roles where the project has domains, stores or layers of its own."""
    found = {k: [r.asDict(recursive=True) for r in df.limit(SHOWN).collect()] or None for k, df in parts(tables).items()}
    hubs = found.pop("scriptHubs")
    n_domains = tables["Domain"].count()
    calls = found["scriptFlow"] or []
    crossing, total = sum(r["n"] for r in calls if r["from_role"] != r["to_role"]), sum(r["n"] for r in calls)
    if n_domains or len(found["scriptDomains"] or []) < 2:
        found["scriptDomains"] = None
    if found["dataMap"]:
        found["scriptDataMap"] = None
    # few calls between roles say nothing of a flow
    found["scriptFlow"] = {"flows": calls, "total": total, "crossing": crossing, "hubs": hubs} if not found["logicFlow"] and (crossing >= 3 or total >= 8) else None
    project = tables["Project"].first().asDict(recursive=True)
    quality = {"cycles": [r.members for r in tables["cycles"].limit(SHOWN).collect()], "n_orphans": tables["orphans"].count()}
    blueprint = {"style": project["style"], "counts": {r.type: r.n for r in tables["counts"].collect()}}
    out = {"viewerVersion": version, "generatedAt": generated_at, "blueprint": blueprint, "project": project, "domainCount": n_domains, "quality": quality, **found}
    return {k: out[k] for k in KEYS}
