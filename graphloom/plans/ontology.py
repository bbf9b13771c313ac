"""From source files to a graph of typed objects: facts, resolution joins, edges, analytics.

`build` returns tables by name. Edges are the only place where links are stored; arrays of ids are derived from them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.layers import file_layer, is_entry
from graphloom.operators import aggregates as A
from graphloom.operators import graph as G
from graphloom.operators import links as L
from graphloom.operators import resolve as R
from graphloom.operators.lineage import cut, cut_all
from graphloom.plans import calls as K
from graphloom.plans import semantics as S
from graphloom.sources import facts as X
from graphloom.sources import projects as P
from graphloom.sources import scripts as U
from graphloom.sources.scan import everything, read_manifests, read_sources, source_roots

# Endings that an import may leave out, in the order they are tried.
PROBES = ("", ".ts", ".tsx", ".js", ".jsx", ".vue", ".dart", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.vue", "/index.dart")


def rust_uses(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, spec, target: the file of the longest part of a Rust `use` path that is one, as `a/b.rs` or `a/b/mod.rs`.

    `crate` is the folder of the crate's sources, `self` and `super` go from the file's own module.
    """
    rows = imports.where(F.endswith("path", F.lit(".rs"))).select("path", "spec").distinct()
    root = F.coalesce(*(F.nullif(F.regexp_extract("path", p, 1), F.lit("")) for p in (r"^(.*?src-tauri/src/)", r"^(.*?/src/)", r"^(src/)")))
    own = F.split(F.regexp_replace(F.regexp_replace(F.substr("path", F.length("root") + 1), r"\.rs$", ""), r"(^|/)(mod|lib|main)$", ""), "/")
    parts = F.filter(F.transform(F.split(F.regexp_replace("spec", r"\s+as\s+\w+", ""), "::"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("root", root).where("root is not null").withColumns({"own": F.filter(own, lambda x: x != ""), "parts": parts}).where(F.get("parts", F.lit(0)).isin("crate", "super", "self"))
    step = lambda acc, s: F.when(s == "super", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == "self", acc).otherwise(F.concat(acc, F.array(s)))
    whole = F.when(F.get("parts", F.lit(0)) == "crate", F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))).otherwise(F.aggregate("parts", F.col("own"), step))
    tried = rows.withColumn("whole", whole).where(F.size("whole") > 0).select("path", "spec", "root", "whole", F.explode(F.sequence(F.lit(1), F.size("whole"))).alias("n"))
    tried = tried.select("path", "spec", "n", F.explode(F.transform(F.array(F.lit(".rs"), F.lit("/mod.rs")), lambda e: F.concat("root", F.array_join(F.slice("whole", F.lit(1), F.col("n")), "/"), e))).alias("target"))
    return tried.join(files.select(F.col("path").alias("target")), "target").groupBy("path", "spec").agg(F.max_by("target", F.struct("n", "target")).alias("target"))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str], go_module: str = "", dart_package: str = "") -> DataFrame:
    """path, spec, target (a file, or null), package (of what lies outside, or null), package_folder (of Go packages of the tree).

    An import becomes the paths it may mean, each with every ending; the first that is a file wins. A Go import means all files of a folder.
    """
    base = F.when(F.col("spec").rlike(r"^\.{1,2}(/|$)"), F.concat(T.dir_name(F.col("path")), F.lit("/"), "spec"))
    for prefix, to in sorted(aliases.items(), key=lambda kv: len(kv[0])):
        base = F.when(F.startswith("spec", F.lit(prefix)), F.concat(F.lit(to), F.substr("spec", F.lit(len(prefix) + 1)))).otherwise(base)
    if dart_package:
        own = f"package:{dart_package}/"
        base = F.when(F.startswith("spec", F.lit(own)), F.concat(F.lit("lib/"), F.substr("spec", F.lit(len(own) + 1)))).otherwise(base)
    dart_near = F.endswith("path", F.lit(".dart")) & ~F.contains("spec", F.lit(":"))
    base = F.coalesce(base, F.when(dart_near, F.concat(T.dir_name(F.col("path")), F.lit("/"), "spec")))
    rows = imports.select("path", "spec").distinct().withColumn("base", T.normal_path(base))
    tried = rows.where("base is not null").select("path", "spec", F.posexplode(F.array(*(F.concat("base", F.lit(p)) for p in PROBES))).alias("rank", "target"))
    # a `.js` in an import may stand for a `.ts` or `.tsx` file
    swapped = rows.where(F.endswith("base", F.lit(".js"))).select("path", "spec", F.posexplode(F.array(*(F.regexp_replace("base", r"\.js$", e) for e in (".ts", ".tsx")))).alias("rank", "target"))
    tried = tried.unionByName(swapped.withColumn("rank", F.col("rank") + len(PROBES)))
    known = files.select(F.col("path").alias("target"))
    near = tried.join(known, "target").groupBy("path", "spec").agg(F.min_by("target", "rank").alias("target"))
    go = rows.where(F.endswith("path", F.lit(".go")) & F.startswith("spec", F.lit(f"{go_module}/"))) if go_module else rows.limit(0)
    packages = go.select("path", "spec", F.substr("spec", F.lit(len(go_module) + 2)).alias("folder"))
    inside = packages.join(files.where("ext = 'go'").select(F.col("path").alias("target"), T.dir_name(F.col("path")).alias("folder")), "folder").select("path", "spec", "target")
    found = near.select("path", "spec", "target").unionByName(inside).unionByName(rust_uses(imports, files))
    outside = F.when(F.col("base").isNull() & ~F.startswith("spec", F.lit("virtual:")), T.package_name(F.col("spec")))
    package = F.when(F.endswith("path", F.lit(".go")) & F.contains("spec", F.lit(".")), F.col("spec")).when(F.endswith("path", F.lit(".rs")), F.nullif(F.nullif(F.nullif(F.regexp_extract("spec", r"^(\w+)", 1), F.lit("crate")), F.lit("self")), F.lit("super"))).when(F.startswith("spec", F.lit("package:")), F.regexp_extract("spec", "^package:([^/]+)", 1)).otherwise(outside)
    whole = rows.join(found, ["path", "spec"], "left").join(packages, ["path", "spec"], "left")
    return whole.select("path", "spec", "target", F.when(F.col("target").isNull(), package).alias("package"), F.col("base").isNotNull().alias("inside"), F.col("folder").alias("package_folder"))


def next_routes(files: DataFrame) -> DataFrame:
    """Routes by file convention: folders under app/ spell the path; page files show, route files serve."""
    rows = files.where(F.col("path").rlike(r"^(src/)?app/(.*/)?(page|route)\.[jt]sx?$"))
    segments = F.filter(F.split(T.dir_name(F.regexp_replace("path", "^(src/)?app/", "")), "/"), lambda x: x != "")
    shown = F.filter(F.transform(segments, T.next_segment), lambda x: x != "")
    hidden = F.exists(segments, lambda x: F.startswith(x, F.lit("_")))
    kind = F.when(T.base_name(F.col("path")).rlike("^route"), "api").otherwise("page")
    return rows.where(~hidden).select("path", F.concat(F.lit("/"), F.array_join(shown, "/")).alias("route"), kind.alias("kind"))


def build(
    sources: DataFrame, declared: DataFrame | None = None, aliases: dict[str, str] | None = None, go_module: str = "", dart_package: str = "",
    project: str = "project", paths: DataFrame | None = None, entries: DataFrame | None = None, facts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Object tables, `edges` (in both directions), `cycles`, `unmatched`, `orphans`, `dead`, `unused_exports`, `failed` and `counts`.

    sources: read_sources(); declared: read_manifests(); paths: all paths of the tree where they tell a framework; entries:
    html_entries(); facts: facts.update() of the sources, where they are stored. `scan_project` finds all of these.
    """
    spark = sources.sparkSession
    # one pass over all texts; everything else reads narrow rows of this table by their kind
    facts = cut(X.collect(sources).sortWithinPartitions("kind")) if facts is None else facts
    raw = X.files(facts)
    code = cut_all(
        functions=lambda: X.functions(facts), kinds=lambda: X.types(facts), imports=lambda: X.imports(facts), names=lambda: X.name_counts(facts), members=lambda: X.members(facts), vue_members=lambda: X.vue_members(facts), tags=lambda: X.tags(facts),
        stores=lambda: X.stores(facts), services=lambda: X.services(facts), calls=lambda: X.http_calls(facts), navigations=lambda: X.navigations(facts), props=lambda: X.prop_sites(facts), bodies=lambda: K.bodies(facts),
        written=lambda: X.router_routes(facts), served=lambda: X.go_routes(facts), chains=lambda: command_chains(*X.commands(facts)), titles=lambda: X.titles(facts),
        meta=lambda: X.script_meta(facts), api=lambda: X.script_api_calls(facts), spans=lambda: U.spans(facts), lines=lambda: U.lines(facts), globbed=lambda: X.globbed(facts), failed=raw.where("error is not null").select("path", "error"),
    )
    functions, kinds, imports, names, meta, api, spans = (code[k] for k in ("functions", "kinds", "imports", "names", "meta", "api", "spans"))

    # units: components with the places of their bodies, hooks, stores, services
    vue = raw.where("ext = 'vue'").select("path", T.component_name(F.col("path")).alias("name"), F.lit(0).alias("low"), F.lit(None).cast("int").alias("high"))
    widgets = kinds.where((F.col("ext") == "dart") & F.exists("extends", lambda x: x.rlike("Widget$|^State$"))).select("path", "name", "low", "high")
    shown = functions.where(F.col("ext").isin("tsx", "jsx") & F.col("exported") & F.col("name").rlike("^[A-Z]")).select("path", "name", "low", "high")
    units = L.unique_ids(shown.unionByName(vue).unionByName(widgets).withColumn("base", F.concat(F.lit("comp:"), "name")), "base", "path", "low")
    named = lambda df, prefix, *order: L.unique_ids(df.withColumn("base", F.concat(F.lit(prefix), "name")), "base", "path", *order)
    entities = L.unique_ids(kinds.withColumn("base", F.concat(F.when(F.col("entity") == "interface", "iface:").otherwise("class:"), "path", F.lit("#"), "name")), "base", "low").drop("base", "ord")
    first_wave = cut_all(
        units=units.withColumn("kind", T.kind_of(F.col("name"))).drop("base").withColumnRenamed("low", "ord"),
        hooks=lambda: named(functions.where(F.col("exported") & F.col("name").rlike("^use[A-Z]")), "hook:", "low").select("id", "name", "path"),
        stores=lambda: named(code["stores"], "store:", "ord").select("id", "name", "path", "provider"), services=lambda: named(code["services"], "svc:", "ord").select("id", "name", "path", "pattern"), entities=entities,
        resolved=lambda: resolve_imports(imports, raw, aliases or {"@/": "src/"}, go_module, dart_package), events=lambda: U.events(code["lines"], spans), sites=lambda: K.sites(facts, code["bodies"]),
    )
    entities, resolved, events, hooks, stores, services = (first_wave[k] for k in ("entities", "resolved", "events", "hooks", "stores", "services"))
    places, components = first_wave["units"], first_wave["units"].drop("high")

    # files, modules, layers; named imports followed to where names are declared; scripts
    per_file = lambda df, name: df.groupBy("path").agg(F.count("*").alias(name))
    files = raw.drop("error")
    for df, name in ((components, "n_components"), (stores, "n_stores"), (hooks, "n_hooks")):
        files = files.join(per_file(df, name), "path", "left")
    files = files.na.fill(0).withColumns({"is_test": T.is_test(F.col("path")), "is_entry": is_entry(F.col("path"))})
    if entries is not None:
        files = files.join(entries.withColumn("_e", F.lit(True)), "path", "left").withColumn("is_entry", F.col("is_entry") | F.coalesce("_e", F.lit(False))).drop("_e")
    layer = file_layer(F.col("path"), script=F.col("is_script"), test=F.col("is_test"), entry=F.col("is_entry"), components=F.col("n_components"), stores=F.col("n_stores"), hooks=F.col("n_hooks"))
    files = files.select(F.concat(F.lit("file:"), "path").alias("id"), T.base_name(F.col("path")).alias("name"), "*", layer.alias("layer"), T.dir_name(F.col("path")).alias("folder"))
    exported = reduce(DataFrame.unionByName, (df.select("path", "name") for df in (functions.where("exported"), entities.where("exported"), stores, components))).distinct()
    scripts = cut_all(files=files, bound=lambda: follow_bindings(X.bindings(imports), resolved, exported), injected=lambda: U.injections(events, U.anchors(code["lines"])), net=lambda: U.endpoints(events, meta), script_edges=lambda: U.call_edges(events, spans))
    files, bound, injected, net, script_edges = (scripts[k] for k in ("files", "bound", "injected", "net", "script_edges"))
    above = files.select("path", "layer", F.explode(G.ancestors(F.col("folder"))).alias("module"))
    modules = A.dominant(above, "module", "layer").select(F.concat(F.lit("mod:"), "module").alias("id"), F.col("module").alias("path"), F.col("dominant").alias("layer"), F.col("total").alias("n_files"))
    modules = modules.withColumn("parent_id", F.when(F.instr("path", "/") > 0, F.concat(F.lit("mod:"), T.dir_name(F.col("path")))))

    # imports and packages
    file_id = lambda c: F.concat(F.lit("file:"), c)
    imported = L.edges(resolved.where("target is not null and target <> path"), "imports", file_id("path"), file_id("target"), F.lit(0))
    # what edges are made of; they are put together at the end, beside other tables
    edges: list[tuple] = []
    used = resolved.where("package is not null").groupBy(F.col("package").alias("name")).agg(F.countDistinct("path").alias("import_count"))
    declared = declared if declared is not None else spark.createDataFrame([], "name string, version string, scope string, source string")
    packages = used.join(declared, "name", "full_outer").select(
        F.concat(F.lit("dep:"), "name").alias("id"), "name", "version", "scope", F.coalesce("source", F.lit("undeclared")).alias("source"), F.coalesce("import_count", F.lit(0)).alias("import_count"), F.col("import_count").isNotNull().alias("used")
    )
    edges.append((resolved.where("package is not null"), "imports", file_id("path"), F.concat(F.lit("dep:"), "package"), F.lit(1)))

    through = resolved.where("target is not null").select("path", F.col("target").alias("there"), F.lit(1).alias("imported")).distinct()

    # types and what they inherit: the file's own name first, then the one that a named import leads to, one of an imported file, one that only one file has
    def inherited() -> DataFrame:
        alone = F.count("*").over(Window.partitionBy("name")) == 1
        targets = entities.select(F.col("id").alias("dst_id"), F.col("name").alias("told"), F.col("path").alias("there"), F.col("entity").alias("dst_entity"), alone.alias("alone"))
        listed = entities.select("id", "path", F.explode(F.concat(F.transform("extends", lambda x: F.struct(F.lit("extends").alias("link"), x.alias("wanted"))), F.transform("implements", lambda x: F.struct(F.lit("implements").alias("link"), x.alias("wanted"))))).alias("x")).select("id", "path", "x.*")
        by_name = listed.withColumn("told", F.col("wanted")).join(targets, "told").join(through, ["path", "there"], "left")
        rank = F.when(F.col("path") == F.col("there"), 0).when(F.col("imported") == 1, 2).when(F.col("alone"), 3)
        by_name = by_name.withColumn("rank", rank).where("rank is not null").select("id", "link", "wanted", "dst_id", "dst_entity", "rank")
        by_import = listed.join(bound.select("path", F.col("local").alias("wanted"), "there", F.col("name").alias("told")), ["path", "wanted"]).join(targets, ["there", "told"]).select("id", "link", "wanted", "dst_id", "dst_entity", F.lit(1).alias("rank"))
        inherits = by_name.unionByName(by_import).where("id <> dst_id").groupBy("id", "link", "wanted").agg(F.min_by(F.struct("dst_id", "dst_entity"), F.struct("rank", "dst_id")).alias("x")).select("id", "link", "x.dst_id")
        return inherits

    # a single-file component is a class too, with methods
    shaped = F.regexp_replace("id", "^comp:", "vclass:").alias("id")
    none = F.array().cast("array<string>")
    vue_classes = components.where(F.endswith("path", F.lit(".vue"))).select(shaped, "path", F.lit("vue").alias("ext"), "name", F.lit("class").alias("entity"), F.lit("component").alias("kind"), F.lit(True).alias("exported"), none.alias("extends"), none.alias("implements"))

    # methods
    def owned_methods() -> DataFrame:
        owned = code["members"].unionByName(functions.where("owner is not null").select("path", "owner", F.col("low").alias("ord"), "name"))
        method_id = F.concat(F.lit("method:"), "path", F.lit("#"), "owner", F.lit("#"), "name")
        methods = L.unique_ids(owned.withColumn("base", method_id), "base", "ord").select("id", "name", "path", F.col("owner"), F.lit("class").alias("owner_kind"), F.col("name").rlike("^[A-Z]").alias("exported"))
        loose = functions.where("owner is null").select(F.concat(F.lit("method:"), "path", F.lit("#"), "name").alias("id"), "name", "path", F.lit(None).cast("string").alias("owner"), F.lit("module").alias("owner_kind"), "exported")
        methods = methods.unionByName(loose).dropDuplicates(["id"])
        # a Go method may stand in another file of its type's folder
        folder = T.dir_name(F.col("path")).alias("folder")
        own = entities.select(F.col("id").alias("owner_id"), F.col("path").alias("there"), F.col("name").alias("owner"), folder, F.when(F.col("entity") == "interface", "interface").otherwise("class").alias("owner_is"))
        near = methods.where("owner is not null").select("id", "path", "owner", folder).join(own, ["folder", "owner"]).where((F.col("path") == F.col("there")) | F.endswith("path", F.lit(".go")))
        near = near.groupBy("id").agg(F.min_by(F.struct("owner_id", "owner_is"), F.struct(F.col("path") != F.col("there"), "owner_id")).alias("x")).select("id", "x.owner_id", "x.owner_is")
        methods = methods.join(near, "id", "left").withColumn("owner_kind", F.coalesce("owner_is", "owner_kind")).drop("owner_is")
        of_class = code["vue_members"].withColumnRenamed("name", "member").join(vue_classes.select(F.col("id").alias("owner_id"), "path", "name"), "path")
        bare = F.regexp_replace("owner_id", "^vclass:", "")
        vue_methods = of_class.select(F.concat(F.lit("vmethod:"), bare, F.lit("."), "member").alias("id"), F.col("member").alias("name"), "path", F.col("name").alias("owner"), F.lit("class").alias("owner_kind"), F.lit(True).alias("exported"), "owner_id")
        methods = methods.where(~F.endswith("path", F.lit(".vue"))).unionByName(vue_methods)
        return methods

    # routes as they are written, with the words of their pages
    no_text, no_list = F.lit(None).cast("string"), none

    def spelled_routes() -> DataFrame:
        route = lambda df, base, route, kind, method, handler, ord_, parents: df.select(F.concat(*base).alias("base"), route.alias("route"), kind.alias("kind"), "path", method.alias("method"), handler.alias("handler"), ord_.alias("ord"), parents.alias("parents"))
        word = F.lit("route:")
        served, written = code["served"], code["written"]
        vue_pages = vue_file_routes(raw).join(written.select("path").distinct(), "path", "left_anti")
        routes = reduce(DataFrame.unionByName, (
            route(next_routes(raw), (word, "route"), F.col("route"), F.col("kind"), no_text, no_text, F.lit(0), no_list),
            route(served, (word, "method", F.lit(" "), "route"), F.col("route"), F.lit("http"), F.col("method"), F.col("handler"), F.col("ord"), F.col("middlewares")),
            route(written, (word, "route"), F.col("route"), F.col("kind"), no_text, F.col("component"), F.col("ord"), F.col("parents")),
            route(code["chains"], (F.lit("route:go-cli:"), "chain"), F.col("chain"), F.lit("command"), no_text, F.col("command"), F.lit(0), no_list),
            route(vue_pages, (word, "route"), F.col("route"), F.lit("vue-file"), no_text, no_text, F.lit(0), no_list),
        ))
        routes = L.unique_ids(routes, "base", "path", "ord").drop("base").withColumn("ord", F.struct("path", "ord", "route"))
        return routes

    second = cut_all(
        modules=modules, packages=packages, inherits=inherited, methods=owned_methods, routes=spelled_routes, between=imported.select("src_id", "dst_id").distinct(),
        functions_of=lambda: U.script_functions(spans, events, script_edges, names), risks=lambda: U.risks(events, api, injected, net, meta),
        owners=lambda: owners(code["tags"].select("path", "pos").unionByName(code["props"].select("path", "pos")).distinct(), places),
    )
    modules, packages, inherits, methods, routes, between, functions_of, risks = (second[k] for k in ("modules", "packages", "inherits", "methods", "routes", "between", "functions_of", "risks"))
    edges.append((inherits.where("link = 'extends'"), "extends", "id", "dst_id", F.lit(0)))
    edges.append((inherits.where("link = 'implements'"), "implements", "id", "dst_id", F.lit(0)))
    edges.append((vue_classes, "contains", file_id("path"), "id", F.lit(6)))
    edges.append((methods.where("owner_id is not null"), "contains", "owner_id", "id", F.lit(0)))
    member_of = methods.where("owner_id is not null").select("id", "name", "owner_id")
    parents = member_of.select(F.col("id").alias("dst_id"), "name", F.col("owner_id").alias("parent"))
    overriding = member_of.join(inherits.select(F.col("id").alias("owner_id"), F.col("dst_id").alias("parent")), "owner_id").join(parents, ["parent", "name"])
    edges.append((overriding, "overrides", "id", "dst_id", F.lit(0)))
    last = F.regexp_extract("spec", r"([^/]+?)(?:/v[0-9]+)?$", 1).alias("name")
    spoken = resolved.select("path", "target", "package_folder", last)

    # what renders what, by the component around a tag; a name means what the file declares or a named import leads to, else a component of an imported file
    owner = second["owners"]
    told = components.select(F.col("id").alias("dst_id"), "name", F.col("path").alias("there"))
    reach = through.unionByName(raw.select("path", F.col("path").alias("there"), F.lit(1).alias("imported")))
    meant = component_names(told, reach, bound)
    tagged = code["tags"].withColumn("local", T.pascal_case(F.col("tag"))).join(owner, ["path", "pos"])
    rendered = tagged.join(meant, ["path", "local"]).where("src_id <> dst_id").select("src_id", "dst_id").distinct()
    def placed_routes() -> DataFrame:
        described = code["titles"].groupBy("path").agg(F.min_by("title", "ord").alias("description"))
        served_by = K.handlers(routes.where("kind = 'http'").select("id", "path", "handler"), methods, spoken, components)
        around = raw.where(F.col("path").rlike(r"(^|/)app/(.*/)?layout\.[jt]sx?$")).select(T.dir_name(F.col("path")).alias("folder"), F.col("path").alias("layout"))
        rows = routes.withColumn("domain", T.route_domain(F.col("route"))).join(described, "path", "left").join(served_by, "id", "left")
        rows = R.layout_chain(rows, around)
        # nested routes have the components around them as layouts, served ones their middlewares
        return rows.withColumn("layouts", F.when(F.col("kind").isin("jsx", "record"), F.col("parents")).otherwise(F.col("chain"))).withColumn("middlewares", F.when(F.col("kind") == "http", F.col("parents")).otherwise(none)).drop("parents", "chain")

    sites = code["props"].withColumn("local", F.col("tag")).join(owner, ["path", "pos"])
    given = sites.join(meant, ["path", "local"]).where("src_id <> dst_id")
    third = cut_all(called=lambda: K.resolve(first_wave["sites"], methods, spoken, components), rendered=rendered, routes=placed_routes, props=lambda: A.priority_merge(given, ["src_id", "dst_id", "name"], "source", X.PROP_RANKS, "ord"))
    called, rendered, routes, props = (third[k] for k in ("called", "rendered", "routes", "props"))
    edges.append((called, "calls", "src_id", "dst_id", F.lit(0)))
    edges.append((rendered, "renders", "src_id", "dst_id", F.lit(0)))
    edges.append((props, "passesProps", "src_id", "dst_id", F.lit(0)))
    calls = code["calls"].select("path", "method", F.regexp_replace(F.col("url"), r"^https?://[^/]+", "").alias("url"), "ord").where("url <> ''")
    served_routes, seen = routes.where("kind in ('api', 'http')"), routes.where("kind not in ('api', 'http', 'command')")
    wanted = routes.select("id", "path", F.col("handler").alias("local")).where("local is not null").join(meant, ["path", "local"]).select("id", "path", "dst_id").distinct()
    shows = seen.select(F.col("id").alias("src_id"), "path").unionByName(wanted.join(told.select("dst_id", F.col("there").alias("shown")), "dst_id").select(F.col("id").alias("src_id"), F.col("shown").alias("path"))).distinct()
    edges.append((routes, "registers", "id", file_id("path"), F.lit(1)))
    edges.append((wanted, "registers", "id", "dst_id", F.lit(0)))

    # what files use of stores and hooks they import, and with them the file's components
    reads = resolved.where("target is not null").select("path", F.col("target").alias("there")).distinct()
    for link, df in (("usesStore", stores), ("usesHook", hooks)):
        held = reads.join(df.select(F.col("id").alias("dst_id"), F.col("path").alias("there")), "there")
        edges.append((held, link, file_id("path"), "dst_id", F.lit(0)))
        edges.append((held.join(components.select("id", "path"), "path"), link, "id", "dst_id", F.lit(0)))

    # user scripts: what they call, inject and reach, and their own functions
    us = F.concat(F.lit("us:"), "path")
    titled = meta.groupBy("path").agg(F.min_by("value", F.when(F.col("key") == "name", F.col("ord"))).alias("title"), F.collect_list(F.when(F.col("key").isin("match", "include"), F.col("value"))).alias("matches"))
    user_scripts = files.where("is_script").join(titled, "path", "left").join(U.risk_levels(risks), "path", "left").join(U.host_frameworks(events), "path", "left").select(
        us.alias("id"), F.coalesce("title", "name").alias("name"), "path", "matches", "line_count", F.coalesce("risk_level", F.lit("none")).alias("risk_level"), F.coalesce("n_risks", F.lit(0)).alias("n_risks"), F.coalesce("host", F.lit("unknown")).alias("host")
    )
    gm = api.select(F.concat(F.lit("gm:"), "path", F.lit("#"), "name").alias("id"), "*")
    domain_names = S.domain_names(routes.where("kind <> 'command'").select("domain", "ord"), modules)
    fourth = cut_all(
        user_scripts=user_scripts, domain_names=domain_names, shows=shows, matched=lambda: R.match_routes(calls, served_routes.select("ord", F.col("route").alias("pattern")), "url", "pattern"),
        led=lambda: R.match_routes(code["navigations"], seen.select("ord", F.col("route").alias("pattern")), "target", "pattern").where("pattern is not null"),
    )
    user_scripts, domain_names, shows, matched, led = (fourth[k] for k in ("user_scripts", "domain_names", "shows", "matched", "led"))
    asked = matched.where("pattern is not null").join(served_routes.select(F.col("route").alias("pattern"), F.col("id").alias("route_id")), "pattern").select("path", "method", "url", "route_id").distinct()
    led = led.join(seen.select(F.col("route").alias("pattern"), F.col("id").alias("dst_id")), "pattern").join(shows, "path").where("src_id <> dst_id")
    edges.append((led, "navigatesTo", "src_id", "dst_id", F.lit(0)))
    for n, (link, df) in enumerate((("", functions_of), ("usesGmApi", gm), ("injectsInto", injected), ("requestsTo", net))):
        if link:
            edges.append((df, link, us, "id", F.lit(0)))
        edges.append((df, "contains", us, "id", F.lit(n)))
    fn_id = lambda c: F.concat(F.lit("fn:"), "path", F.lit("#"), c)
    edges.append((script_edges.where("src is not null"), "calls", fn_id("src"), fn_id("dst"), F.lit(0)))

    # domains
    kinds_of = {"component": components, "store": stores, "hook": hooks, "service": services, "script": user_scripts}
    units = reduce(DataFrame.unionByName, (df.select("id", "path", F.lit(k).alias("kind")) for k, df in kinds_of.items()))
    members = cut(S.memberships(domain_names, routes.where("kind <> 'command'").select("id", "domain"), modules.select("id", "path"), files.select("id", "path"), shows.select(F.col("src_id").alias("id"), "path"), units))
    edges.append((members.where("kind <> 'file'"), "belongsTo", "id", "domain_id", F.lit(0)))
    edges.append((members.where("kind = 'script'").join(functions_of.select(us.alias("id"), F.col("id").alias("fn")), "id"), "belongsTo", "fn", "domain_id", F.lit(0)))

    # containment, in the order: domains and modules, files, units
    proj = F.lit(f"proj:{project}")
    edges.append((domain_names.select(F.concat(F.lit("dom:"), "name").alias("id")), "contains", proj, "id", F.lit(0)))
    edges.append((modules.where("parent_id is null"), "contains", proj, "id", F.lit(1)))
    edges.append((modules.where("parent_id is not null"), "contains", "parent_id", "id", F.lit(0)))
    edges.append((files.where("folder <> ''"), "contains", F.concat(F.lit("mod:"), "folder"), "id", F.lit(1)))
    for n, df in enumerate((components, hooks, stores, services, entities, methods, user_scripts), 2):
        edges.append((df, "contains", file_id("path"), "id", F.lit(n)))
    inside = between.where(F.startswith("dst_id", F.lit("file:")))
    whole = whole_imports(imports, resolved, bound)
    dead_there = lambda: dead_types(entities, functions, methods, names, whole, files).unionByName(K.dead_go(entities.select("id", "name", "path", "exported").unionByName(methods.where("owner_kind <> 'interface'").select("id", "name", "path", "exported")), names))
    given_or_taken = L.degrees(props).select("id", F.col("n_out").alias("n_props_out"), F.col("n_in").alias("n_props_in"))
    fifth = cut_all(
        edges=lambda: L.with_inverse(reduce(DataFrame.unionByName, (L.edges(*e) for e in edges), imported).distinct()), domains=lambda: S.domains(domain_names, members, files, routes), profiles=lambda: S.module_profiles(modules, files, units, routes, inside),
        components=components.join(given_or_taken, "id", "left").na.fill(0, ["n_props_out", "n_props_in"]), cycles=lambda: G.strong_components(inside), orphans=lambda: orphans(files, inside, routes, code["globbed"]),
        dead=lambda: dead_there().dropDuplicates(["id"]).unionByName(functions_of.where("dead").select("id", F.lit("nothing calls it").alias("reason"))), unused=lambda: unused_exports(functions, entities, bound, whole, files, inside, names), asked=asked,
    )
    out = {
        "SourceFile": files, "Module": fifth["profiles"], "Domain": fifth["domains"], "Dependency": packages, "Component": fifth["components"], "Hook": hooks, "Store": stores, "Service": services,
        "Interface": entities.where("entity = 'interface'"), "Class": entities.where("entity = 'class'").drop("low", "high", "depth", "inside").unionByName(vue_classes), "Method": methods,
        "Route": routes, "UserScript": user_scripts, "ScriptFunction": functions_of, "GmApiUsage": gm, "InjectionPoint": injected, "NetworkEndpoint": net,
        "PropEdge": props.groupBy("src_id", "dst_id").agg(F.sort_array(F.collect_list(F.struct("name", "source"))).alias("props")).withColumn("id", F.concat(F.lit("prop:"), "src_id", F.lit("→"), "dst_id")), "edges": fifth["edges"],
        "unmatched": matched.where("pattern is null").select("path", "method", "url"), "frontend_calls": fifth["asked"], "risks": risks, "failed": code["failed"], "top_calls": U.top_level_calls(script_edges),
        "orphans": fifth["orphans"], "dead": fifth["dead"], "unused_exports": fifth["unused"],
    }
    out["cycles"] = fifth["cycles"].groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"))
    kind = P.framework(paths if paths is not None else raw.select("path"), declared)
    sized = {k: v for k, v in out.items() if k[0].isupper()}
    # all counts are one table, a row for each; the project's row is made of them
    found = cut(reduce(DataFrame.unionAll, (v.agg(F.count("*").alias("n")).select(F.lit(k).alias("type"), "n") for k, v in (sized | S.health(out)).items())))
    sizes = {r.type: r.n for r in found.collect()}
    out["Project"] = cut(S.project(project, kind, sizes))
    out["counts"] = found.where(F.col("type").isin(*sized)).unionAll(spark.createDataFrame([("Project", 1)], "type string, n bigint"))
    return out


def owners(points: DataFrame, places: DataFrame) -> DataFrame:
    """path, pos, src_id: the component around each place, or the file's first one. places: id, path, ord (where it begins), high (null: the whole file)."""
    spans = places.select("path", F.col("id").alias("src_id"), F.col("ord").alias("low"), F.coalesce("high", F.lit((1 << 31) - 1)).alias("high"))
    # a whole file needs no span: it is the first component's
    bodies = spans.where(F.col("high") < (1 << 31) - 1)
    first = places.groupBy("path").agg(F.min_by("id", "ord").alias("first"))
    return R.innermost(points, bodies, "path", name="src_id").join(first, "path").select("path", "pos", F.coalesce("src_id", "first").alias("src_id"))


def component_names(components: DataFrame, reach: DataFrame, bound: DataFrame) -> DataFrame:
    """path, local, dst_id: what a name in a file means: a component that a named import leads to, else those of that name in the file and its imports."""
    named = bound.where("imported <> '*'").select("path", "local", "there", F.col("name")).join(components, ["there", "name"]).select("path", "local", "dst_id")
    default = bound.where("imported = 'default'").select("path", "local", "there").join(components.groupBy("there").agg(F.count("*").alias("n"), F.min("dst_id").alias("dst_id")).where("n = 1"), "there").select("path", "local", "dst_id")
    led = named.unionByName(default).distinct()
    near = reach.join(components, "there").select("path", F.col("name").alias("local"), "dst_id").distinct()
    return led.unionByName(near.join(led.select("path", "local").distinct(), ["path", "local"], "left_anti"))


def follow_bindings(bindings: DataFrame, resolved: DataFrame, declared: DataFrame, most: int = 32) -> DataFrame:
    """path, local, imported, there, name: the file and name that each bound name stands for, through all files that export it again.

    bindings: facts.bindings(); resolved: resolve_imports(); declared: path, name of what files export of their own. Each round
    follows one re-export; what was seen isn't followed again, so cycles of re-exports end.
    """
    to = resolved.where("target is not null").select("path", "spec", F.col("target").alias("there")).distinct()
    rows = cut(bindings.join(to, ["path", "spec"]).select("path", "export", "local", "imported", "there"))
    again = rows.where("export").select(F.col("path").alias("there"), F.col("local").alias("name"), F.col("there").alias("next"), F.col("imported").alias("next_name"))
    own = declared.select(F.col("path").alias("there"), "name", F.lit(True).alias("own"))
    found = cut(rows.where("not export").select("path", "local", "imported", "there", F.col("imported").alias("name")))
    seen, frontier = found, found
    for _ in range(most):
        open_ = frontier.join(own, ["there", "name"], "left").where("own is null").drop("own")
        through = open_.join(again.where("name <> '*'"), ["there", "name"]).select("path", "local", "imported", F.col("next").alias("there"), F.col("next_name").alias("name"))
        stars = open_.where("name not in ('*', 'default')").join(again.where("name = '*'").select("there", "next"), "there").select("path", "local", "imported", F.col("next").alias("there"), "name")
        frontier = cut(through.unionByName(stars).distinct().join(seen, seen.columns, "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    # where a name is declared, or, if it is nowhere, the file that the import itself names
    ends = seen.join(own, ["there", "name"], "left")
    rank = F.struct(F.col("own").isNull(), (F.col("name") != F.col("imported")), "there", "name")
    return ends.groupBy("path", "local", "imported").agg(F.min_by(F.struct("there", "name"), rank).alias("x")).select("path", "local", "imported", "x.there", "x.name")


def whole_imports(imports: DataFrame, resolved: DataFrame, bound: DataFrame) -> DataFrame:
    """path of files that others take whole: as an object, by `export *`, or dynamically without naming what they take."""
    loose = imports.where(F.col("names").rlike(r"\*") | ((F.col("kind") == "dynamic") & ~F.coalesce(F.contains("names", F.lit("{")), F.lit(False)))).select("path", "spec")
    direct = loose.join(resolved.where("target is not null").select("path", "spec", "target"), ["path", "spec"]).select(F.col("target").alias("path"))
    return direct.unionByName(bound.where("name = '*'").select(F.col("there").alias("path"))).distinct()


def scan_project(spark: SparkSession, root: str, roots: tuple[str, ...] | None = (".",), name: str | None = None, stored: str | None = None) -> dict[str, DataFrame]:
    """build() over a tree with all that it says about itself: manifests, path aliases, the main Go module, the Dart package, pages' entry scripts.

    roots: folders to read; None for those that source_roots() finds. stored: a folder in which facts stay, so that the next time
    only changed files are read for facts.
    """
    found = {r.prefix: r.target for r in P.aliases(spark, root).collect()}  # a line for each alias that configurations name
    go = P.go_modules(spark, root).where("main").select("module").first()
    paths = everything(spark, root).select("path")
    dart = everything(spark, root, "pubspec.yaml").where("path = 'pubspec.yaml'").select(F.regexp_extract("content", r"(?m)^name:\s*(\w+)", 1).alias("name")).first()
    own = name or root.rstrip("/").rsplit("/", 1)[-1]
    sources = read_sources(spark, root, source_roots(paths) if roots is None else roots)
    facts = X.update(sources, stored) if stored else None
    return build(sources, read_manifests(spark, root), found or None, go.module if go else "", dart.name if dart else "", own, paths, P.html_entries(spark, root), facts)


def vue_file_routes(files: DataFrame) -> DataFrame:
    """path, route: single-file pages under src/views and src/pages; `index` stands for its folder, `[x]` for a parameter."""
    rows = files.where(F.col("path").rlike(r"^src/(views|pages)/.*\.vue$"))
    segments = F.split(F.regexp_replace("path", r"^src/(views|pages)/|(/?index)?\.vue$", ""), "/")
    shown = F.filter(F.transform(segments, T.next_segment), lambda x: x != "")
    return rows.select("path", F.concat(F.lit("/"), F.array_join(shown, "/")).alias("route"))


def command_chains(made: DataFrame, children: DataFrame, depth: int = 8) -> DataFrame:
    """path, command, chain: the words that lead to each command from a root, which is one that no other adds."""
    names = made.select("path", "command", "use")
    tops = names.join(children.select("command").distinct(), "command", "left_anti").select("path", "command", F.col("use").alias("chain"))
    level, out = cut(tops), tops
    # a command may be added in another file than the one that makes it
    steps = children.select("parent", "command").distinct().join(names.withColumnRenamed("path", "at"), "command")
    for _ in range(depth - 1):
        level = level.select(F.col("command").alias("parent"), "chain").join(steps, "parent").select(F.col("at").alias("path"), "command", F.concat_ws(" ", "chain", "use").alias("chain"))
        level = cut(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def orphans(files: DataFrame, imports: DataFrame, routes: DataFrame, globbed: DataFrame) -> DataFrame:
    """Files under src/ or lib/ that no file imports, no route shows and no rule exempts: tests, entries, scripts, declarations, and what a glob import takes in."""
    rows = files.where(F.col("path").rlike("^(src|lib)/") & ~F.col("is_test") & ~F.col("is_entry") & ~F.col("is_script") & ~F.endswith("path", F.lit(".d.ts")))
    left = rows.join(imports.select(F.col("dst_id").alias("id")), "id", "left_anti").join(routes.select("path"), "path", "left_anti")
    return left.join(globbed, "path", "left_anti").select("id", "path")


def unused_exports(functions: DataFrame, entities: DataFrame, bound: DataFrame, whole: DataFrame, files: DataFrame, between: DataFrame, names: DataFrame) -> DataFrame:
    """id (of the file), path, name: exported names of files that others import, though no import leads to the name and the file itself names it outside its own span nowhere.

    Files that others take whole are left out, as are entries, tests and Go files.
    """
    exported = functions.where("exported and not is_default and owner is null").select("path", "name", "inside").unionByName(entities.where("exported").select("path", "name", "inside"))
    exported = exported.groupBy("path", "name").agg(F.sum("inside").alias("inside"))
    used = files.where("not is_entry and not is_test and ext <> 'go'").join(between.select(F.col("dst_id").alias("id")).distinct(), "id", "left_semi")
    taken = bound.select(F.col("there").alias("path"), "name").distinct()
    rows = exported.join(used.select("id", "path"), "path").join(whole, "path", "left_anti").join(taken, ["path", "name"], "left_anti")
    return rows.join(names, ["path", "name"], "left").where("coalesce(n, 0) - inside <= 0").select("id", "path", "name")


def dead_types(entities: DataFrame, functions: DataFrame, methods: DataFrame, names: DataFrame, whole: DataFrame, files: DataFrame) -> DataFrame:
    """id, reason of types and module functions that nothing refers to outside their own span: in their file, or, if they may be seen outside, in any other.

    References in the own file are counts of the name less those inside the span, so a function that calls only itself is dead.
    Entries, tests and files that others take whole are left out.
    """
    loose = functions.where("owner is null").groupBy("path", "name").agg(F.sum("inside").alias("inside"), F.max("exported").alias("exported"))
    plain = methods.where("owner is null and path not like '%.vue'").select("id", "name", "path").join(loose, ["path", "name"])
    units = entities.select("id", "name", "path", "exported", "inside").unionByName(plain.select("id", "name", "path", "exported", "inside")).where(~F.endswith("path", F.lit(".go")))
    totals = names.groupBy("name").agg(F.sum("n").alias("total"))
    exempt = files.where("is_entry or is_test").select("path").unionByName(whole).distinct()
    rows = units.join(exempt, "path", "left_anti").join(names, ["path", "name"]).join(totals, "name")
    here, outside = F.col("n") - F.col("inside") <= 0, F.col("total") - F.col("n") <= 0
    # Dart and Rust have no export lists: what isn't private may be named anywhere
    seen_outside = F.col("exported") | F.col("path").rlike(r"\.(dart|rs)$")
    return rows.where(here & (outside | ~seen_outside)).select("id", F.when(seen_outside, "no file names it").otherwise("its file names it once").alias("reason"))


def impact(edges: DataFrame, id_: str) -> DataFrame:
    """id, level of all that imports an object, directly or through others."""
    back = edges.where("link_type = 'imports'").select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    return G.levels(back, edges.sparkSession.createDataFrame([(id_,)], "id string")).where(F.col("level") > 0)
