"""User scripts line by line: spans of functions, events within them, what they inject, reach and risk.

Events and spans meet in interval joins on lines; all that follows is grouping and joining.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import resolve as R
from graphloom.operators.aggregates import top_per_group
from graphloom.sources import facts as X

#: Kind of event: a pattern whose first group is what it acts on.
EVENTS = {
    "inner-html": r"([\w$][\w$.]*)\.(?:inner|outer)HTML\s*\+?=(?!=)",
    "insert-adjacent": r"([\w$][\w$.]*)\.insertAdjacentHTML\(",
    "document-write": r"(document)\.write(?:ln)?\(",
    "mount": r"([\w$][\w$.]*)\.(?:appendChild|append|prepend|insertBefore|before|after|replaceWith)\(",
    "style-element": r"(createElement)\(\s*['\"]style['\"]",
    "shadow-dom": r"(attachShadow)\(",
    "gm-xhr": r"(GM_xmlhttpRequest|GM\.xmlHttpRequest)\s*\(",
    "fetch": r"(?:^|[^\w.])(fetch)\s*\(",
    "xhr": r"(\.open)\(\s*['\"]",
    "websocket": r"new\s+(WebSocket)\(",
    "beacon": r"(sendBeacon)\(",
    "fetch-hijack": r"((?:window|unsafeWindow)\.fetch)\s*=[^=]",
    "xhr-hijack": r"(XMLHttpRequest\.prototype\.\w+)\s*=[^=]",
    "history-hijack": r"(history\.(?:push|replace)State)\s*=[^=]",
    "socket-hijack": r"((?:window|unsafeWindow)\.WebSocket)\s*=[^=]",
    "listener-hijack": r"(\w*\.prototype\.addEventListener)\s*=[^=]",
    "create": r"createElement\(\s*['\"](\w+)",
    "observer": r"new\s+(\w+Observer)\(",
    "timer": r"\b(setTimeout|setInterval|requestAnimationFrame)\(",
    "listener": r"addEventListener\(\s*['\"]([^'\"]+)",
    "storage": r"\b(localStorage|sessionStorage|indexedDB)\b",
    "eval": r"(?:^|[^\w.])(eval|new\s+Function)\s*\(",
    "cookie-write": r"(document\.cookie)\s*=[^=]",
    "cookie": r"(document\.cookie)",
    "unsafe-write": r"unsafeWindow\.(\w+)\s*=[^=]",
    "unsafe": r"unsafeWindow\.(\w+)",
    "define": r"Object\.defineProperty\(\s*window\s*,\s*['\"](\w+)",
    "emit": r"new\s+CustomEvent\(\s*['\"]([^'\"]+)",
    "vue-host": r"(__vue\w*__|__VUE\w*)",
    "react-host": r"(__REACT\w*|_reactRootContainer|__reactFiber\w*)",
    "gm": r"\b(GM_\w+|GM\.\w+)\s*\(",
    "new": r"new\s+([A-Z]\w*)\s*\(",
    "call": r"(?:^|[^\w$.])((?:this\.)?[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?)\s*\(",
}
INJECTIONS = ("inner-html", "insert-adjacent", "document-write", "mount", "style-element", "shadow-dom")
REQUESTS = ("gm-xhr", "fetch", "xhr", "websocket", "beacon")
HIJACKS = ("fetch-hijack", "xhr-hijack", "history-hijack", "socket-hijack", "listener-hijack")
#: Not called functions: words of the language that stand before a parenthesis.
WORDS = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "async", "constructor", "super")
#: Severity of each kind of risk.
SEVERITY = {
    **dict.fromkeys((*HIJACKS, "eval-usage", "cookie-write"), "high"),
    **dict.fromkeys(("unsafe-window-write", "cookie-read", "html-injection", "undeclared-gm-api", "unlisted-connect-domain"), "medium"),
    **dict.fromkeys(("unsafe-window-read", "gm-api-without-grant", "window-define"), "low"),
}
LEVELS = ("none", "low", "medium", "high")


def lines(facts: DataFrame) -> DataFrame:
    """path, line, text of user scripts without their comments."""
    return X.found(facts, "line", text=1).select("path", (F.col("ord") + 1).alias("line"), F.coalesce("text", F.lit("")).alias("text"))


def spans(facts: DataFrame) -> DataFrame:
    """path, name, kind, owner, low, high (the line after the last) of functions, classes and methods, by their brackets."""
    kinds = ("class", "function", "arrow", "method")
    found = reduce(DataFrame.unionByName, (X.found(facts, f"script-{k}", name=1).withColumn("kind", F.lit(k)) for k in kinds))
    found = found.where(~F.col("name").isin("if", "for", "while", "switch", "catch", "function"))
    # a method stands right inside the braces of the innermost class around it
    classes = found.where("kind = 'class'").select("path", F.struct("name", "depth").alias("span"), F.col("pos").alias("low"), F.col("end").alias("high"))
    methods = R.innermost(found.where("kind = 'method'"), classes, "path").where(F.col("depth") == F.col("span.depth") + 1)
    named = methods.withColumns({"owner": F.col("span.name"), "name": F.concat("span.name", F.lit("."), "name")}).drop("span")
    rows = found.where("kind in ('function', 'arrow')").withColumn("owner", F.lit(None).cast("string")).unionByName(named)
    return rows.select("path", "name", "kind", "owner", F.col("line").alias("low"), (F.col("line_end") + 1).alias("high"))


def events(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """path, line, kind, target, text, fn (the innermost function around it, or null). rows: lines()."""
    named = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("target"))
    every = [F.transform(F.regexp_extract_all("text", F.lit(p), 1), named(k)) for k, p in EVENTS.items()]
    found = rows.select("path", "line", "text", F.posexplode(F.concat(*every)).alias("n", "x")).select("path", "line", "n", "x.kind", "x.target", "text")
    found = found.where(~((F.col("kind") == "call") & F.col("target").isin(*WORDS)))
    around = functions.select("path", "low", "high", F.col("name").alias("fn"))
    return R.innermost(found.withColumn("pos", F.col("line")), around, "path", name="fn").drop("pos", "n")


def anchors(rows: DataFrame) -> DataFrame:
    """path, receiver, selector: variables that hold a queried element; the last declaration wins."""
    p = r"(?:const|let|var)\s+(\w+)\s*=\s*document\.(?:querySelector|getElementById)\(\s*['\"]([^'\"]+)"
    found = rows.select("path", "line", F.regexp_extract("text", p, 1).alias("receiver"), F.regexp_extract("text", p, 2).alias("selector")).where("receiver <> ''")
    return found.groupBy("path", "receiver").agg(F.max_by("selector", "line").alias("selector"))


def _grouped(rows: DataFrame, *by: str) -> DataFrame:
    """call_count, the first five lines and up to eight functions of each group, and id: a number by falling count."""
    ordered = lambda c, n: F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("line", c))), lambda x: x[c])), 1, n)
    return rows.groupBy("path", *by).agg(F.count("*").alias("call_count"), F.slice(F.array_sort(F.collect_list("line")), 1, 5).alias("lines"), F.array_compact(ordered("fn", 8)).alias("fns"), F.bool_or("interpolated").alias("interpolated"))


def injections(found: DataFrame, queried: DataFrame) -> DataFrame:
    """id, path, kind, target, call_count, lines, interpolated, fns. A variable that holds a queried element stands for its selector."""
    rows = found.where(F.col("kind").isin(*INJECTIONS)).join(queried.withColumnRenamed("receiver", "target"), ["path", "target"], "left")
    direct = F.col("target").rlike(r"^(window\.)?document\b")
    rows = rows.where((F.col("kind") != "mount") | direct | F.col("selector").isNotNull())
    rows = rows.withColumn("target", F.coalesce("selector", "target")).withColumn("interpolated", F.contains("text", F.lit("${")) | F.col("text").rlike(r"=[^=]*\+\s*\w"))
    ranked = _grouped(rows, "kind", "target")
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("call_count"), "kind", "target"))
    return ranked.select(F.concat(F.lit("inject:"), "path", F.lit("#"), place.cast("string")).alias("id"), "*")


def endpoints(found: DataFrame, meta: DataFrame) -> DataFrame:
    """id, path, kind, domain, call_count, lines, fns, allowed: by @connect, for the script manager's own requests; null where it can't be told."""
    host = F.nullif(F.regexp_extract("text", r"(?:https?|wss?)://([^/'\"`?#$]+)", 1), F.lit(""))
    rows = found.where(F.col("kind").isin(*REQUESTS)).withColumn("domain", F.coalesce(host, F.lit("(dynamic)"))).withColumn("interpolated", F.lit(False))
    connects = meta.where("key = 'connect'").groupBy("path").agg(F.collect_set("value").alias("connects"))
    allowed = F.when(F.col("kind") != "gm-xhr", F.lit(None)).when(F.array_contains("connects", "*"), True).when(F.col("domain") == "(dynamic)", F.lit(None)).otherwise(F.coalesce(F.array_contains("connects", F.col("domain")), F.lit(False)))
    grouped = _grouped(rows, "kind", "domain").drop("interpolated").join(connects, "path", "left")
    return grouped.select(F.concat(F.lit("net:"), "path", F.lit("#"), "kind", F.lit(":"), "domain").alias("id"), "path", "kind", "domain", "call_count", "lines", "fns", allowed.alias("allowed"))


def call_edges(found: DataFrame, functions: DataFrame) -> DataFrame:
    """path, src, dst, n: which function of a script calls which, how often; src is null for calls outside all functions.

    `this.m()` is a method of the caller's own class, `x.m()` one of the class that x was made of, `new C()` its constructor.
    """
    owner = functions.select("path", F.col("name").alias("fn"), "owner")
    made = r"(?:const|let|var)\s+(\w+)\s*=\s*new\s+([A-Z]\w*)"
    alias = found.where("kind = 'new'").select("path", F.regexp_extract("text", made, 1).alias("variable"), F.regexp_extract("text", made, 2).alias("cls"), "line").where("variable <> ''")
    alias = alias.groupBy("path", "variable").agg(F.max_by("cls", "line").alias("cls"))
    rows = found.where("kind in ('call', 'new')").join(owner, ["path", "fn"], "left").withColumn("variable", F.substring_index("target", ".", 1)).join(alias, ["path", "variable"], "left")
    member = F.substring_index("target", ".", -1)
    name = F.when(F.col("kind") == "new", F.concat("target", F.lit(".constructor"))).when(F.startswith("target", F.lit("this.")), F.concat("owner", F.lit("."), member)).when(F.contains("target", F.lit(".")) & F.col("cls").isNotNull(), F.concat("cls", F.lit("."), member)).otherwise(F.col("target"))
    known = functions.select("path", F.col("name").alias("dst")).distinct()
    calls = rows.select("path", F.col("fn").alias("src"), name.alias("dst"), "line").join(known, ["path", "dst"])
    # a declaration isn't a call of itself
    return calls.where("src is null or src <> dst").groupBy("path", "src", "dst").agg(F.count("*").alias("n"))


def top_level_calls(edges: DataFrame, most: int = 20) -> DataFrame:
    """path, name, n: the functions that a script calls outside all functions, the `most` frequent ones."""
    rows = edges.where("src is null").select("path", F.col("dst").alias("name"), "n")
    return top_per_group(rows, ["path"], [F.desc("n"), F.col("name")], most)


def script_functions(functions: DataFrame, found: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """id, path, name, kind, owner, line, line_count, counts of events, roles, calls, score, dead.

    Dead: its name stands once in the file, no function and no top-level code calls it, it is no constructor and no
    listener runs it. names: path, name, n.
    """
    count = lambda *k: F.count_if(F.col("kind").isin(*k))
    grouped = found.where("fn is not null").groupBy("path", F.col("fn").alias("name")).agg(
        count("inner-html", "insert-adjacent", "document-write").alias("html"), count("mount").alias("mounts"), count(*REQUESTS).alias("requests"), count("storage").alias("stored"),
        count("listener").alias("listeners"), count("observer").alias("observers"), count("timer").alias("timers"), count("create").alias("created"), count("gm").alias("gm"),
        F.count_if((F.col("kind") == "gm") & F.col("target").rlike("Value")).alias("gm_storage"),
    )
    out = edges.where("src is not null").groupBy("path", F.col("src").alias("name")).agg(F.sum("n").alias("calls"))
    into = edges.groupBy("path", F.col("dst").alias("name")).agg(F.countDistinct("src").alias("called_by"), F.count_if(F.col("src").isNull()).alias("at_top"))
    rows = functions
    for df in (grouped, out, into):
        rows = rows.join(df, ["path", "name"], "left")
    bare = F.substring_index("name", ".", -1)
    rows = rows.na.fill(0).withColumn("bare", bare).join(names.withColumnsRenamed({"name": "bare", "n": "named"}), ["path", "bare"], "left").drop("bare")
    marks = {"render": F.col("html") + F.col("mounts"), "data": F.col("requests"), "state": F.col("gm_storage") + F.col("stored"), "event": F.col("listeners") + F.col("observers") + F.col("timers"), "ui": F.col("created")}
    roles = F.slice(F.array_compact(F.array(*(F.when(n > 0, k) for k, n in marks.items()))), 1, 2)
    score = 3 * F.col("called_by") + F.col("calls") + 2 * (F.col("html") + F.col("mounts") + F.col("requests")) + F.col("gm") + F.col("listeners")
    rows = rows.withColumn("roles", F.when(F.size(roles) == 0, F.array(F.lit("logic"))).otherwise(roles)).withColumn("score", score)
    dead = (F.coalesce("named", F.lit(0)) <= 1) & (F.col("called_by") == 0) & (F.col("at_top") == 0) & ~F.col("name").endswith(".constructor") & ~F.array_contains("roles", "event")
    return rows.select(F.concat(F.lit("fn:"), "path", F.lit("#"), "name").alias("id"), "*", F.col("low").alias("line"), (F.col("high") - F.col("low")).alias("line_count"), dead.alias("dead")).drop("low", "high", "named").dropDuplicates(["id"])


def risks(found: DataFrame, api: DataFrame, injected: DataFrame, net: DataFrame, meta: DataFrame) -> DataFrame:
    """path, severity, kind, detail, line: rules that give a row each."""
    plain = lambda rows, kind, detail, line: rows.select("path", F.lit(kind).alias("kind"), detail.alias("detail"), line.cast("int").alias("line"))
    none = F.lit(None).cast("int")
    some = lambda kind, rows: rows.where(F.col("kind") == kind)
    listed = lambda kind: some(kind, found).groupBy("path").agg(F.array_join(F.slice(F.sort_array(F.collect_set("target")), 1, 5), ", ").alias("detail"))
    written = some("unsafe-write", found).select("path", "line", "target")
    reads = found.where("kind = 'unsafe'").join(written, ["path", "line", "target"], "left_anti").groupBy("path").agg(F.array_join(F.slice(F.sort_array(F.collect_set("target")), 1, 5), ", ").alias("detail"))
    cookies = found.where("kind in ('cookie', 'cookie-write')").groupBy("path").agg(F.count_if(F.col("kind") == "cookie-write").alias("w"), F.count_if(F.col("kind") == "cookie").alias("a"))
    no_grant = meta.where("key = 'grant' and value = 'none'").select("path").distinct().withColumn("granted_none", F.lit(True))
    used = api.where("not declared").join(no_grant, "path", "left").withColumn("line", none)
    html = injected.where("interpolated and kind in ('inner-html', 'insert-adjacent', 'document-write')").groupBy("path").agg(F.count("*").alias("n"), F.min(F.get("lines", F.lit(0))).alias("line"))
    rules = [
        *(plain(some(k, found), k, F.col("target"), F.col("line")) for k in HIJACKS),
        plain(some("eval", found), "eval-usage", F.col("target"), F.col("line")),
        plain(listed("unsafe-write"), "unsafe-window-write", F.col("detail"), none), plain(reads, "unsafe-window-read", F.col("detail"), none),
        plain(cookies.where("a > w"), "cookie-read", F.concat(F.lit("x"), (F.col("a") - F.col("w")).cast("string")), none), plain(cookies.where("w > 0"), "cookie-write", F.concat(F.lit("x"), F.col("w").cast("string")), none),
        plain(html, "html-injection", F.col("n").cast("string"), F.col("line")),
        plain(used.where("granted_none"), "gm-api-without-grant", F.col("name"), none), plain(used.where("granted_none is null"), "undeclared-gm-api", F.col("name"), none),
        plain(net.where("allowed = false"), "unlisted-connect-domain", F.col("domain"), F.get("lines", F.lit(0))), plain(some("define", found), "window-define", F.col("target"), F.col("line")),
    ]
    severity = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return reduce(DataFrame.unionByName, rules).select("path", F.element_at(severity, F.col("kind")).alias("severity"), "kind", "detail", "line")


def risk_levels(rows: DataFrame) -> DataFrame:
    """path, risk_level: the worst severity."""
    order: Column = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("severity"))
    return rows.groupBy("path").agg(F.max_by("severity", order).alias("risk_level"), F.count("*").alias("n_risks"))


def host_frameworks(found: DataFrame) -> DataFrame:
    """path, host: vue, react or mixed, by the marks that a script looks for in its page."""
    rows = found.where("kind in ('vue-host', 'react-host')").groupBy("path").agg(F.bool_or(F.col("kind") == "vue-host").alias("v"), F.bool_or(F.col("kind") == "react-host").alias("r"))
    return rows.select("path", F.when(F.col("v") & F.col("r"), "mixed").when(F.col("v"), "vue").otherwise("react").alias("host"))
