"""Scalar helpers over names, paths and urls, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of component names and the kinds they tell; the first that fits wins.
KIND_SUFFIXES = {
    "Page": "page", "Modal": "modal", "Dialog": "dialog", "Card": "card", "Chart": "chart", "Form": "form", "Detail": "detail",
    "Details": "detail", "Panel": "panel", "Section": "section", "List": "list", "Item": "item", "Button": "button",
    "Widget": "widget", "View": "view", "Provider": "provider", "Overlay": "overlay", "Tab": "tab", "Picker": "picker",
    "Badge": "badge",
}


def pascal_case(name: Column) -> Column:
    """Parts at `-`, `_` and white space, each with its first letter raised; the rest keeps its case."""
    parts = F.filter(F.split(name, r"[-_\s]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")


def snake_to_pascal(name: Column) -> Column:
    parts = F.filter(F.split(name, "_"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")


def normal_name(name: Column) -> Column:
    return F.translate(F.lower(name), "-_.", "")


def kind_of(name: Column) -> Column:
    out = F.lit("common")
    for suffix, kind in reversed(KIND_SUFFIXES.items()):
        out = F.when(F.endswith(name, F.lit(suffix)), F.lit(kind)).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(\.user\.js|\.[^.]*)$", "")


def normal_path(path: Column) -> Column:
    """`.` and `..` folded away."""
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.filter(F.split(path, "/"), lambda x: x != ""), F.array().cast("array<string>"), step), "/")


def component_name(path: Column) -> Column:
    """The name of a single-file component: `index` has its folder's, `[x]` its parameter's, `[...x]` is All."""
    own = stem(path)
    folder = base_name(dir_name(path))
    named = F.when((own == "index") & (folder != ""), folder).when(own.rlike(r"^\[\.\.\."), "All").otherwise(F.regexp_replace(own, r"[\[\]]", ""))
    return pascal_case(named)


def module_layer(path: Column) -> Column:
    """The folder below `src`, else the first one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, "").when((F.get(parts, F.lit(0)) == "src") & (F.size(parts) > 2), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))


def is_test(path: Column) -> Column:
    return path.rlike(r"(^|/)(__tests__|tests?)/|[._](test|spec)\.[a-z]+$")


def package_name(spec: Column) -> Column:
    """Scoped packages keep two segments."""
    return F.when(F.startswith(spec, F.lit("@")), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))


def url_domain(url: Column) -> Column:
    """The host (with port) of a url with a scheme or of `//host`, else a bare domain, else null."""
    host = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]+)", 1)
    bare = F.regexp_extract(url, r"^([a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+)(?:[/?#:]|$)", 1)
    return F.coalesce(F.nullif(host, F.lit("")), F.nullif(bare, F.lit("")))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def route_domain(path: Column) -> Column:
    """The first segment that isn't `api`, `apis` or a version, as long as others follow; `root` if there is none."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    named = F.filter(parts, lambda x: ~x.rlike("^(apis?|v[0-9]+)$"))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(parts, F.lit(-1)), F.lit("root"))


def capped(value: Column, most: int) -> Column:
    """White space folded, cut with three dots."""
    flat = F.trim(F.regexp_replace(value, "[ \t\n\r]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def html_escape(value: Column) -> Column:
    out = F.replace(value, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of an offset."""
    return F.length(F.substring(text, 1, offset)) - F.length(F.replace(F.substring(text, 1, offset), F.lit("\n"), F.lit(""))) + 1


def version_parts(version: Column) -> Column:
    """Three numbers; arrays compare as versions do."""
    parts = F.split(F.regexp_replace(version, "^v", ""), r"[.]")
    return F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.coalesce(F.try_element_at(parts, i).try_cast("int"), F.lit(0)))


def next_segment(segment: Column) -> Column:
    """File-convention route segments: groups and slots vanish (empty text), `[x]`, `[...x]`, `[[...x]]` are parameters."""
    return (
        F.when(segment.rlike(r"^\(.*\)$") | F.startswith(segment, F.lit("@")), "")
        .when(segment.rlike(r"^\[\[\.\.\.(.+)\]\]$"), F.concat(F.lit(":"), F.regexp_extract(segment, r"^\[\[\.\.\.(.+)\]\]$", 1), F.lit("?")))
        .when(segment.rlike(r"^\[\.\.\.(.+)\]$"), F.concat(F.lit(":"), F.regexp_extract(segment, r"^\[\.\.\.(.+)\]$", 1), F.lit("*")))
        .when(segment.rlike(r"^\[(.+)\]$"), F.concat(F.lit(":"), F.regexp_extract(segment, r"^\[(.+)\]$", 1)))
        .otherwise(segment)
    )
