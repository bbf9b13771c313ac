"""Source trees as rows: one per file, with its path from the root, extension and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Extensions that are read, and folders that aren't; `build` is read under src/.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "vue", "rs", "dart", "go")
SKIPPED = (
    "node_modules", ".git", "dist", "dist-ssr", "build", "out", "coverage", ".next", ".nuxt", "public", "docs", ".codebuddy",
    ".codegraph", ".asdm", ".trae", ".claude", ".cursor", ".kiro", ".sisyphus", ".vscode", ".idea", "__pycache__", "android",
    "ios", "target", ".dart_tool", "linux", "macos", "windows", "vendor", "testdata", "bin",
)


def everything(spark: SparkSession, root: str, names: str | None = None) -> DataFrame:
    """Spark lists and reads the tree, so it may lie in any store that Spark reads. names: a glob of the files' names; others aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", names) if names else reader).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-zA-Z]+:/+", "/")
    path = F.regexp_replace("path", "^[a-zA-Z]+:/+", "/")
    return rows.select(F.substr(path, F.length(base) + 2).alias("path"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def plain_json(text: Column) -> Column:
    """JSON without the comments and last commas that configuration files have; strings stay as they are.

    The patterns take a string whole and never step back into it, so its length doesn't matter.
    """
    string = r'(?s)("(?:[^"\\]++|\\.)*+")'
    bare = F.regexp_replace(text, string + r"|//[^\n]*+|/\*.*?\*/", "$1")
    return F.regexp_replace(bare, string + r"|,(?=\s*+[}\]])", "$1")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def source_roots(paths: DataFrame, given: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The folders in which a tree's sources lie, by its paths (column path): those given that are there, else lib/ of a Dart package, else src/, else all.

    Folders of clients that build tools agree on come with them: src-tauri/src beside its configuration, electron/ with scripts
    in it, lib/ of a Dart package.
    """
    any_ = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    at = F.col("path")
    has = {
        "pubspec": at == "pubspec.yaml", "lib": F.startswith(at, F.lit("lib/")), "src": F.startswith(at, F.lit("src/")), "tauri": at == "src-tauri/tauri.conf.json", "tauri_src": F.startswith(at, F.lit("src-tauri/src/")),
        "electron": at.rlike(r"^electron/([^/]+/){0,3}[^/]+\.[jt]sx?$"), "dart": at.rlike(r"^lib/([^/]+/){0,3}[^/]+\.dart$"), **{f"given{i}": F.startswith(at, F.lit(f"{r}/")) for i, r in enumerate(given)},
    }
    found = paths.agg(*(any_(test).alias(k) for k, test in has.items())).first()
    if given:
        roots = [r for i, r in enumerate(given) if r == "." or found[f"given{i}"]]
    else:
        roots = ["lib"] if found.pubspec and found.lib else ["src"] if found.src else ["."]
    extra = (("src-tauri/src", found.tauri and found.tauri_src), ("electron", found.electron), ("lib", found.pubspec and found.dart))
    return tuple(dict.fromkeys([*roots, *(r for r, there in extra if there and "." not in roots)]))


def read_sources(spark: SparkSession, root: str, roots: tuple[str, ...] = (".",)) -> DataFrame:
    """path, ext, size, content of the source files under the roots (folders below `root`)."""
    rows = everything(spark, root, "*.{" + ",".join(EXTENSIONS) + "}").withColumn("ext", extension(F.col("path")))
    folders = F.filter(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), lambda x: x.isin(*SKIPPED))
    folders = F.when(F.startswith("path", F.lit("src/")), F.array_remove(folders, "build")).otherwise(folders)
    under = F.lit("." in roots)
    for r in roots:
        under = under | F.startswith("path", F.lit(f"{r}/"))
    return rows.where(F.col("ext").isin(*EXTENSIONS) & (F.size(folders) == 0) & under).select("path", "ext", "size", "content")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """name, version, scope, source of declared dependencies, from package.json, pubspec.yaml and go.mod at any depth.

    package.json is read as JSON; the other two line by line, each line under the section that was opened last.
    """
    files = everything(spark, root, "{package.json,pubspec.yaml,go.mod}").where(F.col("path").rlike(r"(^|/)(package\.json|pubspec\.yaml|go\.mod)$") & ~F.col("path").rlike(r"(^|/)node_modules/")).select("path", "content")
    scopes = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    kind = "struct<" + ", ".join(f"`{s}`: map<string, string>" for s in scopes) + ">"
    parsed = files.where(F.endswith("path", F.lit("package.json"))).select(F.from_json(plain_json(F.col("content")), kind).alias("j"))
    npm = None
    for n, s in enumerate(scopes):
        one = parsed.select(F.explode(f"j.{s}").alias("name", "version")).select("name", "version", F.lit(s).alias("scope"), F.lit("npm").alias("source"), F.lit(n).alias("ord"))
        npm = one if npm is None else npm.unionAll(one)
    lines = files.where(~F.endswith("path", F.lit("package.json"))).select("path", F.posexplode(F.split("content", "\r?\n")).alias("n", "line"))
    so_far = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    yaml = F.endswith("path", F.lit("pubspec.yaml"))
    opened = F.when(yaml & F.col("line").rlike(r"^[A-Za-z_]+:"), F.regexp_extract("line", r"^([A-Za-z_]+):", 1)).when(~yaml & F.col("line").rlike(r"^[a-z]+\s*\("), F.regexp_extract("line", r"^([a-z]+)", 1)).when(~yaml & F.trim("line").eqNullSafe(")"), "")
    lines = lines.withColumn("section", F.last(opened, ignorenulls=True).over(so_far))
    pub = lines.where(yaml & F.col("section").isin("dependencies", "dev_dependencies")).select(
        F.regexp_extract("line", r"^  ([A-Za-z0-9_]+):", 1).alias("name"), F.trim(F.regexp_extract("line", r"^  [A-Za-z0-9_]+:\s*([^#]*)", 1)).alias("version"), F.col("section").alias("scope"), F.lit("pub").alias("source"), F.lit(0).alias("ord")
    )
    required = r"^\s*(?:require\s+)?([^\s(]+\.[^\s]+/?[^\s]*)\s+(v[^\s]+)"
    go = lines.where(~yaml & ((F.col("section") == "require") | F.col("line").rlike(r"^require\s+[^(]"))).select(
        F.regexp_extract("line", required, 1).alias("name"), F.regexp_extract("line", required, 2).alias("version"), F.lit("require").alias("scope"), F.lit("go").alias("source"), F.lit(0).alias("ord")
    )
    return npm.unionAll(pub).unionAll(go).where("name <> ''").groupBy("name").agg(F.max_by(F.struct("version", "scope", "source"), "ord").alias("x")).select("name", "x.*")
