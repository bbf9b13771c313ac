"""What a tree says about itself: path aliases, modules, frameworks, parts, counts of extensions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.graph import ancestors
from graphloom.sources.scan import everything, plain_json

# The first of these packages that a tree declares names its framework, and others that name variants of it.
FRAMEWORKS = (("expo", "expo"), ("react-native", "react-native"), ("nuxt", "nuxt"), ("next", "next"), ("vue", "vue"), ("react", "react"))
VARIANTS = (
    ("capacitor", ("@capacitor/core",), r"^capacitor\.config"), ("electron", ("electron",), r"^(electron/|electron-builder)"), ("vite", ("vite",), r"^vite\.config"),
    ("webpack", ("webpack",), r"^webpack\.config"), ("riverpod", ("flutter_riverpod", "riverpod", "hooks_riverpod"), None), ("provider", ("provider",), None),
    ("bloc", ("flutter_bloc", "bloc"), None), ("getx", ("get", "getx"), None), ("go_router", ("go_router",), None),
    ("gin", ("github.com/gin-gonic/gin",), None), ("cobra", ("github.com/spf13/cobra",), None), ("tauri", (), r"^src-tauri/"),
)
MANIFESTS = ("package.json", "pubspec.yaml", "go.mod", "Cargo.toml")


def aliases(spark: SparkSession, root: str, depth: int = 4) -> DataFrame:
    """prefix, target: path aliases that configurations give, of each prefix the one of the outermost file.

    tsconfig.json and jsconfig.json give `compilerOptions.paths` and, by `references`, those of other files (up to `depth` steps);
    vite and vue configurations give the pairs in their alias blocks.
    """
    files = everything(spark, root, "{*.json,{vite,vue,webpack}.config.*}").where(~F.col("path").rlike(r"(^|/)node_modules/")).select("path", "content")
    kind = "struct<compilerOptions: struct<baseUrl: string, paths: map<string, array<string>>>, references: array<struct<path: string>>>"
    configs = files.where(F.col("path").rlike(r"\.json$") & F.contains("content", F.lit("compilerOptions")) | F.col("path").rlike(r"(^|/)[jt]sconfig[^/]*\.json$"))
    configs = configs.select("path", F.from_json(plain_json(F.col("content")), kind).alias("j"))
    level = configs.where(F.col("path").isin("tsconfig.json", "jsconfig.json")).select("path", F.lit(0).alias("step"))
    reached = level
    links = configs.select("path", F.explode("j.references.path").alias("ref"))
    to = T.normal_path(F.concat(T.dir_name(F.col("path")), F.lit("/"), "ref", F.when(F.endswith("ref", F.lit(".json")), "").otherwise("/tsconfig.json")))
    links = links.select("path", to.alias("to"))
    for step in range(1, depth + 1):
        level = level.join(links, "path").select(F.col("to").alias("path"), F.lit(step).alias("step")).distinct()
        reached = reached.unionAll(level)
    reached = reached.groupBy("path").agg(F.min("step").alias("step"))
    paths = configs.join(reached, "path").select("path", "step", F.coalesce("j.compilerOptions.baseUrl", F.lit(".")).alias("base"), F.explode("j.compilerOptions.paths").alias("prefix", "targets")).where(F.size("targets") > 0)
    target = T.normal_path(F.concat(T.dir_name(F.col("path")), F.lit("/"), "base", F.lit("/"), F.regexp_replace(F.get("targets", F.lit(0)), r"\*$", "")))
    star = lambda c: F.endswith(c, F.lit("*"))
    ended = lambda c, by: F.when(by & (c != ""), F.concat(c, F.lit("/"))).otherwise(c)
    found = paths.select(F.regexp_replace("prefix", r"\*$", "").alias("prefix"), ended(target, star("prefix")).alias("target"), "step")
    blocks = files.where(F.col("path").rlike(r"^(vite|vue|webpack)\.config\.[cm]?[jt]s$")).select(F.explode(F.regexp_extract_all("content", F.lit(r"(?s)alias\s*:\s*\{(.*?)\}\s*[,}]"), 1)).alias("block"))
    pair = r"""['"]?([\w@#~/$-]+?)(?:/\*)?['"]?\s*:\s*(?:(?:path\.)?resolve\(\s*(?:__dirname\s*,\s*)?|fileURLToPath\(\s*new URL\(\s*)?['"]\.?/?([^'"]+?)(?:/\*)?['"]"""
    lists = [F.regexp_extract_all("block", F.lit(pair), i).alias(n) for i, n in ((1, "prefix"), (2, "target"))]
    written = blocks.select(*lists).select(F.explode(F.arrays_zip("prefix", "target")).alias("x")).select(F.concat("x.prefix", F.lit("/")).alias("prefix"), F.concat("x.target", F.lit("/")).alias("target"), F.lit(depth + 1).alias("step"))
    return found.unionAll(written).groupBy("prefix").agg(F.min_by("target", "step").alias("target"))


def go_modules(spark: SparkSession, root: str) -> DataFrame:
    """folder, module, version, n_files of each go.mod; `main` marks the one with the most Go files below it (the first of equals)."""
    files = everything(spark, root, "*.go").select("path")
    mods = everything(spark, root, "go.mod").select(T.dir_name(F.col("path")).alias("folder"), F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("module"), F.regexp_extract("content", r"(?m)^go\s+(\S+)", 1).alias("version"))
    above = files.where(F.col("path").rlike(r"\.go$")).select(F.explode(F.concat(F.array(F.lit("")), ancestors(T.dir_name(F.col("path"))))).alias("folder"))
    rows = mods.join(above.groupBy("folder").agg(F.count("*").alias("n_files")), "folder", "left").na.fill(0)
    top = rows.agg(F.min_by("folder", F.struct(-F.col("n_files"), F.col("folder"))).alias("folder")).withColumn("main", F.lit(True))
    return rows.join(top, "folder", "left").na.fill(False)


def sub_projects(paths: DataFrame) -> DataFrame:
    """name, kinds: folders of the first level with a manifest of their own."""
    found = paths.where((F.size(F.split("path", "/")) == 2) & T.base_name(F.col("path")).isin(*MANIFESTS))
    return found.groupBy(F.substring_index("path", "/", 1).alias("name")).agg(F.sort_array(F.collect_set(T.base_name(F.col("path")))).alias("kinds"))


def extensions(sources: DataFrame) -> DataFrame:
    return sources.groupBy("ext").agg(F.count("*").alias("n"))


def _any(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def framework(paths: DataFrame, declared: DataFrame) -> DataFrame:
    """One row: framework and variants, by declared packages (name, source) first, by files where these are silent.

    paths: all paths of the tree (path).
    """
    has = lambda *names: _any(F.col("name").isin(*names))
    packages = declared.agg(*(has(n).alias(f"d_{k}") for n, k in ((n, n.replace("-", "_")) for n, _ in FRAMEWORKS)), *(has(*names).alias(f"v_{k}") if names else F.lit(False).alias(f"v_{k}") for k, names, _ in VARIANTS), has("flutter").alias("flutter"))
    match = lambda p: _any(F.col("path").rlike(p))
    files = paths.agg(
        match(r"(^|/)pubspec\.yaml$").alias("pubspec"), match(r"(^|/)lib/.*\.dart$").alias("dart"), match(r"(^|/)go\.mod$").alias("gomod"), match(r"\.go$").alias("go"), match(r"\.vue$").alias("vue"), match(r"\.[tj]sx$").alias("jsx"),
        match(r"\.user\.js$").alias("script"), *((match(p) if p else F.lit(False)).alias(f"f_{k}") for k, _, p in VARIANTS),
    )
    row = packages.withColumn("one", F.lit(1)).join(files.withColumn("one", F.lit(1)), "one")
    name = F.when(F.col("pubspec") & F.col("flutter"), "flutter").when(F.col("pubspec") & F.col("dart"), "dart").when(F.col("gomod") & F.col("go"), "go")
    for package, kind in FRAMEWORKS:
        name = name.when(F.col("d_" + package.replace("-", "_")), kind)
    name = name.when(F.col("vue"), "vue").when(F.col("jsx"), "react").when(F.col("script"), "userscript").otherwise("unknown")
    variants = F.array_compact(F.array(*(F.when(F.col(f"v_{k}") | F.col(f"f_{k}"), k) for k, _, _ in VARIANTS)))
    label = F.concat("framework", F.when(F.size("variants") > 0, F.concat(F.lit(" + "), F.get("variants", F.lit(0)))).otherwise(""), F.when(F.size("variants") > 1, F.concat(F.lit(" ("), F.array_join(F.slice("variants", F.lit(2), F.greatest(F.size("variants") - 1, F.lit(0))), ", "), F.lit(")"))).otherwise(""))
    return row.select(name.alias("framework"), variants.alias("variants")).withColumn("label", label)


def html_entries(spark: SparkSession, root: str) -> DataFrame:
    """path of the scripts that pages at the top of a tree load by themselves."""
    pages = everything(spark, root, "*.{html,htm}").where(F.col("path").rlike(r"^[^/]+\.html?$"))
    src = r"""<script[^>]*\bsrc=["']/?([^"']+\.(?:tsx?|jsx?|vue))["']"""
    return pages.select(F.explode(F.regexp_extract_all("content", F.lit(src), 1)).alias("path")).distinct()


def host_configs(paths: DataFrame) -> DataFrame:
    """path of configuration files at the top of a tree."""
    return paths.where(F.col("path").rlike(r"^([\w.-]+\.config\.[cm]?[jt]s|app\.json|electron-builder[\w.-]*|pubspec\.yaml|go\.mod|Cargo\.toml|package\.json|[jt]sconfig[\w.-]*\.json)$"))


def git_head(spark: SparkSession, root: str) -> DataFrame:
    """branch, commit of the checked-out state, as the files of the repository tell them (null where there is none)."""
    try:
        files = everything(spark, f"{root}/.git").where(F.col("path").rlike(r"^(HEAD$|refs/heads/)")).select("path", F.trim(F.regexp_replace("content", "\\s+$", "")).alias("text"))
    except AnalysisException:  # not a repository
        return spark.createDataFrame([], "branch string, commit string")
    head = files.where("path = 'HEAD'").select(F.nullif(F.regexp_extract("text", r"^ref: refs/heads/(.+)$", 1), F.lit("")).alias("branch"), F.nullif(F.regexp_extract("text", r"^([0-9a-f]{40})$", 1), F.lit("")).alias("detached"))
    refs = files.select(F.substr("path", F.lit(len("refs/heads/") + 1)).alias("branch"), F.col("text").alias("commit"))
    return head.join(refs, "branch", "left").select("branch", F.coalesce("commit", "detached").alias("commit"))
