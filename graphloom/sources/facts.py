"""Facts of source files: all that patterns find in a text, with places, in one table written once.

`collect` reads each text once: it blanks comments and strings (without changing a place), matches all patterns of the file's
language and gives rows (path, kind, ...). Bodies of functions, classes and options come from matched brackets, not from
indentation. A file that fails gives an error row and nothing else. All other functions take that table (or sources) and give
a table of one sort of facts; a file that nothing is found in gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import resolve as R
from graphloom.operators.forest import composed
from graphloom.operators.graph import ancestors
from graphloom.operators.lineage import cut
from graphloom.sources.scanner import LANGUAGES, blank, noise, pairs

SCRIPT = ("ts", "tsx", "js", "jsx", "vue")
MARKUP = ("tsx", "jsx")


@dataclass(frozen=True)
class Pattern:
    """form: the text that is searched (content, code: without comments, bare: without strings too, meta: a user script's head).
    body: what belongs to a match beyond it: the block that follows, what an arrow leads to, or the rest of a tag.
    name: the group whose word is counted inside the body. scripts: user scripts alone.
    """

    exts: tuple[str, ...]
    regex: str
    form: str = "code"
    body: str = ""
    name: int = 0
    scripts: bool = False


_TARGET = r"""['"`](?:\$\{[^}`\n]*\}(?=/))?(/[^'"`\n]*|https?://[^'"`\n]*)['"`]"""
_WORDS = r"(?:public |private |protected |static |async |override |get |set |@override\s+|[\w<>?,]+ )"
_MEMBER, _GIVEN = r"([A-Za-z_]\w*)[ \t]*(?:<[^>\n]*>)?", r"\([^\n]*\)[ \t]*"
_START = r"(?m)(?:^|(?<=[{};]))[ \t]*(?!(?:return|await|throw|new|yield|else|case)\b)"
_CLASSES = ("ts", "tsx", "js", "jsx", "dart")
#: Kind of fact: where and what.
PATTERNS = {
    "import": Pattern(SCRIPT, r"""(?m)^[ \t]*(import|export)\s+(type\s+)?([\w*\s{},$]+?\s+from\s+)?['"]([^'"\n]+)['"]"""),
    "import-call": Pattern(SCRIPT, r"""(?:(?:const|let|var)\s+(\w+|\{[^{}\n]*\})\s*=\s*[^;\n]{0,60}?)?\b(?:import|require)\(\s*['"]([^'"\n]+)['"]\s*\)"""),
    "import-dart": Pattern(("dart",), r"""(?m)^\s*(?:import|export|part)\s+['"]([^'"\n]+)['"]"""),
    "import-go-block": Pattern(("go",), r"\bimport\s*\(([^)]*)\)"),
    "import-go": Pattern(("go",), r'(?m)^import\s+(?:\w+\s+)?"([^"]+)"'),
    "import-rust": Pattern(("rs",), r"(?m)^\s*(?:pub\s+)?use\s+([^;{]+)"),
    "type-script": Pattern(SCRIPT, r"(?m)^[ \t]*(export\s+)?(?:default\s+)?(?:abstract\s+)?(interface|class)\s+(\w+)(?:<[^>{]*>)?(?:\s+extends\s+([\w$., <>]+?))?(?:\s+implements\s+([\w$., <>]+?))?\s*\{", body="block", name=3),
    "type-dart": Pattern(("dart",), r"(?m)^[ \t]*(?:abstract\s+)?(class|mixin|enum)\s+(\w+)(?:<[^>{]*>)?(?:\s+extends\s+([\w<>]+))?(?:\s+with\s+[\w, <>]+?)?(?:\s+implements\s+([\w, <>]+?))?\s*\{", body="block", name=2),
    "type-go": Pattern(("go",), r"(?m)^type\s+(\w+)\s+(struct|interface)\b", body="block", name=1),
    "type-rust": Pattern(("rs",), r"(?m)^\s*(pub(?:\([^)]*\))?\s+)?(struct|enum|trait)\s+(\w+)(?:<[^>{]*>)?(?:\s*:\s*([\w +:]+?))?\s*(?:\{|\(|;)", body="block", name=3),
    "function": Pattern(SCRIPT, r"(?m)^[ \t]*(export\s+)?(default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", body="block", name=3),
    "function-arrow": Pattern(SCRIPT, r"(?m)^[ \t]*(export\s+)?const\s+(\w+)(?:\s*:[^=\n]+)?\s*=\s*(?:async\s*)?(?:\([^)\n]*\)|\w+)(?:\s*:[^=\n]+)?\s*=>", body="arrow", name=2),
    "function-go": Pattern(("go",), r"(?m)^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]\n]*\])?\(", body="block", name=2),
    "function-rust": Pattern(("rs",), r"(?m)^\s*(pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", body="block", name=2),
    "function-dart": Pattern(("dart",), r"(?m)^(?:Future<[^>\n]*>|[A-Za-z_][\w<>?]*)\s+(\w+)\s*\([^;\n]*\)\s*(?:async\s*)?\{", body="block", name=1),
    # a body opens, a type follows, or words of a type stand before: else it is a call
    "member-body": Pattern(_CLASSES, f"{_START}{_WORDS}*{_MEMBER}{_GIVEN}(?::[^{{;\\n]+)?(?:async\\*?[ \\t]*)?\\{{", body="block", name=1),
    "member-typed": Pattern(_CLASSES, f"{_START}{_WORDS}*{_MEMBER}{_GIVEN}:[^{{;\\n]+;"),
    "member-dart": Pattern(_CLASSES, f"{_START}{_WORDS}+{_MEMBER}{_GIVEN};"),
    "callable-dart": Pattern(("dart",), r"(?m)^[ \t]*(?:@override\s+)?(?:static[ \t]+)?(?:[\w<>?,\[\]]+[ \t]+)+(\w+)[ \t]*\([^;\n]*\)[ \t]*(?:async\*?[ \t]*)?(?:\{|=>)", form="bare", body="arrow", name=1),
    "call": Pattern(("go", "dart"), r"(?:\b([A-Za-z_][\w.]*)\.)?\b([A-Za-z_]\w*)\(", form="bare"),
    "vue-option": Pattern(("vue",), r"(?m)^[ \t]*(methods|computed)\s*:\s*\{", body="block"),
    "vue-member": Pattern(("vue",), r"(?m)^[ \t]*(?:async[ \t]+)?([A-Za-z_$][\w$]*)[ \t]*(?:\([^)\n]*\)[ \t]*\{|:[ \t]*(?:async[ \t]+)?function)"),
    "tag": Pattern(("tsx", "jsx", "vue"), r"<([A-Z]\w*|[a-z]+(?:-[a-z0-9]+)+)"),
    "store": Pattern(SCRIPT, r"(?m)^[ \t]*export\s+const\s+(\w+)\s*=\s*(create|defineStore)\b"),
    "store-vuex": Pattern(("ts", "js"), r"\b(new\s+Vuex\.Store|createStore|new\s+Store)\s*\(\s*\{"),
    "export": Pattern(("ts", "js"), r"(?m)^export\s+(default\s+)?(abstract\s+)?(class\b)?"),
    "single": Pattern(("ts", "js"), r"(?m)^export\s+(?:default|const\s+\w+\s*=)\s*new\s+\w+|(getInstance)\s*\("),
    "title": Pattern(SCRIPT, r"""(?s)(?:<route[^>]*>.{0,400}?|\bmeta\s*:\s*\{[^{}]*?|\bmetadata\b[^=]*=\s*\{[^{}]*?)\btitle["']?\s*:\s*["']([^"'\n]+)["']"""),
    "glob": Pattern(SCRIPT, r"""import\.meta\.glob(?:<[^>\n]*>)?\(\s*(\[[^\]]*\]|['"][^'"\n]*['"])"""),
    "fetch": Pattern(SCRIPT, r"\bfetch\(\s*" + _TARGET),
    "client": Pattern(SCRIPT, r"\.(get|post|put|delete|patch)(?:<[^>(]*>)?\(\s*" + _TARGET),
    "go-route": Pattern(("go",), r'(\w+)\.(GET|POST|PUT|DELETE|PATCH|Any)\(\s*"([^"]*)"\s*,\s*([^)\n]*)\)'),
    "go-group": Pattern(("go",), r'(\w+)\s*:?=\s*(\w+)\.Group\(\s*"([^"]*)"\s*(?:,\s*([^)\n]*))?\)((?:\.Use\([^\n]*\))*)'),
    "go-use": Pattern(("go",), r"(?m)^[ \t]*(\w+)\.Use\(([^\n]*)\)"),
    "script-api": Pattern(("js", "ts"), r"\b(GM_\w+|GM\.\w+)\s*\(", scripts=True),
    "script-url": Pattern(("js", "ts"), r"""(?:url\s*:|fetch\(|\.open\([^,]+,)\s*(['"`][^'"`\n]*['"`]|\w+)""", scripts=True),
    "script-meta": Pattern(("js", "ts"), r"(?m)^\s*//\s*@(\S+)[ \t]+(.*?)[ \t]*$", form="meta", scripts=True),
    "script-class": Pattern(("js", "ts"), r"(?m)^\s*(?:export\s+)?class\s+(\w+)", body="block", scripts=True),
    "script-function": Pattern(("js", "ts"), r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\(", body="block", scripts=True),
    "script-arrow": Pattern(("js", "ts"), r"(?m)^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|\w+\s*=>)", body="arrow", scripts=True),
    "script-method": Pattern(("js", "ts"), r"(?m)^[ \t]*(?:(?:static|async|get|set)\s+)*(\w+)\s*\([^;\n]*\)\s*\{", body="block", scripts=True),
    "route-record": Pattern(SCRIPT, r"""\bpath:\s*['"]([^'"\n]*)['"]"""),
    "route-shown": Pattern(SCRIPT, r"""\b(?:component|element|Component):\s*<?\s*([A-Z]\w*)"""),
    "route-dart": Pattern(("dart",), r"""\bGoRoute\(\s*path:\s*['"]([^'"]+)['"][^;]*?(?:=>|return)\s*(?:const\s+)?([A-Z]\w*)"""),
    "route-overlay": Pattern(SCRIPT, r"""\bid:\s*['"]([\w/-]+)['"]\s*,[^{}]*?\bcomponent:\s*([A-Z]\w*)"""),
    "navigate": Pattern(SCRIPT, r"""(?:\b(navigate)\(|\b(\w+)\.(?:push|replace)\(|<(?:Link|NavLink|Navigate|router-link)\s[^>]*?\b(?:to|href)=\{?)\s*['"](/[^'"]*)['"]"""),
    "navigate-from": Pattern(SCRIPT, r"""\b(?:const|let|var)\s+(\w+)\s*=\s*(useRouter|useNavigate|createRouter|new\s+VueRouter|\w+)\b"""),
    "navigate-dart": Pattern(("dart",), r"""\bcontext\.(?:go|push)\(\s*['"](/[^'"]*)['"]"""),
    "state": Pattern(SCRIPT, r"const\s*\[\s*(\w+)\s*,\s*\w*\s*\]\s*=\s*(?:React\.)?useState"),
    "held": Pattern(SCRIPT, r"const\s+\{?\s*(\w+)[\w,\s]*\}?\s*=\s*use\w*Store\b"),
    "given": Pattern(MARKUP, r"(?:function\s+[A-Z]\w*|const\s+[A-Z]\w*\s*=)\s*\(\s*\{([^}]*)\}"),
    "command": Pattern(("go",), r"(\w+)\s*:?=\s*&cobra\.Command\{[^{}]*?Use:\s*\"([^\" ]+)"),
    "command-add": Pattern(("go",), r"(\w+)\.AddCommand\(([^)]*)\)"),
}
_COMPILED = {k: re.compile(p.regex, re.ASCII) for k, p in PATTERNS.items()}
_OF = {ext: [k for k, p in PATTERNS.items() if ext in p.exts] for ext in LANGUAGES}
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_META = re.compile(r"==UserScript==(.*?)==/UserScript==", re.DOTALL)
_TAG = re.compile(r"<([A-Z]\w*)(?=[\s/>])|</([A-Z]\w*)\s*>", re.ASCII)
_ATTRIBUTE = re.compile(r"\s*(?:\{\s*\.\.\.(\w+)[^}]*\}|([A-Za-z_][\w:.-]*)(\s*=\s*)?)", re.ASCII)
FACTS = "path string, ext string, kind string, ord int, pos int, end int, line int, line_end int, depth int, inside int, groups array<string>"


class Text:
    """A file's text in its forms, with its brackets and lines."""

    def __init__(self, path: str, ext: str, content: str):
        if "\ufffd" in content:
            raise ValueError("not UTF-8")
        spans = noise(content, LANGUAGES[ext])
        self.ext, self.content = ext, content
        self.code, self.bare = blank(content, spans, False), blank(content, spans, True)
        self.script = path.endswith(".user.js") or "==UserScript==" in content[:4096]
        found = _META.search(content[:8192]) if self.script else None
        self.meta = found.group(1) if found else ""
        self.newlines = np.flatnonzero(np.frombuffer(content.encode("utf-32-le", "surrogatepass"), "<u4") == 10)

    @cached_property
    def brackets(self) -> list[np.ndarray]:
        return pairs(self.bare)

    @cached_property
    def partner(self) -> dict[int, int]:
        return {int(a): int(b) for found in self.brackets for a, b, _ in found}

    def depth(self, at: np.ndarray) -> np.ndarray:
        """How many braces are open around places."""
        braces = self.brackets[0]
        return np.searchsorted(braces[:, 0], at) - np.searchsorted(np.sort(braces[:, 1]), at)

    def lines(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.newlines, at) + 1

    _STOPS = {"block": re.compile(r"[({\[;]"), "arrow": re.compile(r"[({\[;\n]"), "tag": re.compile(r"[{>]")}

    def end_of(self, kind: str, at: int) -> int:
        """Where the block that follows a place ends; or what an arrow leads to, a block or an expression; or a tag."""
        stops, arrow = self._STOPS[kind], kind == "arrow"
        if arrow:
            at += len(self.bare[at : at + 200]) - len(self.bare[at : at + 200].lstrip())
            if self.bare[at : at + 1] in ("{", "("):
                return self.partner.get(at, at) + 1
        while match := stops.search(self.bare, at):
            at, c = match.start(), match.group()
            if c in ";>":
                return at + 1
            if c == "\n":
                return at
            close = self.partner.get(at)
            if close is None:
                return at + 1
            # `interface{}` and `struct{}` are types, no body
            if c == "{" and kind == "block" and not self.bare[:at].rstrip().endswith(("interface", "struct")) or (c == "{" and close > at + 1 and kind == "block"):
                return close + 1
            at = close + 1
        return len(self.bare)

    def attributes(self, at: int, end: int) -> Iterator[tuple[str | None, str | None, str | None]]:
        """name, value (null: none), rest (of a spread) of each attribute of a tag between two places."""
        while at < end and (match := _ATTRIBUTE.match(self.code, at, end)):
            rest, name, gives = match.groups()
            at, value = match.end(), None
            if gives and at < end:
                c = self.code[at]
                if c == "{":
                    stop = self.partner.get(at, end - 1) + 1
                elif c in "\"'":
                    stop = self.code.find(c, at + 1, end) + 1 or end
                else:
                    stop = at
                value, at = self.code[at:stop], max(stop, at + (stop == at))
            yield name, value, rest


def _digest(content: str) -> str:
    return hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()


def _facts_of(path: str, ext: str, content: str) -> list[tuple]:
    """(kind, ord, pos, end, inside, groups) of everything found in a text."""
    text = Text(path, ext, content)
    out = [("file", 0, 0, len(content), 0, [None, str(text.script).lower(), _digest(content)])]
    named = text.code if ext in ("vue", "dart") else text.bare
    out += [("name", i, 0, 0, n, [name]) for i, (name, n) in enumerate(sorted(Counter(_NAME.findall(named)).items()))]
    if text.script:
        out += [("line", i, 0, 0, 0, [line]) for i, line in enumerate(text.code.split("\n"))]
    for kind in _OF[ext]:
        p = PATTERNS[kind]
        if p.scripts and not text.script:
            continue
        for i, match in enumerate(_COMPILED[kind].finditer(getattr(text, p.form))):
            at, inside = match.end(), 0
            if p.body:
                at = text.end_of(p.body, at - (match.group()[-1] in "{("))
                if p.name:
                    inside = sum(m.group() == match.group(p.name) for m in _NAME.finditer(named, match.start(), at))
            out.append((kind, i, match.start(), at, inside, list(match.groups())))
    if any(r[0] == "route-record" for r in out):
        out += [("object", i, int(a), int(b) + 1, 0, [None]) for i, (a, b, _) in enumerate(text.brackets[0])]
    if ext in MARKUP:
        for i, match in enumerate(_TAG.finditer(text.code)):
            end = match.end() if match.group(1) is None else text.end_of("tag", match.end())
            closed = match.group(1) is None or text.bare[: end - 1].endswith("/")
            out.append(("markup", i, match.start(), end, 0, [match.group(1) or match.group(2), "close" if match.group(1) is None else "single" if closed else "open"]))
            if match.group(1):
                out += [("attribute", 1000 * i + k, match.start(), end, 0, [match.group(1), *found]) for k, found in enumerate(text.attributes(match.end(), end - 1))]
    if not out:
        return []
    at = np.array([(r[2], r[3]) for r in out])
    lines, depth = text.lines(at), text.depth(at[:, 0])
    return [(path, ext, kind, ord_, pos, end, int(one), int(two), int(d), inside, groups) for (kind, ord_, pos, end, inside, groups), (one, two), d in zip(out, lines, depth, strict=True)]


def collect(sources: DataFrame) -> DataFrame:
    """The facts of sources (path, ext, content): FACTS. Every file has a row of kind `file`; its first group is an error, if there was one."""
    names = [x.split()[0] for x in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, ext, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                path, ext = path.as_py(), ext.as_py()
                try:
                    rows += _facts_of(path, ext, content.as_py() or "")
                except Exception as failure:  # whatever is wrong with this file, the others' facts stay
                    rows.append((path, ext, "file", 0, 0, 0, 1, 1, 0, 0, [str(failure) or type(failure).__name__, "false", _digest(content.as_py() or "")]))
                if len(rows) > 50_000:
                    yield _batch(rows, names)
                    rows = []
            yield _batch(rows, names)

    return sources.where("content is not null").select("path", "ext", "content").mapInArrow(run, FACTS)


#: Parts in which stored facts are replaced.
BUCKETS = 64


def update(sources: DataFrame, folder: str) -> DataFrame:
    """The facts of sources, stored in a folder: only files whose text has changed since the last time are read for facts again.

    Files are told by the SHA-256 of their text. The table is cut into BUCKETS by path, and only the buckets of files that were
    changed, added or removed are written anew. A run that is lost half-way leaves buckets that the next run finds and mends.
    """
    spark, path = sources.sparkSession, F.col("path")
    bucket = F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int").alias("bucket")
    schema = f"{FACTS}, bucket int"
    if not _exists(spark, folder):
        collect(sources).select("*", bucket).sortWithinPartitions("bucket", "kind").write.partitionBy("bucket").parquet(folder)
        return spark.read.schema(schema).parquet(folder).drop("bucket")
    stored = spark.read.schema(schema).parquet(folder)
    now = sources.where("content is not null").select("path", F.sha2("content", 256).alias("now"))
    before = stored.where("kind = 'file'").select("path", F.get("groups", F.lit(2)).alias("before"))
    changed = cut(now.join(before, "path", "full_outer").where(~F.col("now").eqNullSafe(F.col("before"))).select("path", F.col("now").isNull().alias("gone"), bucket))
    if not changed.isEmpty():
        touched = changed.select("bucket").distinct()
        kept = stored.join(touched, "bucket", "left_semi").join(changed.select("path"), "path", "left_anti").where("kind <> 'bucket'").select(*stored.columns)
        fresh = collect(sources.join(changed.where("not gone").select("path"), "path", "left_semi")).select("*", bucket)
        # a bucket whose files are all gone is written too: by a row that is no fact
        empty = touched.select(*(F.lit("bucket" if c == "kind" else None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns if c != "bucket"), "bucket")
        rows = cut(kept.unionByName(fresh).unionByName(empty))
        rows.sortWithinPartitions("bucket", "kind").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    return spark.read.schema(schema).parquet(folder).where("kind <> 'bucket'").drop("bucket")


def _exists(spark: SparkSession, folder: str) -> bool:
    try:
        return bool(spark.read.parquet(folder).columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int32()] * 7 + [pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)


def found(facts: DataFrame, kind: str, /, **groups: int) -> DataFrame:
    """path, ext, ord, places and a column for each group of the facts of a kind."""
    facts = facts if "groups" in facts.columns else collect(facts)
    picked = [F.nullif(F.get("groups", F.lit(g - 1)), F.lit("")).alias(name) for name, g in groups.items()]
    rows = facts.where(F.col("kind") == kind)
    return rows.select("path", "ext", "ord", "pos", "end", "line", "line_end", "depth", "inside", *picked)


def files(facts: DataFrame) -> DataFrame:
    """path, ext, line_count, is_script, error of every file."""
    rows = found(facts, "file", error=1, script=2)
    return rows.select("path", "ext", F.col("line_end").alias("line_count"), (F.col("script") == "true").alias("is_script"), "error")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def imports(facts: DataFrame) -> DataFrame:
    """path, spec, names, kind (static, type, dynamic), export (what is imported is exported again) of every import."""
    static = found(facts, "import", word=1, type=2, names=3, spec=4)
    static = static.select("path", "ord", "spec", (F.col("word") == "export").alias("export"), F.regexp_replace("names", r"\s+from\s+$", "").alias("names"), F.when(F.col("type").isNull(), "static").otherwise("type").alias("kind"))
    dynamic = found(facts, "import-call", names=1, spec=2).withColumn("kind", F.lit("dynamic"))
    blocks = found(facts, "import-go-block", block=1).select("path", "ord", F.explode(F.regexp_extract_all("block", F.lit(r'"([^"]+)"'), 1)).alias("spec"))
    plain = [found(facts, kind, spec=1).select("path", "ord", "spec") for kind in ("import-dart", "import-go", "import-rust")]
    others = _union([blocks, *plain]).withColumn("kind", F.lit("static"))
    rows = _union([static, dynamic.select("path", "ord", "spec", "names", "kind"), others])
    return rows.select("path", "ord", "spec", "names", "kind", F.coalesce("export", F.lit(False)).alias("export"))


def bindings(imports: DataFrame) -> DataFrame:
    """path, spec, export, local, imported of every name that an import binds: `default`, `*` (all as an object), or the name in its file.

    For re-exports `local` is the name under which it goes on; `export * from` has local `*`.
    """
    rows = imports.where("names is not null").withColumn("braced", F.regexp_extract("names", r"\{([^}]*)\}", 1))
    listed = rows.select("path", "spec", "export", F.explode(F.split("braced", ",")).alias("x")).withColumn("x", F.regexp_replace(F.trim("x"), r"^type\s+", ""))
    # `a as b` in imports and exports, `a: b` where an object of a dynamic import is taken apart
    parts = F.split("x", r"\s+as\s+|\s*:\s*")
    listed = listed.where("x <> ''").select("path", "spec", "export", F.element_at(parts, -1).alias("local"), F.get(parts, F.lit(0)).alias("imported"))
    star = rows.where(F.col("names").rlike(r"\*")).select("path", "spec", "export", F.coalesce(F.nullif(F.regexp_extract("names", r"\*\s+as\s+([\w$]+)", 1), F.lit("")), F.lit("*")).alias("local"), F.lit("*").alias("imported"))
    first = F.regexp_extract("names", r"^\s*([A-Za-z_$][\w$]*)", 1)
    default = rows.where(first != "").select("path", "spec", "export", first.alias("local"), F.when(F.col("kind") == "dynamic", "*").otherwise("default").alias("imported"))
    return _union([listed, star, default]).distinct()


def types(facts: DataFrame) -> DataFrame:
    """path, name, entity (interface or class), kind, exported, extends, implements, and the places of the body (low, high, depth, inside)."""
    script = found(facts, "type-script", exported=1, kind=2, name=3, extends=4, implements=5)
    dart = found(facts, "type-dart", kind=1, name=2, extends=3, implements=4)
    dart = dart.withColumn("exported", F.when(~F.startswith("name", F.lit("_")), "yes"))
    go = found(facts, "type-go", name=1, kind=2).withColumn("exported", F.when(F.col("name").rlike("^[A-Z]"), "yes"))
    rust = found(facts, "type-rust", exported=1, kind=2, name=3, extends=4)
    listed = lambda c, cut: F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", ""), cut), lambda x: F.trim(x)), lambda x: x != "")
    rows = _union([script, dart, go, rust])
    entity = F.when(F.col("kind").isin("interface", "trait"), "interface").otherwise("class")
    return rows.select("path", "ext", "ord", "name", entity.alias("entity"), "kind", F.col("exported").isNotNull().alias("exported"), listed(F.col("extends"), r"[,+]").alias("extends"), listed(F.col("implements"), ",").alias("implements"), F.col("pos").alias("low"), F.col("end").alias("high"), "depth", "inside")


def functions(facts: DataFrame) -> DataFrame:
    """path, name, owner (of methods), exported of functions and, where the language names the owner in place, methods; and the places of the body."""
    plain = found(facts, "function", exported=1, default=2, name=3)
    arrow = found(facts, "function-arrow", exported=1, name=2)
    go = found(facts, "function-go", owner=1, name=2).withColumn("exported", F.when(F.col("name").rlike("^[A-Z]"), "yes"))
    rust = found(facts, "function-rust", exported=1, name=2)
    dart = found(facts, "function-dart", name=1).withColumn("exported", F.when(~F.startswith("name", F.lit("_")), "yes"))
    rows = _union([plain, arrow, go, rust, dart])
    return rows.select("path", "ext", "ord", "name", "owner", F.col("exported").isNotNull().alias("exported"), F.col("default").isNotNull().alias("is_default"), F.col("pos").alias("low"), F.col("end").alias("high"), "line", F.col("line_end"), "depth", "inside")


def members(facts: DataFrame) -> DataFrame:
    """path, ord, owner, name of the methods that stand in the body of a class or interface: right inside its braces, not deeper."""
    rows = _union([found(facts, kind, name=1) for kind in ("member-body", "member-typed", "member-dart")])
    rows = rows.where(~F.col("name").isin("if", "for", "while", "switch", "catch", "return", "function")).select("path", "pos", "name", "depth")
    owners = types(facts.where(F.col("ext").isin(*_CLASSES))).select("path", F.struct("name", "depth").alias("owner"), "low", "high")
    held = R.innermost(rows, owners, "path", name="owner").where(F.col("depth") == F.col("owner.depth") + 1)
    return held.groupBy("path", F.col("owner.name").alias("owner"), "name").agg(F.min("pos").alias("ord"))


def vue_members(facts: DataFrame) -> DataFrame:
    """path, name of the methods of single-file components: of an options object's `methods` and `computed`, and functions of a setup script."""
    rows = found(facts, "vue-member", name=1).where(~F.col("name").isin("if", "for", "while", "switch", "catch")).select("path", "pos", "name", "depth")
    options = found(facts, "vue-option", option=1).select("path", F.col("depth").alias("option"), F.col("pos").alias("low"), F.col("end").alias("high"))
    listed = R.innermost(rows, options, "path", name="option").where(F.col("depth") == F.col("option") + 1)
    plain = functions(facts.where("ext = 'vue'")).select("path", "name")
    return listed.select("path", "name").unionByName(plain).distinct()


def tags(facts: DataFrame) -> DataFrame:
    """path, pos, tag of the tags of components."""
    return found(facts, "tag", tag=1).select("path", "ext", "pos", "tag")


def stores(facts: DataFrame) -> DataFrame:
    """path, ord, name, provider (zustand, pinia or vuex) of stores."""
    made = found(facts, "store", name=1, provider=2).select("path", "ord", "name", F.when(F.col("provider") == "create", "zustand").otherwise("pinia").alias("provider"))
    vuex = found(facts, "store-vuex", name=1).where(F.col("path").rlike(r"(^|/)stores?/")).where("ord = 0")
    return made.unionByName(vuex.select("path", "ord", T.base_name(T.dir_name(F.col("path"))).alias("name"), F.lit("vuex").alias("provider")))


def services(facts: DataFrame) -> DataFrame:
    """path, ord, name, pattern (singleton, class or functions) of service files: by their name or folder."""
    wanted = F.col("path").rlike(r"(Service|Engine|Manager|Repository|Factory)\.[jt]s$|(^|/)(services?|api|apis)/[^/]+\.[jt]s$") & ~F.col("path").rlike(r"(^|/)index\.[jt]s$|\.(test|spec|d)\.[jt]s$")
    exports = found(facts, "export", cls=3).where(wanted).groupBy("path").agg(F.bool_or(F.col("cls").isNotNull()).alias("cls"))
    single = found(facts, "single").select("path", F.lit(True).alias("single")).distinct()
    pattern = F.when(F.col("single"), "singleton").when(F.col("cls"), "class").otherwise("functions")
    return exports.join(single, "path", "left").select("path", F.lit(0).alias("ord"), F.regexp_extract("path", r"([^/]+)\.[jt]s$", 1).alias("name"), pattern.alias("pattern"))


def titles(facts: DataFrame) -> DataFrame:
    """path, ord, title: what pages call themselves, in route blocks, route records or metadata."""
    return found(facts, "title", title=1).select("path", "ord", "title")


def globbed(facts: DataFrame) -> DataFrame:
    """path of files that an `import.meta.glob` takes in: its globs, without those that begin with `!`."""
    calls = found(facts, "glob", list=1).select("path", "ord", F.explode(F.regexp_extract_all("list", F.lit(r"""['"]([^'"]+)['"]"""), 1)).alias("glob"))
    calls = calls.select("path", "ord", F.regexp_replace("glob", "^!", "").alias("glob"), F.startswith("glob", F.lit("!")).alias("out"))
    base = F.when(F.startswith("glob", F.lit("/")), F.substr("glob", F.lit(2))).when(F.startswith("glob", F.lit("@/")), F.concat(F.lit("src/"), F.substr("glob", F.lit(3)))).otherwise(T.normal_path(F.concat(T.dir_name(F.col("path")), F.lit("/"), "glob")))
    spelled = calls.withColumn("glob", base).select(F.struct("path", "ord").alias("call"), "out", F.regexp_extract("glob", r"^([^*]*)/", 1).alias("folder"), R.regex_of_glob(F.col("glob")).alias("regex"))
    below = files(facts).select("path", F.explode(F.concat(F.array(F.lit("")), ancestors(T.dir_name(F.col("path"))))).alias("folder"))
    hits = below.join(spelled, "folder").where(F.expr("path rlike regex")).groupBy("call", "path").agg(F.bool_or("out").alias("out"))
    return hits.where("not out").select("path").distinct()


def http_calls(facts: DataFrame) -> DataFrame:
    """path, method, url, of calls whose target begins with / or http."""
    fetched = found(facts, "fetch", url=1).withColumn("method", F.lit("GET"))
    client = found(facts, "client", method=1, url=2)
    return _union([fetched, client]).select("path", "ord", F.upper("method").alias("method"), "url")


def go_routes(facts: DataFrame) -> DataFrame:
    """method, route, handler, middlewares (outermost first) of routes that a Go router registers.

    Groups of a file hand their prefixes and middlewares down to the groups and routes made of them, however deep.
    """
    words = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r",(?![^(]*\))"), lambda x: F.trim(x)), lambda x: x != "")
    routes = found(facts, "go-route", router=1, method=2, route=3, handlers=4)
    groups = found(facts, "go-group", router=1, parent=2, prefix=3, own=4, chained=5)
    chained = F.flatten(F.transform(F.regexp_extract_all(F.coalesce("chained", F.lit("")), F.lit(r"\.Use\(((?:[^()]|\([^()]*\))*)\)"), 1), words))
    used = found(facts, "go-use", router=1, list=2).select("path", "router", "ord", words(F.regexp_replace("list", r"\)\s*$", "")).alias("list"))
    used = used.groupBy("path", "router").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "list"))), lambda x: x["list"])).alias("used"))
    nodes = groups.groupBy("path", "router").agg(F.min_by(F.struct("parent", "prefix", F.concat(words(F.col("own")), chained).alias("own")), "ord").alias("g"))
    # a router that is no group may have middlewares too
    tops = used.select("path", "router").unionByName(routes.select("path", "router")).distinct().join(nodes, ["path", "router"], "left_anti").select("path", "router", F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("prefix"), F.array().cast("array<string>").alias("own"))
    nodes = nodes.select("path", "router", "g.parent", F.array(F.coalesce("g.prefix", F.lit(""))).alias("prefix"), "g.own").unionByName(tops).join(used, ["path", "router"], "left")
    nodes = nodes.select("path", "router", F.when(F.col("parent") != F.col("router"), F.col("parent")).alias("parent"), F.col("path").alias("parent_path"), "prefix", F.concat("own", F.coalesce("used", F.array().cast("array<string>"))).alias("middlewares"))
    whole = composed(nodes, ["path", "router"], ["parent_path", "parent"], ["prefix", "middlewares"])
    handlers = words(F.col("handlers"))
    spelled = F.concat(F.array_join(F.coalesce("prefix", F.array().cast("array<string>")), "/"), F.lit("/"), F.coalesce("route", F.lit("")))
    spelled = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), spelled), "/+", "/"), "(.)/$", "$1")
    rows = routes.join(whole, ["path", "router"], "left")
    before = F.concat(F.coalesce("middlewares", F.array().cast("array<string>")), F.slice(handlers, F.lit(1), F.greatest(F.size(handlers) - 1, F.lit(0))))
    return rows.select("path", "ord", "method", spelled.alias("route"), F.try_element_at(handlers, F.lit(-1)).alias("handler"), before.alias("middlewares"))


def name_counts(facts: DataFrame) -> DataFrame:
    """path, name, n: how often an identifier stands in a file."""
    return found(facts, "name", name=1).select("path", "name", F.col("inside").cast("long").alias("n"))


# Kinds of the script manager's functions.
API_KINDS = {
    "GM_getValue": "storage", "GM_setValue": "storage", "GM_deleteValue": "storage", "GM_listValues": "storage",
    "GM_addValueChangeListener": "storage", "GM_removeValueChangeListener": "storage", "GM_xmlhttpRequest": "network",
    "GM_addStyle": "style", "GM_getResourceText": "resource", "GM_getResourceURL": "resource",
    "GM_registerMenuCommand": "menu", "GM_unregisterMenuCommand": "menu", "GM_notification": "notification",
    "GM_setClipboard": "clipboard", "GM_download": "download", "GM_openInTab": "tab", "GM_log": "info", "GM_info": "info",
}


def script_meta(facts: DataFrame) -> DataFrame:
    """path, ord, key, value of the metadata lines in the first 8 KB."""
    return found(facts, "script-meta", key=1, value=2).select("path", "ord", "key", "value")


def script_api_calls(facts: DataFrame) -> DataFrame:
    """path, name, kind, n, declared (by @grant) of the script manager's functions that are called."""
    names = found(facts, "script-api", name=1)
    lowered = F.lower(F.replace("name", F.lit("."), F.lit("_")))
    kinds = names.sparkSession.createDataFrame([(k.lower(), k, v) for k, v in API_KINDS.items()], "low string, full string, kind string")
    counted = names.withColumn("low", lowered).join(F.broadcast(kinds), "low", "left").groupBy("path", F.coalesce("full", "name").alias("name"), F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))
    granted = script_meta(facts).where("key = 'grant'").select("path", F.replace("value", F.lit("GM."), F.lit("GM_")).alias("name"), F.lit(True).alias("declared")).distinct()
    return counted.join(granted, ["path", "name"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


def script_endpoints(facts: DataFrame) -> DataFrame:
    """path, domain, n, allowed: hosts that a script reaches; allowed by @connect (`*` allows all), null where the host is dynamic."""
    urls = found(facts, "script-url", raw=1)
    host = F.nullif(F.regexp_extract("raw", r"https?://([^/'\"`?#$]+)", 1), F.lit(""))
    counted = urls.groupBy("path", host.alias("domain")).agg(F.count("*").alias("n"))
    connects = script_meta(facts).where("key = 'connect'").groupBy("path").agg(F.collect_set("value").alias("connects"))
    allowed: Column = F.when(F.col("domain").isNull(), F.lit(None)).otherwise(
        F.coalesce(F.exists("connects", lambda c: (c == "*") | (F.col("domain") == c) | F.endswith("domain", F.concat(F.lit("."), c))), F.lit(False))
    )
    return counted.join(connects, "path", "left").select("path", F.coalesce("domain", F.lit("(dynamic)")).alias("domain"), "n", allowed.alias("allowed"))


def markup_spans(facts: DataFrame) -> DataFrame:
    """path, tag, low, high (behind the closing tag) of the elements of components, by sums of depth for each tag name.

    An element opens at the depth that its end closes; in order of depth, and then of place, the two are neighbours.
    """
    rows = found(facts, "markup", tag=1, shape=2)
    single = rows.where("shape = 'single'").select("path", "tag", F.col("pos").alias("low"), F.col("end").alias("high"), F.col("end").alias("head"))
    step = F.when(F.col("shape") == "open", 1).otherwise(-1)
    order = Window.partitionBy("path", "tag").orderBy("pos")
    rows = rows.where("shape <> 'single'").withColumn("total", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("level", F.when(F.col("shape") == "open", F.col("total")).otherwise(F.col("total") + 1))
    level = Window.partitionBy("path", "tag", "level").orderBy("pos")
    paired = rows.withColumn("next", F.lead(F.struct("shape", "end")).over(level)).where("shape = 'open'")
    # an element that nothing closes is its own opening tag
    high = F.when(F.col("next.shape") == "close", F.col("next.end")).otherwise(F.col("end"))
    return single.unionByName(paired.select("path", "tag", F.col("pos").alias("low"), high.alias("high"), F.col("end").alias("head")))


def router_routes(facts: DataFrame) -> DataFrame:
    """path, ord, route, component, kind, parent (of layouts: the components of the routes around it, outermost first) of routes that are
    written as nested markup, as nested records or as constructor calls.

    A route's path goes on from that of the route around it, unless it begins with a slash; routes without a path (index and
    layout routes) have that of the one around them.
    """
    given = found(facts, "attribute", tag=1, name=2, value=3).where("tag = 'Route'")
    literal = F.regexp_extract("value", r"""^\{?\s*['"`]([^'"`]*)['"`]\s*\}?$""", 1)
    shown = F.nullif(F.regexp_extract("value", r"^\{\s*<?\s*([A-Z]\w*)", 1), F.lit(""))
    heads = given.groupBy("path", F.col("pos").alias("low")).agg(F.max(F.when(F.col("name") == "path", literal)).alias("own"), F.max(F.when(F.col("name").isin("element", "component", "Component"), shown)).alias("component"), F.max((F.col("name") == "index").cast("int")).alias("index"))
    elements = markup_spans(facts).where("tag = 'Route'").join(heads, ["path", "low"], "left")
    records = _records(facts)
    rows = _union([elements.select("path", "low", "high", "own", "component", F.lit("jsx").alias("kind")), records.withColumn("kind", F.lit("record"))])
    around = rows.select("path", F.struct("low").alias("up"), "low", "high")
    inner = R.innermost(rows.withColumn("pos", F.col("low") - 1), around, "path", name="up")
    part = lambda c: F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    # a component hands itself down as a layout; an absolute path begins anew, which a leading `/` tells
    nodes = inner.select("path", "low", F.col("path").alias("up_path"), F.col("up.low").alias("up_low"), part(F.col("own")).alias("parts"), part(F.col("component")).alias("shown"), "own", "component", "kind")
    whole = composed(nodes, ["path", "low"], ["up_path", "up_low"], ["parts", "shown"]).join(nodes.select("path", "low", "own", "component", "kind"), ["path", "low"])
    joined = F.aggregate("parts", F.lit(""), lambda acc, x: F.when(F.startswith(x, F.lit("/")), x).otherwise(F.concat(acc, F.lit("/"), x)))
    spelled = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), joined), "/+", "/"), "(.)/$", "$1")
    written = whole.where("component is not null").select("path", F.col("low").alias("ord"), spelled.alias("route"), "component", "kind", F.slice("shown", F.lit(1), F.size("shown") - 1).alias("parents"))
    none = F.array().cast("array<string>").alias("parents")
    plain = lambda c: F.when(F.startswith(c, F.lit("/")), F.col(c)).otherwise(F.concat(F.lit("/"), F.coalesce(c, F.lit(""))))
    overlay = found(facts, "route-overlay", route=1, component=2).where(F.lower("path").contains("overlay")).select("path", "ord", plain("route").alias("route"), "component", F.lit("overlay").alias("kind"), none)
    dart = found(facts, "route-dart", route=1, component=2).select("path", "ord", plain("route").alias("route"), "component", F.lit("dart").alias("kind"), none)
    # a layout's own row and its index route may spell one path: the inner one shows it
    best = written.groupBy("path", "route", "kind").agg(F.max_by(F.struct("ord", "component", "parents"), F.struct(F.size("parents"), -F.col("ord"))).alias("x")).select("path", "x.ord", "route", "x.component", "kind", "x.parents")
    return _union([best, overlay, dart])


def _records(facts: DataFrame) -> DataFrame:
    """path, low, high, own (path), component of objects that have a `path`: from its brace to the partner."""
    braces = found(facts, "object", x=1).select("path", F.struct(F.col("pos").alias("low"), F.col("end").alias("high")).alias("object"), F.col("pos").alias("low"), F.col("end").alias("high"))
    named = R.innermost(found(facts, "route-record", own=1).select("path", "pos", F.coalesce("own", F.lit("")).alias("own")), braces, "path", name="object").where("object is not null")
    shown = R.innermost(found(facts, "route-shown", component=1).select("path", "pos", "component"), braces, "path", name="object").where("object is not null")
    of = shown.groupBy("path", "object").agg(F.min_by("component", "pos").alias("component"))
    rows = named.groupBy("path", "object").agg(F.min_by("own", "pos").alias("own")).join(of, ["path", "object"], "left")
    return rows.select("path", "object.low", "object.high", "own", "component")


def navigations(facts: DataFrame) -> DataFrame:
    """path, target: where the code of a file leads to.

    `x.push('/a')` counts where the last declaration of x before it, in the file, makes a router (or x is called router and
    isn't declared there): other objects have a push too.
    """
    rows = found(facts, "navigate", plain=1, receiver=2, target=3).select("path", "pos", "plain", "receiver", "target")
    made = found(facts, "navigate-from", receiver=1, maker=2).select("path", "receiver", F.col("pos").alias("at"), "maker")
    bound = R.as_of(rows.where("receiver is not null"), made, ["path", "receiver"], "pos", "at", ["maker"])
    router = F.coalesce(F.col("maker").rlike("(?i)router$|^useNavigate$"), F.col("receiver").rlike("^router$|Router$"))
    script = rows.where("receiver is null").select("path", "target").unionByName(bound.where(router).select("path", "target"))
    return script.unionByName(found(facts, "navigate-dart", target=1).select("path", "target")).distinct()


# Where a prop's value may come from; of several sites the highest counts.
PROP_RANKS = {"forward": 6, "state": 5, "store": 4, "handler": 3, "computed": 2, "literal": 1, "spread": 0}


def prop_sites(facts: DataFrame) -> DataFrame:
    """path, pos, tag, ord, name, source of each prop that a component's tag is given."""
    props = found(facts, "attribute", tag=1, name=2, value=3, rest=4).where("name is not null or rest is not null").select("path", "pos", "ord", "tag", "name", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("rest", F.lit("")).alias("rest"))
    bare = F.trim(F.regexp_replace("value", r"^\{|\}$", ""))
    props = props.withColumn("bare", bare).withColumn("root", F.regexp_extract("bare", r"^([A-Za-z_$][\w$]*)", 1))
    # a name means what its own component declares, not what another one in the file calls so
    scopes = functions(facts).where(F.col("name").rlike("^[A-Z]")).select("path", F.col("low").alias("scope"), "low", "high")
    scoped = lambda df: R.innermost(df, scopes, "path", name="scope").withColumn("scope", F.coalesce("scope", F.lit(-1)))
    marked = lambda df, mark: scoped(df).select("path", "scope", "root", F.lit(True).alias(mark)).distinct()
    given = found(facts, "given", list=1).select("path", "pos", F.explode(F.split("list", r"\s*,\s*")).alias("root")).select("path", "pos", F.regexp_extract("root", r"(\w+)", 1).alias("root"))
    props = scoped(props)
    for df in (marked(found(facts, "state", root=1).select("path", "pos", "root"), "state"), marked(found(facts, "held", root=1).select("path", "pos", "root"), "store"), marked(given, "given")):
        props = props.join(df, ["path", "scope", "root"], "left")
    plain = F.col("value").rlike("^[\"']") | F.col("bare").rlike(r"^(true|false|null|-?[0-9.]+|'[^']*+'|\"[^\"]*+\"|`[^`$]*+`)$") | (F.col("value") == "")
    source = (
        F.when(F.col("rest") != "", "spread").when(plain, "literal").when(F.col("name").rlike("^on[A-Z]") | F.contains("bare", F.lit("=>")), "handler")
        .when((F.col("root") == "props") | (F.col("given") & (F.col("bare") == F.col("root"))), "forward").when(F.col("state") & (F.col("bare") == F.col("root")), "state").when(F.col("store"), "store").otherwise("computed")
    )
    return props.select("path", "pos", "tag", "ord", F.when(F.col("rest") != "", F.concat(F.lit("..."), "rest")).otherwise(F.col("name")).alias("name"), source.alias("source"))


def commands(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Go command-line commands: (path, command, use) and (path, parent, command) edges between their variables."""
    made = found(facts, "command", command=1, use=2).select("path", "command", "use")
    added = found(facts, "command-add", parent=1, list=2)
    edges = added.select("path", "parent", F.explode(F.split("list", r"\s*,\s*")).alias("command")).select("path", "parent", F.regexp_extract("command", r"(\w+)(?:\(\))?$", 1).alias("command"))
    return made, edges
