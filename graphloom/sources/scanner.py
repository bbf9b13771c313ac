"""Comments, strings and brackets of source files, found in one pass over each text, without changing a position.

A small table of patterns for each language says what may begin at a place: comments (nested ones where the language nests
them), plain, raw and triple strings, characters beside lifetimes, template strings whose `${...}` is code again, regular
expressions. Texts keep their length and their newlines, so positions and lines found in one form hold in all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

LANGUAGES = {"ts": "script", "tsx": "script", "js": "script", "jsx": "script", "vue": "vue", "go": "go", "dart": "dart", "rs": "rust"}

_LINE = r"(?P<line>//[^\n]*)"
_BLOCK = r"(?P<block>/\*(?s:.*?)(?:\*/|\Z))"
_NEST = r"(?P<nest>/\*)"
_RUNE = r"(?P<rune>'(?:\\(?:u\{[0-9a-fA-F]*\}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)|[^'\\\n])')"
#: A quote that isn't closed on its line, or stands in a word, begins no string: it is an apostrophe in markup.
_ONE_LINE = r"""(?P<plain>"(?:[^"\\\n]++|\\(?s:.))*+"|(?:(?<!\w)|(?<=\bfrom)|(?<=\bimport)|(?<=\breturn)|(?<=\bcase))'(?:[^'\\\n]++|\\(?s:.))*+')"""
_REGEX = r"(?P<regex>(?<![\w)\]}\"'`$.<])(?<![\w)\]}\"'`$] )/(?![/*>])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*)"
#: What may begin in code. Where a string holds code again, only its beginning is matched.
_BEGINS = {
    "script": re.compile("|".join((r"(?P<line>(?<!:)//[^\n]*)", _BLOCK, _ONE_LINE, r"(?P<open>`)", _REGEX))),
    "vue": re.compile("|".join((r"(?P<markup><!--(?s:.*?)(?:-->|\Z))", r"(?P<line>(?<!:)//[^\n]*)", _BLOCK, _ONE_LINE, r"(?P<open>`)", _REGEX))),
    "go": re.compile("|".join((_LINE, _BLOCK, r'(?P<plain>"(?:[^"\\]++|\\(?s:.)?+)*+(?:"|\Z)|`[^`]*+(?:`|\Z))', _RUNE))),
    "dart": re.compile("|".join((_LINE, _NEST, r"""(?P<plain>\br(?:'''(?s:.*?)(?:'''|\Z)|\"\"\"(?s:.*?)(?:\"\"\"|\Z)|'[^'\n]*'|"[^"\n]*"))""", r"""(?P<open>'''|\"\"\"|'|")"""))),
    "rust": re.compile("|".join((_LINE, _NEST, r"""(?P<plain>\bb?r(?P<marks>#*)"(?s:.*?)(?:"(?P=marks)|\Z)|\bb?"(?:[^"\\]++|\\(?s:.)?+)*+(?:"|\Z)|"(?:[^"\\]++|\\(?s:.)?+)*+(?:"|\Z))""", _RUNE))),
}
_COMMENTS = ("line", "block", "nest", "markup")
_NESTED = re.compile(r"/\*|\*/")
#: What ends a string that may hold code, by its first characters: the end, or code that begins in it.
_INSIDE = {q: re.compile(rf"\\(?s:.)|(?P<code>\$\{{)|(?P<end>{re.escape(q)}" + (r"|\n" if len(q) == 1 and q != "`" else "") + ")") for q in ("`", "'", '"', "'''", '"""')}
_BRACE = re.compile(r"[{}]")


def noise(text: str, language: str) -> list[tuple[int, int, bool]]:
    """(begin, end, is a comment) of all comments and strings, in order; code inside of strings isn't part of them."""
    begins, out, at, n = _BEGINS[language], [], 0, len(text)
    #: strings that are open around the place: their quotes, and how many braces are open in their code
    around: list[list] = []

    def string_from(begin: int, place: int, quote: str) -> int:
        """Goes on in a string; where code begins in it, or it ends, gives the place behind."""
        while match := _INSIDE[quote].search(text, place):
            place = match.end()
            if match["code"]:
                out.append((begin, place, False))
                around.append([quote, 0])
                return place
            if match["end"]:
                out.append((begin, place - (match["end"] == "\n"), False))
                return place
        out.append((begin, n, False))
        return n

    while at < n:
        match = begins.search(text, at)
        stop = match.start() if match else n
        if around:  # braces up to there: does the string's code end?
            for brace in _BRACE.finditer(text, at, stop):
                around[-1][1] += 1 if brace.group() == "{" else -1
                if around[-1][1] < 0:
                    quote, _ = around.pop()
                    at = string_from(brace.start(), brace.end(), quote)
                    break
            else:
                brace = None
            if brace:
                continue
        if not match:
            break
        kind, begin, at = match.lastgroup if match.lastgroup != "marks" else "plain", match.start(), match.end()
        if kind == "open":
            at = string_from(begin, at, match.group())
        elif kind == "nest":
            depth = 1
            while depth and (inner := _NESTED.search(text, at)):
                depth += 1 if inner.group() == "/*" else -1
                at = inner.end()
            at = n if depth else at
            out.append((begin, at, True))
        else:
            out.append((begin, at, kind in _COMMENTS))
    return out


_VISIBLE = re.compile(r"[^\n]+")


def blank(text: str, spans: list[tuple[int, int, bool]], strings: bool) -> str:
    """The text with spaces in place of comments (and strings, if asked for)."""
    out, at = [], 0
    for begin, end, comment in spans:
        if comment or strings:
            out += [text[at:begin], _VISIBLE.sub(lambda m: " " * len(m.group()), text[begin:end])]
            at = end
    return "".join((*out, text[at:]))


#: Kinds of brackets, each matched for itself.
BRACKETS = ("{}", "()", "[]")


def pairs(bare: str) -> list[np.ndarray]:
    """For each kind of bracket the places of its pairs, as rows (open, close, depth) in order of `open`, by sums of depth.

    A bracket opens at the depth that its partner closes; in order of depth, and then of place, partners are neighbours.
    """
    points = np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), "<u4")
    out = []
    for opens, closes in BRACKETS:
        step = (points == ord(opens)).astype(np.int64) - (points == ord(closes))
        at = np.flatnonzero(step)
        step = step[at]
        total = np.cumsum(step)
        level = np.where(step > 0, total, total + 1)
        # a bracket that closes nothing lowers the ground for all that follow
        depth = level - np.minimum.accumulate(np.minimum(total, 0)) if len(total) else total
        order = np.lexsort((at, level))
        one, two = order[:-1], order[1:]
        match = (level[one] == level[two]) & (step[one] > 0) & (step[two] < 0)
        found = np.stack([at[one[match]], at[two[match]], depth[one[match]]], axis=1)
        out.append(found[np.argsort(found[:, 0])])
    return out


def scanned(sources: DataFrame) -> DataFrame:
    """sources with `code` (comments blanked), `bare` (strings too) and `error` (null, or why the file can't be read).

    A file that fails gives its error and empty texts; the others' rows stay.
    """
    kept = [f for f in sources.schema.fields if f.name not in ("code", "bare", "error")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ext, content = batch.column(names.index("ext")).to_pylist(), batch.column(names.index("content"))
            code, bare, error = [], [], []
            for kind, text in zip(ext, content, strict=True):
                one, two, why = "", "", None
                try:
                    text = text.as_py() or ""
                    if "\ufffd" in text:
                        raise ValueError("not UTF-8")
                    spans = noise(text, LANGUAGES[kind])
                    one, two = blank(text, spans, False), blank(text, spans, True)
                except Exception as failure:  # a row for it, whatever is wrong with the file
                    why = f"{type(failure).__name__}: {failure}" if str(failure) != "not UTF-8" else "not UTF-8"
                code.append(one)
                bare.append(two)
                error.append(why)
            made = [pa.array(x, pa.string()) for x in (code, bare, error)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, "code", "bare", "error"])

    schema = StructType(kept).add("code", "string").add("bare", "string").add("error", "string")
    return sources.select(*names).mapInArrow(run, schema)
