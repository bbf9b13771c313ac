"""Fill-in-the-middle: texts are cut into units at two seeded ranks, and their middles go last.

A streaming matcher goes over a text twice. The first pass counts the units that a pattern matches; the second takes matches
from a lazy iterator up to the smaller and then to the larger rank, and remembers two offsets. No list of units is ever made,
so a text of any length needs its own bytes and those of its output, and no more.

Ranks and form come from the SHA-256 of `seed:id`, so a row's result depends on nothing but the row, and a task that runs again
gives the same. `restore` builds the text from output and form.

Defined results: null and empty texts are plain and give an empty text; so is every text that holds a marker; a text of one unit
may have an empty prefix, middle or suffix; a very long text is one row as any other; repeated rows give repeated results; null
ids are hashed as an empty id; an empty table gives no rows; columns of the input are kept, but for those that are made here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm.common import flat, slices

LINE, SEED, RATE, SPM = r"[^\n]*\n|[^\n]+", 7, 100, 50
#: Prefix, suffix, middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Bytes of text whose outputs are held at once.
STEP = 1 << 22
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def check_markers(markers: tuple[str, str, str]) -> None:
    """Raises unless the markers can be told apart wherever they stand: none may begin as one ends, or hold another."""
    if len(set(markers)) < 3 or not all(markers):
        raise ValueError("three different markers are needed")
    for a in markers:
        for b in markers:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {a!r} and {b!r} overlap")


def hashed(seed: int, id_: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, unit: re.Pattern, low: int, high: int) -> tuple[int, int]:
    """Where the units of the smaller and of the larger rank end, by one lazy pass over the matches."""
    matches = unit.finditer(text)
    first = 0
    for match in islice(matches, low):
        first = match.end()
    second = first
    for match in islice(matches, high - low):
        second = match.end()
    return first, second


def transform(text: str, id_: int | None, unit: re.Pattern, markers: tuple[str, str, str], seed: int, rate: int, spm: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output of a text."""
    n = sum(1 for _ in unit.finditer(text))
    h1, h2, h3, h4 = hashed(seed, id_)
    if not text or h3 % 100 >= rate or any(m in text for m in markers):
        return n, "plain", None, None, text
    ranks = h1 % (n + 1), h2 % (n + 1)
    first, second = cut(text, unit, min(ranks), max(ranks))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    p, s, m = markers
    if h4 % 100 < spm:
        return n, "spm", first, second - first, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", first, second - first, "".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, markers: tuple[str, str, str] = MARKERS, seed: int = SEED, rate: int = RATE, spm: int = SPM
) -> DataFrame:
    """The rows of docs (without the text) with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    rate: of 100 texts so many aren't plain; spm: of 100 of these so many begin with the suffix. The pattern's matches must
    follow each other without gaps, or what lies between two units goes with the later one.
    """
    check_markers(markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            _, begins = flat(texts)
            for low, high in slices(begins, STEP):
                found = [transform(t.as_py() or "", i.as_py(), pattern, markers, seed, rate, spm) for i, t in zip(ids.slice(low, high - low), texts.slice(low, high - low), strict=True)]
                n, form, prefix, middle, output = zip(*found, strict=True)
                made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(low, high - low), *made], ["kept", *MADE])

    others = [c for c in docs.columns if c != text_col and c not in MADE]
    # the other columns travel as one struct, under names of their own, so that none can clash
    kept = F.struct(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others))) if others else F.struct(F.lit(0).alias("c0"))
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"), kept.alias("kept"))
    schema = StructType([rows.schema["kept"]]).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(others)), *MADE)


def restore(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of."""
    pieces = F.split(output, "|".join(map(re.escape, markers)), 4)
    first, second, middle = (F.get(pieces, F.lit(i)) for i in (1, 2, 3))
    return F.when(F.col(form) == "psm", F.concat(first, middle, second)).when(F.col(form) == "spm", F.concat(second, middle, first)).otherwise(F.col(output))
