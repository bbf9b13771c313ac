"""Hierarchical language identification: first the family, then one-versus-one linear support vector machines within it.

Texts are hashed histograms of byte trigrams (letters lower-cased in ASCII, other ASCII characters as spaces). The machines
are fitted on the driver to about SAMPLE labelled texts (never over a quarter more), equal shares of the languages, chosen by a hash of the text; all
else happens in the tasks that read the texts. A family is predicted by one-versus-rest machines; within it every pair of
languages votes, and the margins break ties.

Defined results: null texts and texts without a letter get `und` with score 0; rows whose language is null teach nothing;
rows whose document id is null teach nothing and count as held out; with nothing to learn from every text gets `und`;
repeated rows get the same prediction; of more than SAMPLE / 2 languages the commonest ones are learnt; a very long text is one
histogram; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import flat, slices

UNKNOWN, SAMPLE, WIDTH, FOLDS = "und", 4096, 2048, 5
#: Bytes and texts whose histograms are held at once.
STEP, ROWS = 1 << 20, 1024
#: Families of language codes. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
}


def family_of(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language.split("-")[0] in codes), language)


def histograms(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Square roots of trigram counts by hash, scaled to length one: a row for each text."""
    n = len(begins) - 1
    low = raw | 32
    plain = np.where((raw < 128) & ((low < 97) | (low > 122)), 32, np.where(raw < 128, low, raw)).astype(np.uint32)
    text = np.repeat(np.arange(n), np.diff(begins))
    code = ((plain[:-2] << 16) | (plain[1:-1] << 8) | plain[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - (WIDTH - 1).bit_length())
    whole = text[:-2] == text[2:]
    out = np.bincount(text[:-2][whole] * WIDTH + code[whole], minlength=n * WIDTH).reshape(n, WIDTH)
    out = np.sqrt(out.astype(np.float32))
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)


def fit_machine(x: np.ndarray, sign: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights and, last, the bias of a linear machine with squared hinge loss; both sides weigh the same. Accelerated descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(x.dtype)
    rate, w, ahead = 1 / (2 * 2 + penalty), np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        slack = np.maximum(0, 1 - sign * (x @ ahead))
        new = ahead - rate * (penalty * ahead - 2 * x.T @ (share * sign * slack))
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


class Identifier:
    """families: one-versus-rest weights; pairs: for each family its languages and one-versus-one weights."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        own, names = np.array([family_of(v) for v in languages]), np.array(languages)
        self.families = sorted(set(own.tolist()))
        one = lambda inside, rows: fit_machine(x[rows], np.where(inside[rows], 1, -1).astype(x.dtype))
        everything = np.ones(len(names), bool)
        self.family_weights = np.array([one(own == f, everything) for f in self.families]).T if len(self.families) > 1 else None
        self.members = {f: sorted(set(names[own == f].tolist())) for f in self.families}
        self.pairs = {f: [(i, j, one(names == m[i], (names == m[i]) | (names == m[j]))) for i, j in combinations(range(len(m)), 2)] for f, m in self.members.items()}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        chance = lambda margin: 1 / (1 + np.exp(-4 * margin))
        family, score = np.zeros(len(x), int), np.ones(len(x))
        if self.family_weights is not None:
            margins = x @ self.family_weights
            family = margins.argmax(axis=1)
            score = chance(margins.max(axis=1))
        out = np.empty(len(x), object)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            members = self.members[name]
            votes, worst = np.zeros((len(rows), len(members))), np.ones((len(rows), len(members)))
            for i, j, w in self.pairs[name]:
                p = chance(x[rows] @ w)
                for side, q in ((i, p), (j, 1 - p)):
                    votes[:, side] += (q >= 0.5) + q / (2 * len(members))
                    worst[:, side] = np.minimum(worst[:, side], q)
            best = votes.argmax(axis=1)
            out[rows] = np.array(members, object)[best]
            score[rows] *= worst[np.arange(len(rows)), best]
        return out, np.clip(score, 0.0, 1.0)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == 0, F.lit(True))
    text = F.col(text_col)
    return docs.withColumns({"_doc": F.col(id_col).cast("bigint"), "_held": held, "_text": text, "_letter": F.coalesce(text.rlike(r"\p{L}"), F.lit(False))})


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Identifier | None:
    """Fit to about `sample` texts of rows that aren't held out. Languages of which there are more distinct texts than their
    share are thinned by a hash of the text; copies teach once, so that a large group of them can't fill the sample.
    """
    rows = _rows(docs, id_col, text_col).where(~F.col("_held") & F.col("_letter") & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col("_text").alias("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).orderBy(F.desc("n"), "lang").limit(sample // 2).collect()}
    if not counts:
        return None
    share = sample // len(counts)
    limits = F.lit(0.0)
    for lang, n in counts.items():
        limits = F.when(F.col("lang") == lang, F.lit(min(1.0, share / n))).otherwise(limits)
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begins = flat(batch.column(1))
            for low, high in slices(begins, STEP, ROWS):
                own = begins[low : high + 1]
                x = histograms(raw[own[0] : own[-1]], own - own[0]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    chosen = rows.where(place < limits).dropDuplicates().mapInArrow(features, "lang string, x binary").limit(sample + sample // 4).collect()
    if not chosen:
        return None
    return Identifier(np.array([np.frombuffer(bytes(r.x), np.float16) for r in chosen], np.float32), [r.lang for r in chosen])


def identify(docs: DataFrame, identifier: Identifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. The identifier's size grows with the languages, not with the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begins = flat(batch.column(2))
            letter = batch.column(3).to_numpy(zero_copy_only=False)
            names, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for low, high in slices(begins, STEP, ROWS) if identifier else ():
                own = begins[low : high + 1]
                names[low:high], scores[low:high] = identifier.predict(histograms(raw[own[0] : own[-1]], own - own[0]))
            names[~letter], scores[~letter] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names.tolist(), pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = _rows(docs, id_col, text_col).select("_doc", "_held", "_text", "_letter")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
