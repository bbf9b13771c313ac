"""Toxicity by a subsequence string kernel with Nystrom landmarks, in a support vector machine trained on labelled sentences.

Words are folded (case, accents, digits and signs that stand for letters, whatever is put between letters), letters that stand
alone in a row are joined, and words of more than LONGEST letters are read in overlapping windows. The kernel of two words
sums over the subsequences of ORDERS letters that they have in common, weighted by DECAY for each letter passed over in either, and is
scaled to one for equal words. So a gap or an inserted character lowers a value instead of hiding the word.

The machine is linear in the kernel values to LANDMARKS words (half of them those that toxic sentences have beyond clean ones,
the others frequent in clean ones), whitened by the landmarks' own kernel matrix. Sentences inherit the label of their document.
The machine is fitted to words that stand out in toxic sentences (and to the first of these with an unknown character put in) against all
words of clean sentences, then again to the words that witness for each toxic sentence. Its value for a word is a sum of fixed weights over the word's
subsequences, so tasks look weights up (one table of 12 MB, whatever the corpus) and compare with no landmark. A document's highest
values and counts become its score by logistic regression on labelled documents.

Only the fitting is on a sample: DOCUMENTS labelled documents, equal shares of both labels where there are as many, and
SENTENCES distinct sentences of these, chosen by hash. All rows are scored, by their whole texts.

Defined results: null and empty texts, and texts without a word of ORDERS[0] letters, score as a document in which nothing is
found; rows without an id are held out and teach nothing; of several labels of an id the highest counts, null labels are none;
a sentence or text that is repeated teaches once; with labels of one kind every score is 0 or 1 as they are, without labels 0;
repeated rows score alike; a very long text is read word by word (its distinct words are held, as long as it is read); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import flat, slices, written

DOCUMENTS, SENTENCES, FOLDS, HELD, THRESHOLD = 8192, 32768, 3, 1, 0.7
LANDMARKS, DECAY, LONGEST, BOUND, PENALTY = 256, 0.7, 16, 64, 3e-4
#: Standard errors by which a word must stand out, and documents in which it must stand, to teach before there are witnesses.
CERTAIN, APART = 2.0, 3
#: How many times as often as in clean sentences a word must stand in toxic ones to teach or witness.
TIMES = 6.0
#: Stands for any character.
PUT_IN = "\ufffd"
#: Values above which a document's words are counted.
LEVELS = (0.3, 0.7, 0.9)
FEATURES = 4 + len(LEVELS)
#: Lengths of subsequences.
ORDERS = (3, 4)
#: Words that a task remembers; bytes of text and texts that are scored at once.
REMEMBERED, STEP, ROWS = 1 << 20, 1 << 20, 4096
#: Letters that have a number of their own: the commonest of the landmarks. Others match nothing.
LETTERS = 40
#: Digits and signs that stand for letters inside words.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "ß": "ss"}
_STANDS = str.maketrans(STANDS_FOR)
_EDGES = re.compile(r"^[^\w]+|[^\w]+$")
_ALONE = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]?\s+){2,}[^\W\d_][^\w\s]?(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n")


def fold(word: str) -> str:
    """The letters of a word, in lower case and without accents; digits and signs inside it as the letters they stand for."""
    word = word.lower()
    if word.isascii() and word.isalpha():
        return word
    word = unicodedata.normalize("NFKD", _EDGES.sub("", word))
    if any(c.isalpha() for c in word):
        word = word.translate(_STANDS)
    return "".join(c for c in word if c.isalpha())


def tokens(text: str) -> set[str]:
    """The distinct words of a text as they are written, and its runs of single letters."""
    found = set(text.split())
    found.update(m.group() for m in _ALONE.finditer(text))
    return found


def windows(word: str, longest: int = LONGEST) -> list[str]:
    if len(word) <= longest:
        return [word] if len(word) >= ORDERS[0] else []
    return [word[i : i + longest] for i in range(0, len(word) - longest // 2, longest // 2)]


def units(text: str) -> list[str]:
    """The distinct folded words (and windows of long ones) of a text, sorted."""
    return sorted({w for x in tokens(text) for w in windows(fold(x))})


def sentences(text: str) -> Iterator[str]:
    """One at a time, by a lazy match iterator."""
    at = 0
    for match in _SENTENCE.finditer(text):
        yield text[at : match.start()]
        at = match.end()
    yield text[at:]


def self_kernels(points: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself. points: words of one length, a row of code points each.

    ends[i, j] sums the common subsequences that end at places i and j; products with the triangular matrix of DECAY's powers
    carry it on to all later places.
    """
    n = points.shape[1]
    power = np.tril(np.float32(DECAY) ** np.maximum(np.subtract.outer(np.arange(n), np.arange(n)), 0).astype(np.float32))
    equal = (points[:, :, None] == points[:, None, :]).astype(np.float32)
    ends, total = equal, np.zeros(len(points), np.float32)
    for order in range(2, min(ORDERS[-1], n) + 1):
        carried = np.matmul(power, ends) @ power.T
        ends = np.zeros_like(equal)
        ends[:, 1:, 1:] = equal[:, 1:, 1:] * carried[:, :-1, :-1]
        if order in ORDERS:
            total += ends.sum(axis=(1, 2))
    return total


def _places(n: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each order: the places of all subsequences of a word of n letters, their weights, and where the order's numbers begin."""
    out, base = [], 0
    for order in ORDERS:
        if order <= n:
            at = np.array(list(combinations(range(n), order)))
            out.append((at, (DECAY ** (at[:, -1] - at[:, 0] + 1 - order)).astype(np.float32), base))
        base += (LETTERS + 1) ** order
    return out


PLACES = {n: _places(n) for n in range(ORDERS[0], LONGEST + 1)}
NUMBERS = sum((LETTERS + 1) ** order for order in ORDERS)


class Letters:
    """Numbers words' letters, 0 for those that are not known."""

    def __init__(self, alphabet: str):
        self.known = np.array(sorted(map(ord, alphabet)), np.uint32)

    def subsequences(self, words: list[str], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For words of equal length at a time: which words, the number of each subsequence (a row for each word), and weights.

        Weights are divided by the root of the word's kernel with itself.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            points = np.frombuffer("".join(words[i] for i in own.tolist()).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
            place = np.searchsorted(self.known, points).clip(max=max(0, len(self.known) - 1))
            codes = np.where(self.known[place] == points, place + 1, 0).astype(np.int32) if len(self.known) else np.zeros(points.shape, np.int32)
            step = max(1, most // sum(len(at) for at, _, _ in PLACES[n]))
            for low in range(0, len(own), step):
                some = codes[low : low + step]
                scale = 1 / np.sqrt(np.maximum(self_kernels(points[low : low + step]), 1e-12))
                keys, weights = [], []
                for at, weight, base in PLACES[n]:
                    key = some[:, at[:, 0]]
                    for k in range(1, at.shape[1]):
                        key = key * (LETTERS + 1) + some[:, at[:, k]]
                    keys.append(key + base)
                    weights.append(weight)
                yield own[low : low + step], np.hstack(keys), np.concatenate(weights), scale


@dataclass
class Kernel:
    """The landmarks' subsequences as columns; values() gives kernels of words with all landmarks."""

    landmarks: list[str]
    alphabet: str

    @classmethod
    def of(cls, landmarks: list[str]) -> Kernel:
        counts: dict[str, int] = {}
        for word in landmarks:
            for c in word:
                counts[c] = counts.get(c, 0) + 1
        return cls(landmarks, "".join(sorted(counts, key=lambda c: (-counts[c], c))[:LETTERS]))

    def __post_init__(self) -> None:
        self.letters = Letters(self.alphabet)
        own, keys, weights = [], [], []
        for which, key, weight, scale in self.letters.subsequences(self.landmarks):
            own.append(np.repeat(which, key.shape[1]))
            keys.append(key.ravel())
            weights.append((scale[:, None] * weight).ravel())
        self.keys, column = np.unique(np.concatenate(keys), return_inverse=True)
        self.table = np.zeros((len(self.keys) + 1, len(self.landmarks)), np.float32)
        np.add.at(self.table, (column + 1, np.concatenate(own)), np.concatenate(weights))
        self.column = np.zeros(NUMBERS, np.int32)
        self.column[self.keys] = np.arange(1, len(self.keys) + 1)

    def values(self, words: list[str]) -> np.ndarray:
        """A row for each word, a column for each landmark."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for which, key, weight, scale in self.letters.subsequences(words, 1 << 18):
            found = np.zeros((len(which), len(self.table)), np.float32)
            column = self.column[key]
            row, at = np.nonzero(column)
            np.add.at(found, (row, column[row, at]), weight[at])
            out[which] = (found @ self.table) * scale[:, None]
        return out


def fit_machine(x: np.ndarray, good: np.ndarray, bad: np.ndarray, penalty: float = PENALTY, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the bias of a linear machine with squared hinge loss, by Newton steps over the rows inside the margin.

    good, bad: how much each row counts on either side; both sides weigh the same.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    good, bad = good / max(good.sum(), 1e-9) / 2, bad / max(bad.sum(), 1e-9) / 2
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-9])
    w, before = np.zeros(x.shape[1]), None
    for _ in range(rounds):
        f = x @ w
        up, down = np.where(f < 1, good, 0), np.where(f > -1, bad, 0)
        w = np.linalg.solve((x * (up + down)[:, None]).T @ x + ridge, x.T @ (up - down))
        now = (up > 0, down > 0)
        if before is not None and all((a == b).all() for a, b in zip(now, before, strict=True)):
            break
        before = now
    return w


def excess(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int) -> np.ndarray:
    """By how many standard errors the share of toxic sentences with a word is above that of clean ones."""
    p, q = (good + 0.5) / (n_good + 1), (bad + 0.5) / (n_bad + 1)
    return (p - q) / np.sqrt(p / n_good + q / n_bad)


def choose_landmarks(words: list[str], gain: np.ndarray, bad: np.ndarray, n: int = LANDMARKS) -> list[str]:
    """Half of them those that toxic documents have most often beyond clean ones, the others frequent words of clean documents.

    gain: excess(); bad: how many clean documents have each word.
    """
    taken: list[str] = []
    for order, upto in ((np.argsort(-gain, kind="stable"), n // 2), (np.argsort(-bad, kind="stable"), n)):
        for i in order[: 8 * n].tolist():
            if len(taken) >= upto:
                break
            if words[i] not in taken:
                taken.append(words[i])
    return taken


class Machine:
    """weights: by the number of a subsequence; bias; pooled: how a document's values become its score."""

    def __init__(self, bags: list[tuple[bool, int, list[str]]], rounds: int = 1):
        """bags: label, document and words of sentences."""
        words = sorted({w for _, _, ws in bags for w in ws})
        number = {w: i for i, w in enumerate(words)}
        own = np.concatenate([np.array([number[w] for w in ws], np.int64) for _, _, ws in bags])
        bag = np.repeat(np.arange(len(bags)), [len(ws) for _, _, ws in bags])
        toxic = np.array([b[0] for b in bags])
        document = np.unique([b[1] for b in bags], return_inverse=True)[1]
        good, bad = (np.bincount(own[toxic[bag] == k], minlength=len(words)) for k in (True, False))
        apart = np.bincount(np.unique(np.stack([own, document[bag]]), axis=1)[0], minlength=len(words))
        sizes = max(1, toxic.sum()), max(1, (~toxic).sum())
        more = (good + 0.5) / sizes[0] >= TIMES * (bad + 0.5) / sizes[1]
        gain = np.where(more & (apart >= APART), excess(good, bad, *sizes), 0)
        kernel = Kernel.of(choose_landmarks(words, gain, bad))
        x = kernel.values(words)
        size, axes = np.linalg.eigh(kernel.values(kernel.landmarks).astype(np.float64))
        whiten = (axes / np.sqrt(np.maximum(size, 1e-3))).astype(np.float32)
        x = x @ whiten
        rare = np.sqrt(bad)  # rare words of clean sentences are many, and should be heard beside the frequent ones
        certain = np.where(gain > CERTAIN, np.sqrt(good), 0) if (gain > CERTAIN).any() else good.astype(float)
        # those that stand out most count half as much again with a character put in
        most = max(CERTAIN, gain.max() / 2)
        put_in = [(w[:i] + PUT_IN + w[i:], 0.5 * certain[k] / (len(w) - 1)) for k, w in enumerate(words) if gain[k] > most and 4 < len(w) < LONGEST for i in range(1, len(w))]
        x = np.vstack([x, kernel.values([w for w, _ in put_in]) @ whiten])
        extra, none = np.array([v for _, v in put_in]), np.zeros(len(put_in))
        w = fit_machine(x, np.append(certain, extra), np.append(rare, none))
        for _ in range(rounds):
            value = x[: len(words)] @ w[:-1] + w[-1]
            best = np.full(len(bags), -np.inf)
            np.maximum.at(best, bag, value[own])
            # a toxic sentence's highest word witnesses, if it is on the toxic side and no word that clean documents have as often
            witness = toxic[bag] & (value[own] == best[bag]) & (best[bag] > 0) & (gain[own] > 0)
            if witness.any():
                w = fit_machine(x, np.append(np.sqrt(np.bincount(own[witness], minlength=len(words))), extra), np.append(rare, none))
        alpha = whiten @ w[:-1]
        self.letters, self.bias = kernel.letters, float(w[-1])
        self.weights = np.zeros(NUMBERS, np.float32)
        self.weights[kernel.keys] = kernel.table[1:] @ alpha
        self.pooled, self.constant = np.zeros(FEATURES), 0.0

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value for each folded word."""
        out = np.zeros(len(words))
        for which, key, weight, scale in self.letters.subsequences(words):
            out[which] = (self.weights[key] @ weight) * scale
        return out + self.bias

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.pooled + self.constant, -30, 30)))

    def pool(self, features: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 50) -> None:
        """Fit the logistic regression by Newton steps."""
        x = np.hstack([features, np.ones((len(features), 1))])
        w, ridge = np.zeros(x.shape[1]), np.diag([1e-2] * features.shape[1] + [1e-6]) * weight.sum() / len(weight)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (toxic - p)) - ridge @ w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.pooled, self.constant = w[:-1], float(w[-1])


class Reader:
    """Reads documents for a machine; remembers the values of words. One for a task; its memory is bounded."""

    def __init__(self, machine: Machine, remembered: int = REMEMBERED):
        self.machine, self.remembered = machine, remembered
        self.known: dict[str, float] = {}

    def _learn(self, new: list[str]) -> None:
        for low in range(0, len(new), 4096):
            some = new[low : low + 4096]
            folded = [windows(fold(x)) for x in some]
            values = self.machine.values([w for ws in folded for w in ws])
            at = 0
            for x, ws in zip(some, folded, strict=True):
                self.known[x] = float(values[at : at + len(ws)].max()) if ws else -1.0
                at += len(ws)

    def features(self, texts: list[str]) -> np.ndarray:
        """The three highest values of each text's distinct words (-1 where there are fewer), and logarithms: of how many words lie
        above each of LEVELS, and of how many there are."""
        if len(self.known) > self.remembered:
            self.known.clear()
        found = [tokens(x) for x in texts]
        self._learn(list({w for ws in found for w in ws if w not in self.known}))
        out = np.full((len(texts), FEATURES), -1.0)
        for i, ws in enumerate(found):
            values = np.fromiter((self.known[w] for w in ws), np.float64, len(ws))
            top = np.sort(np.partition(values, -3)[-3:] if len(values) > 3 else values)[::-1]
            out[i, : len(top)] = top
            out[i, 3:] = np.log1p([*((values > level).sum() for level in LEVELS), len(ws)])
        return np.clip(out, -1, [1.0] * 3 + [30.0] * (FEATURES - 3))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(FOLDS)) == HELD, F.lit(True))
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), held.alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, documents: int) -> tuple[DataFrame, dict[bool, int]]:
    """doc_id, toxic, text of the labelled documents that teach, and how many there are of each label (before the choice)."""
    marks = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), (F.col(f"`{label_col}`") > 0).alias("toxic")).where("doc_id is not null and toxic is not null")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD)
    marks = written(marks, "toxic-labels")
    sizes = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = lambda toxic: marks.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents // 2)
    chosen = written(part(True).unionByName(part(False)), "toxic-chosen")
    # `documents` ids at most, so they may be broadcast
    found = _rows(docs, id_col, text_col).where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    return written(found, "toxic-sample"), sizes


def _bags(sample: DataFrame, most: int) -> list[tuple[bool, int, list[str]]]:
    """Labelled sentences as their distinct words: a quarter of them toxic at most. Long sentences are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, toxic, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                held: list[list[str]] = []
                for sentence in (*sentences(text.as_py()), None):
                    found = units(sentence) if sentence else []
                    held += [found[i : i + BOUND] for i in range(0, len(found), BOUND)]
                    if held and (sentence is None or len(held) > 1024):
                        yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(held), pa.int64()), pa.array([toxic.as_py()] * len(held)), pa.array(held, pa.list_(pa.string()))], ["doc_id", "toxic", "words"])
                        held = []

    found = sample.mapInArrow(run, "doc_id bigint, toxic boolean, words array<string>")
    distinct = written(found.groupBy("toxic", "words").agg(F.min("doc_id").alias("doc_id")), "toxic-sentences")
    part = lambda toxic, n: distinct.where(F.col("toxic") == toxic).orderBy(F.xxhash64("words"), "words").limit(n)
    # in one order, so that a fit doesn't depend on how rows were dealt
    return sorted((r.toxic, r.doc_id, r.words) for r in part(True, most // 4).unionByName(part(False, most - most // 4)).collect())


def _read(rows: DataFrame, machine: Machine, schema: str, out) -> DataFrame:
    """Rows (two columns, then the text) with what `out` makes of a slice's features."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            _, begins = flat(batch.column(2))
            for low, high in slices(begins, STEP, ROWS):
                part = batch.slice(low, high - low)
                features = reader.features([x or "" for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *out(shared.value, features)], names)

    names = [field.strip().split(" ")[0] for field in schema.split(",")]
    return rows.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", documents: int = DOCUMENTS, most: int = SENTENCES) -> Machine | float:
    """The machine; where labels are of one kind, the score of all texts."""
    sample, sizes = _sample(docs, labels, id_col, text_col, label_col, documents)
    bags = _bags(sample, most)
    if len({toxic for toxic, _, _ in bags}) < 2:
        return 1.0 if sizes.get(True, 0) and not sizes.get(False, 0) else 0.0
    machine = Machine(bags)
    features = lambda _, x: [pa.array(list(x), pa.list_(pa.float64()))]
    seen = _read(sample.select("toxic", F.xxhash64("text").alias("own"), "text"), machine, "toxic boolean, own bigint, x array<double>", features)
    rows = sorted(seen.groupBy("toxic", "own").agg(F.min("x").alias("x")).collect())  # `documents` rows at most
    toxic = np.array([r.toxic for r in rows])
    weight = np.array([sizes[t] / (toxic == t).sum() for t in toxic.tolist()])
    machine.pool(np.array([r.x for r in rows]), toxic.astype(float), weight)
    return machine


def score(docs: DataFrame, machine: Machine | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = _rows(docs, id_col, text_col)
    if isinstance(machine, Machine):
        found = _read(rows, machine, "doc_id bigint, held_out boolean, score double", lambda m, x: [pa.array(m.score(x))])
    else:
        found = rows.select("doc_id", "held_out", F.lit(machine).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
