"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Every rule is a score in whole steps (higher is worse). For a stratum (a language) with n labelled good documents, a cutoff
may reject at most k of these, where k is the largest number with P(Binomial(n, risk) <= k) <= confidence share: then the
rate at which good documents of the stratum are rejected exceeds `risk` with no more than that probability (exact binomial
bound on the order statistic). `RISK` is divided among the rules, so that their union keeps it, and `DELTA` among all
(stratum, rule) pairs (Bonferroni). Among the cutoffs allowed, the one with the best difference between the shares of bad and
good documents rejected is used, and none where no cutoff gains; higher cutoffs only reject less, so the bound holds for the
choice too. A stratum whose own labels are too few for any cutoff has none: there the base rules alone reject, as cutoffs of
other strata would bound nothing for its documents.

Defined results: null text has no words and fails the base rules; null language is the stratum `und`; a document labelled
twice counts as bad if any label says so; labels without a document or with null quality are ignored; with no labels only the
base rules reject; repeated rows are judged alike; a very long text is one row, which holds its words
and windows as arrays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD_GAP, written

RISK, DELTA = 0.05, 0.05
SYMBOLS = r"[#*$%&|<>]"


def _scores() -> dict[str, Column]:
    """Whole steps keep the table of candidates bounded whatever the corpus holds."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    length = F.least(F.floor(100 * F.col("word_chars") / words), F.lit(5000))
    return {
        "symbols": F.floor(1000 * F.col("n_symbols") / chars),
        "dup_lines": F.floor(1000 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "repeats": F.floor(1000 * F.col("n_repeat_words") / words),
        "long_words": length,
        "short_words": -length,
    }


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, tag (tells apart rows that repeat an id), stratum and the counts of every row, and base_failed.

    All counts come from arrays within the row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.hash(text_col).alias("tag"), F.coalesce(F.col(stratum_col), F.lit("und")).alias("stratum"), text.alias("text"))
    rows = rows.select("*", F.array_remove(F.split("text", WORD_GAP), "").alias("words"), F.split("text", "\n").alias("lines"))
    rows = rows.select("*", F.size("words").alias("n"), F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full"))
    word = lambda i: F.get("words", i)
    hashes = F.when(F.col("n") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    rows = rows.select(
        "doc_id",
        "tag",
        "stratum",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("full").cast("long").alias("n_lines"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        hashes.alias("windows"),
    )
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(none)).drop("windows")
    same = lambda x, j: F.get("placed", j)["h"] == x["h"]
    rows = rows.withColumn("twice", F.sort_array(F.transform(F.filter("placed", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))).drop("placed")
    steps = F.transform("twice", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("twice", j + 1) - p, F.lit(3))))
    rows = rows.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("twice")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def most_rejections(strata: DataFrame, risk: float, share: Column) -> DataFrame:
    """stratum, most: the largest k with P(Binomial(n_good, risk) <= k) <= share; strata where k = 0 fails are left out."""
    terms = strata.select("stratum", "n_good", share.alias("share"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n_good") * risk))).alias("k"))
    up_to = Window.partitionBy("stratum").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    n, k = F.col("n_good"), F.col("k")
    step = F.when(k == 0, n * F.log1p(F.lit(-risk))).otherwise(F.log((n - k + 1) / F.greatest(k, F.lit(1))) + F.log(F.lit(risk / (1 - risk))))
    chances = terms.withColumn("log_chance", F.sum(step).over(up_to)).withColumn("below", F.sum(F.exp("log_chance")).over(up_to))
    return chances.where("below <= share").groupBy("stratum").agg(F.max("k").alias("most"))


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: scores above it are rejected. Strata without a bound of their own have no rows. `found` is features()."""
    scores = _scores()
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = found.where("not base_failed").join(marks, "doc_id")
    good = (F.col("quality") > 0).cast("long")
    pairs = F.array(*(F.named_struct(F.lit("rule"), F.lit(k), F.lit("score"), v.cast("long")) for k, v in scores.items()))
    counted = (
        held.select("stratum", good.alias("good"), pairs.alias("pairs"))
        .select("stratum", "good", F.explode("pairs").alias("x"))
        .groupBy("stratum", "x.rule", "x.score")
        .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    )
    counted = written(counted, "labelled-scores")
    sizes = counted.where(F.col("rule") == next(iter(scores))).groupBy("stratum").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    tests = len(scores) * F.count("*").over(Window.partitionBy(F.lit(0)))
    allowed = most_rejections(sizes, risk / len(scores), F.lit(delta) / tests)
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    tried = counted.select("stratum", "rule", "score", *(F.coalesce(F.sum(x).over(above), F.lit(0)).alias(x) for x in ("good", "bad")))
    gain = F.col("bad") / F.greatest("n_bad", F.lit(1)) - F.col("good") / F.greatest("n_good", F.lit(1))
    fit = tried.join(sizes, "stratum").join(allowed, "stratum").where("good <= most").withColumn("gain", gain).where("gain > 0")
    best = fit.groupBy("stratum", "rule").agg(F.max_by("score", F.struct("gain", "score")).alias("cutoff"))
    return best


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """features() and kept: false where the base rules or a cutoff reject."""
    found = written(features(docs, id_col, text_col, stratum_col), "quality-features")
    # a row for each stratum, with a column for each rule
    rules = cutoffs(found, labels, risk, delta).groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(f"most_{k}") for k in _scores()))
    over = F.lit(False)
    for name, score in _scores().items():
        over = over | F.coalesce(score > F.col(f"most_{name}"), F.lit(False))
    # a row for each stratum: as a written table its size is known, so Spark broadcasts it where it is small, and splits a
    # stratum that holds most documents where it isn't
    rules = written(rules, "cutoffs")
    return found.join(rules, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over)


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that judge() keeps, as they are."""
    judged = judge(docs, labels, risk, delta, id_col, text_col, stratum_col)
    gone = judged.where("not kept").select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__doc"]) & (F.hash(docs[text_col]) == gone["__tag"]), "left_anti")
