"""URL filters by a character language-model ratio, in DataFrame functions alone.

Rules decide the urls they fit. The urls decided are the training text of two variable-order Markov models, one for allowed
and one for blocked urls: each position gives a gram of ORDER characters and the next one, the counts of all shorter grams
are sums of these, and Witten-Bell smoothing mixes the orders (a context never seen leaves the next shorter one as it is).
Grams are scored once each, and a url's score is the mean over its positions of the difference of log-likelihoods. Four
fifths of the decided urls train; the rest calibrate the cutoff, the one with the best balanced accuracy. Counts cover every
decided url, so the models grow with the table.

Defined results: null urls and urls without `://` have an empty host and path, no rule, and score 0; repeated rows are judged
alike (and count as often as they occur); with no rule that allows or none that blocks in the table every other url is
allowed; a very long url gives a row for each position; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import written

ORDER, ALPHABET, FOLDS = 4, 256, 5
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands before a url, so that its first characters have contexts too.
_START = "\x01"


def with_host_and_path(urls: DataFrame, url: str = "url") -> DataFrame:
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    rows = urls.withColumn("_after", F.coalesce(after, F.lit(""))).withColumn("_host", F.regexp_extract("_after", r"^[^/?#]*", 0))
    rows = rows.withColumn("path", F.regexp_extract(F.expr("substring(_after, char_length(_host) + 1)"), r"^[^?#]*", 0))
    return rows.withColumn("host", F.translate("_host", _UPPER, _LOWER)).drop("_after", "_host")


def fitting_rule(rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The rule and its verdict for columns host and path; the longest wins. For a written list of rules."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda x: len(x[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(said)).otherwise(verdict)
    return found, verdict


def _positions(rows: DataFrame, order: int) -> DataFrame:
    """A row for each url and position: its gram of `order` characters and the next one."""
    text = F.concat(F.lit(_START * order), F.col("host"), F.col("path"))
    padded = rows.select("page_id", "verdict", "fold", text.alias("text")).where(F.char_length("text") > order)
    at = F.explode(F.sequence(F.lit(1), F.char_length("text") - order))
    return padded.select("page_id", "verdict", "fold", "text", at.alias("at")).select("page_id", "verdict", "fold", F.expr(f"substring(text, at, {order + 1})").alias("gram"))


def gram_scores(positions: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, score: the log-likelihood of its last character after the others, allowed less blocked."""
    train = F.col("fold") != 0
    side = lambda v: F.sum(F.when(train & (F.col("verdict") == v), 1).otherwise(0)).alias(v)
    grams = written(positions.groupBy("gram").agg(side("allow"), side("block")), "grams")
    sides = ("allow", "block")
    totals = grams.groupBy(F.substring("gram", order + 1, 1).alias("next")).agg(*(F.sum(s).alias(s) for s in sides))
    sums = totals.agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(f"n_{s}") for s in sides), *(F.sum((F.col(s) > 0).cast("long")).alias(f"t_{s}") for s in sides)).first()
    if not (sums.n_allow and sums.n_block):
        return grams.select("gram", F.lit(0.0).alias("score"))
    rows = grams.select("gram")
    floor = 1.0 / ALPHABET
    for k in range(order + 1):
        # counts of the last k + 1 characters, and of their first k
        own = grams.groupBy(F.expr(f"right(gram, {k + 1})").alias(f"g{k}")).agg(*(F.sum(s).alias(f"c_{s}") for s in sides))
        if k:
            ends = F.expr(f"left(g{k}, {k})")
            contexts = own.groupBy(ends.alias(f"x{k}")).agg(*(F.sum(f"c_{s}").alias(f"n_{s}") for s in sides), *(F.sum((F.col(f"c_{s}") > 0).cast("long")).alias(f"t_{s}") for s in sides))
            own = own.withColumn(f"x{k}", ends).join(contexts, f"x{k}").drop(f"x{k}")
        else:
            own = own.select("*", *(F.lit(sums[f"{what}_{s}"]).alias(f"{what}_{s}") for what in "nt" for s in sides))
        rows = rows.withColumn(f"g{k}", F.expr(f"right(gram, {k + 1})")).join(own, f"g{k}").drop(f"g{k}")
        mixed = []
        for s in sides:
            before = F.col(f"p_{s}") if k else F.lit(floor)
            n, t = F.col(f"n_{s}"), F.col(f"t_{s}")
            mixed.append(F.when(n > 0, (F.col(f"c_{s}") + t * before) / (n + t)).otherwise(before).alias(f"p_{s}"))
        rows = rows.select("gram", *mixed)
    return written(rows.select("gram", (F.log("p_allow") - F.log("p_block")).alias("score")), "gram-scores")


def cutoff(scored: DataFrame) -> float:
    """The score with the best balanced accuracy on the held-out decided urls; between equals the one next to 0.

    Scores count in hundredths between -20 and 20, so what meets in one task is a bounded table.
    """
    step = F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "score")) * 100).cast("int")
    held = scored.where("fold = 0 and verdict is not null").groupBy(step.alias("step")).agg(*(F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("allow", "block")))
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = lambda v: F.sum(v).over(everything)
    tried = held.select("step", F.coalesce(F.sum("block").over(below), F.lit(0)).alias("blocked"), F.coalesce(F.sum("allow").over(below), F.lit(0)).alias("lost"), share("allow").alias("allow"), share("block").alias("block"))
    gain = F.col("blocked") / F.greatest("block", F.lit(1)) - F.col("lost") / F.greatest("allow", F.lit(1))
    best = tried.where("allow > 0 and block > 0").select("step", gain.alias("gain")).orderBy(F.desc("gain"), F.abs("step"), "step").first()
    return -math.inf if best is None else best.step / 100 - 0.005


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    rule, said = fitting_rule(rules)
    rows = with_host_and_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))).withColumn("rule", rule).withColumn("verdict", said)
    rows = written(rows.withColumn("fold", F.pmod(F.crc32(F.concat_ws("/", "host", "path")), F.lit(FOLDS))), "urls")
    # a text is scored once however often it occurs, and counted as often
    texts = rows.select(F.xxhash64("host", "path").alias("page_id"), "host", "path", "verdict", "fold")
    positions = _positions(texts, order)
    scores = gram_scores(positions, order)
    once = _positions(texts.dropDuplicates(["page_id"]), order).select("page_id", "gram")
    found = written(once.join(scores, "gram").groupBy("page_id").agg(F.avg("score").alias("score")), "url-scores")
    scored = rows.withColumn("key", F.xxhash64("host", "path")).join(found.withColumnRenamed("page_id", "key"), "key", "left").drop("key")
    scored = scored.withColumn("score", F.coalesce("score", F.lit(0.0)))
    least = cutoff(scored)
    verdict = F.coalesce("verdict", F.when(F.col("score") >= least, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
