"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions.

The levels (domain, language, source) make a tree. A node can take as many tokens as its leaves hold, times `max_epochs`. From
the root down, a node's budget is shared among its children by weight; a child that can't use its share keeps what it can
take and its siblings share the rest, so a shortage reaches other branches only when all siblings are full. A leaf turns its
budget into whole epochs and a prefix: its documents in an order seeded for that epoch, as long as their tokens fit.

Prefix sums never put a leaf into one task: a leaf's order is cut into 4096 ranges of the hash, ranges are summed first, and
only documents of a range meet.

Defined results: null texts have no tokens and are taken with their epoch; null levels are a value of their own; ties of the
order (repeated ids) are taken or left together; a leaf without tokens takes one epoch; an empty table gives no rows;
columns of the input are kept whatever their names, but for `budget` and `copies`, which are made anew; a source whose number
isn't an int has the domain `reference`; the length of a text only adds to its tokens.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import as_one, columns_of, written

LEVELS = ("domain", "lang", "source")
SEED, MAX_EPOCHS = 7, 4
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: str = "text") -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    """By value of the level; values that aren't named weigh 1."""
    out = F.lit(1.0)
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(float(weight))).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: Mapping[str, Mapping[str, float]], total: float | None, max_epochs: int) -> DataFrame:
    """The leaves (levels, tokens) with budget. Equal capacity-to-weight ratios share alike. total: None for as many tokens as there are."""
    leaves = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("double"))
    sums = leaves.agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity")).first()
    root = min(float(sums.tokens if total is None else total), float(sums.capacity)) if sums.tokens else 0.0
    parents = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        if parents is None:
            nodes = nodes.withColumn("given", F.lit(root))
        else:
            up = path[:-1]
            same = [nodes[c].eqNullSafe(parents[f"up_{c}"]) for c in up]
            nodes = nodes.join(parents, same).drop(*(f"up_{c}" for c in up))
        siblings = Window.partitionBy(*path[:-1]) if depth else Window.partitionBy(F.lit(0))
        ordered = siblings.orderBy(F.col("capacity") / F.col("weight"), F.col(level).asc_nulls_first())
        before = F.coalesce(F.sum("capacity").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        after = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("line", (F.col("given") - before) / after)
        open_ = F.max(F.when(F.col("capacity") / F.col("weight") > F.col("line"), F.col("line"))).over(siblings)
        nodes = nodes.withColumn("open", open_)
        taken = F.least(F.col("capacity"), F.coalesce(F.col("open") * F.col("weight"), F.col("capacity")))
        parents = written(nodes.select(*(F.col(c).alias(f"up_{c}") for c in path), taken.alias("given")), "budgets")
    same = [leaves[c].eqNullSafe(parents[f"up_{c}"]) for c in levels]
    return leaves.join(parents, same).select(*levels, "tokens", F.floor(F.col("given") + 1e-6).alias("budget"))


def mix(
    docs: DataFrame,
    levels: tuple[str, ...] = LEVELS,
    weights: Mapping[str, Mapping[str, float]] | None = None,
    total: float | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    tokens_col: str = "tokens",
) -> DataFrame:
    """The rows of docs with `budget` (of the leaf, in tokens) and `copies`: how many epochs take the document."""
    quoted = [F.col(f"`{c}`") for c in levels]
    names = [f"level{i}" for i in range(len(levels))]
    rows = docs.select(as_one(docs), *(q.alias(n) for q, n in zip(quoted, names, strict=True)), F.col(f"`{id_col}`").alias("id"), F.col(f"`{tokens_col}`").alias("tokens"))
    leaves = written(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")).select(*(F.col(n).alias(c) for n, c in zip(names, levels, strict=True)), "tokens"), "leaves")
    plan = written(budgets(leaves, levels, weights or {}, total, max_epochs), "plan")
    leaf = [f"leaf{i}" for i in range(len(levels))]
    named = plan.select(*(F.col(c).alias(x) for c, x in zip(levels, leaf, strict=True)), F.col("tokens").alias("all"), "budget")
    whole = F.when(F.col("all") > 0, F.least(F.floor(F.col("budget") / F.greatest("all", F.lit(1))), F.lit(max_epochs))).otherwise(F.lit(1))
    rows = rows.join(named, [F.col(n).eqNullSafe(F.col(x)) for n, x in zip(names, leaf, strict=True)])
    rows = rows.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("all"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = rows.withColumn("order", order).withColumn("range", F.substring("order", 1, 3))
    ranges = rows.groupBy(*leaf, "range").agg(F.sum("tokens").alias("n"))
    earlier = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*(F.col(x).alias(f"r{x}") for x in leaf), F.col("range").alias("r_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    same = [F.col(x).eqNullSafe(F.col(f"r{x}")) for x in leaf] + [F.col("range") == F.col("r_range")]
    within = F.sum("tokens").over(Window.partitionBy(*leaf, "range").orderBy("order").rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.join(ranges, same).withColumn("upto", F.col("before") + within)
    copies = F.col("whole") + (F.col("upto") <= F.col("rest")).cast("long")
    capped = F.when(F.col("whole") < max_epochs, copies).otherwise(F.col("whole"))
    kept = [x for c, x in zip(docs.columns, columns_of(docs), strict=True) if c not in ("budget", "copies")]
    return rows.select(*kept, F.col("budget").alias("budget"), capped.alias("copies"))


def with_domain(docs: DataFrame, source: str = "source") -> DataFrame:
    """For tables without a domain: sources numbered below ten are `web`, the others `reference`."""
    number = F.try_element_at(F.regexp_extract_all(F.col(source), F.lit("[0-9]+"), 0), F.lit(1)).try_cast("int")
    return docs.withColumn("domain", F.when(number < 10, F.lit("web")).otherwise(F.lit("reference")))


def apply_mix(docs: DataFrame, levels: tuple[str, ...] = LEVELS, weights: Mapping[str, Mapping[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Budgets come from narrow rows; texts are shuffled once."""
    tagged = with_domain(docs) if "domain" in levels and "domain" not in docs.columns else docs
    tag = F.hash(F.col(f"`{text_col}`"))
    narrow = tagged.select(F.col(f"`{id_col}`").alias("doc_id"), tag.alias("tag"), *(F.col(f"`{c}`") for c in levels), n_tokens(f"`{text_col}`").alias("tokens"))
    taken = mix(written(narrow, "narrow"), levels, weights).groupBy("doc_id", "tag").agg(F.max("copies").alias("copies")).where("copies > 0")
    whole = docs.select(as_one(docs), F.col(f"`{id_col}`").alias("own"), tag.alias("own_tag"))
    rows = whole.join(taken, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("own_tag") == F.col("tag")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns_of(docs))
