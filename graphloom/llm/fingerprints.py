"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions alone.

A text is a multiset of paragraphs (lines). Each paragraph is hashed to a wide vector, and a fingerprint is the sum of these
vectors modulo powers of two: paragraphs may come in any order, and adding or subtracting a paragraph's vector inserts or
deletes it. The vector has three parts: EXACT lanes of 32 bits, hashed from the whole paragraph, decide equality; SOFT lanes
of 32 bits count the word shingles of the paragraph whose hash has a certain bit set; one lane counts the shingles. Twice a
soft lane less the count is a sum of random signs, so the soft lanes of two fingerprints estimate the cosine of their
shingle multisets, which is the likeness (negative estimates count as 0; equal fingerprints have 1).

Defined results: null text is empty, which is one empty paragraph; a paragraph with fewer words than a shingle is one shingle;
repeated rows get the same fingerprint; a very long text is one row, whose paragraphs' shingles are counted in rows of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD_GAP, written

EXACT, SOFT, SHINGLE = 8, 64, 3
_LOW = (1 << 32) - 1


def _exact_lane(paragraphs: str, k: int) -> Column:
    """An exact lane: the sum over paragraphs of their hash by a seed of the lane's own (that of k)."""
    added = lambda total, p: (total + F.xxhash64(F.lit(k), p).bitwiseAND(F.lit(_LOW))).bitwiseAND(F.lit(_LOW))
    return F.aggregate(paragraphs, F.lit(0).cast("long"), added)


def _shingles(paragraphs: str) -> Column:
    """Hashes of all word shingles, paragraph by paragraph."""

    def of(words: Column) -> Column:
        n = F.size(words)
        return F.when(n <= SHINGLE, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(
            F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
        )

    return F.flatten(F.transform(F.transform(paragraphs, lambda p: F.split(p, WORD_GAP)), of))


def fingerprint_columns(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Add a fingerprint column for each text column: {text column: name}. Rows are told apart by their other columns and
    exact lanes, so a task that runs again gives the same keys; rows equal in all of these are summed together, counted, and
    given back as often, with an equal share of the sums (which holds up to 2**32 shingles in all of them).

    The shingles are exploded and summed again before anything is shuffled, two lanes to a long.
    """
    names = list(texts.values())
    carried = [c for c in rows.columns if c not in texts]
    wide = rows.withColumns({f"_lines_{n}": F.split(F.coalesce(F.col(t), F.lit("")), "\n") for t, n in texts.items()})
    # two lanes to a long here too: what is shuffled stays narrow, and becomes text at the end
    both = lambda n, k: F.shiftleft(_exact_lane(f"_lines_{n}", k), 32).bitwiseOR(_exact_lane(f"_lines_{n}", k + 1))
    exact = {f"_exact{k}_{n}": both(n, k) for n in names for k in range(0, EXACT, 2)}
    wide = wide.withColumns(exact | {f"_soft_{n}": _shingles(f"_lines_{n}") for n in names})
    sides = F.array(*(F.named_struct(F.lit("side"), F.lit(i), F.lit("hashes"), F.col(f"_soft_{n}")) for i, n in enumerate(names)))
    keys = [*carried, *exact]
    rows = wide.select(*keys, F.explode(sides).alias("x"))
    each = rows.select(*keys, F.col("x.side").alias("_side"), F.posexplode("x.hashes").alias("_at", "_h"))
    pair = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(pair)).alias(f"_s{k}") for k in range(SOFT // 2)]
    summed = each.groupBy(*keys, "_side").agg(F.count_if(F.col("_at") == 0).alias("_rows"), F.count("*").alias("_n"), *sums)
    # either lane of a sum is a multiple of the number of equal rows
    share = lambda x: F.shiftleft((F.shiftrightunsigned(x, 32) / F.col("_rows")).cast("long"), 32).bitwiseOR((F.col(x).bitwiseAND(F.lit(_LOW)) / F.col("_rows")).cast("long"))
    sided = summed.select(*keys, "_side", "_rows", F.array((F.col("_n") / F.col("_rows")).cast("long"), *(F.when(F.col("_rows") == 1, F.col(f"_s{k}")).otherwise(share(f"_s{k}")) for k in range(SOFT // 2))).alias("_soft"))
    whole = sided.groupBy(*keys).agg(F.max("_rows").alias("_rows"), *(F.max(F.when(F.col("_side") == i, F.col("_soft"))).alias(f"_soft_{n}") for i, n in enumerate(names)))
    whole = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    hexed = lambda x, n: F.lpad(F.hex(x), n, "0")

    def text(n: str) -> Column:
        soft = F.array_join(F.transform(F.slice(f"_soft_{n}", 2, SOFT // 2), lambda x: hexed(x, 16)), "")
        count = hexed(F.get(f"_soft_{n}", F.lit(0)).bitwiseAND(F.lit(_LOW)), 8)
        return F.lower(F.concat(*(hexed(F.col(f"_exact{k}_{n}"), 16) for k in range(0, EXACT, 2)), count, soft)).alias(n)

    return whole.select(*carried, *(text(n) for n in names))


def _lanes(fingerprint: Column | str) -> Column:
    """All lanes: exact, count, soft."""
    return F.transform(F.sequence(F.lit(0), F.lit(EXACT + SOFT)), lambda i: F.conv(F.substr(F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint, 8 * i + 1, F.lit(8)), 16, 10).cast("long"))


def _text(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(_LOW))), 8, "0")), ""))


def inserted(a: Column | str, b: Column | str) -> Column:
    """The fingerprint of both multisets together."""
    return _text(F.zip_with(_lanes(a), _lanes(b), lambda x, y: x + y))


def deleted(a: Column | str, b: Column | str) -> Column:
    """The fingerprint of a without the paragraphs of b."""
    return _text(F.zip_with(_lanes(a), _lanes(b), lambda x, y: x - y))


def with_likeness(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add a column from 0 to 1 for each pair of fingerprint columns: {name: (one, other)}."""
    kept, used = rows.columns, sorted({x for pair in pairs.values() for x in pair})
    number = lambda x, i: F.conv(F.substr(x, i, F.lit(8)), 16, 10).cast("double")
    counts = {f"_n_{x}": number(F.col(x), F.lit(8 * EXACT + 1)) for x in used}
    rows = rows.withColumns(counts)
    lanes = F.sequence(F.lit(EXACT + 1), F.lit(EXACT + SOFT))
    signs = lambda x: F.transform(lanes, lambda i: 2 * number(F.col(x), 8 * i + 1) - F.col(f"_n_{x}"))
    rows = rows.withColumns({f"_signs_{x}": signs(x) for x in used})
    total = lambda a, b: F.aggregate(F.zip_with(f"_signs_{a}", f"_signs_{b}", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumns({f"_norm_{x}": total(x, x) for x in used} | {f"_dot_{k}": total(*pair) for k, pair in pairs.items()})

    def like(k: str, a: str, b: str) -> Column:
        scale = F.sqrt(F.col(f"_norm_{a}") * F.col(f"_norm_{b}"))
        cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"_dot_{k}") / scale))
        return F.when(F.col(a) == F.col(b), F.lit(1.0)).when(scale > 0, cosine).otherwise(F.lit(0.0)).alias(k)

    return rows.select(*kept, *(like(k, *pair) for k, pair in pairs.items()))


def successors(keys: DataFrame) -> DataFrame:
    """key and next_key: the next smaller distinct key; after the smallest comes the largest. `keys` has one column, key.

    Keys are ranged over partitions and numbered there; only each partition's largest key meets the others'.
    """
    ranged = written(keys.distinct().repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ranged-keys")
    tops = ranged.groupBy("part").agg(F.max("key").alias("top"))
    order = Window.orderBy("part")
    tops = tops.select("part", F.lag("top").over(order).alias("below"), F.max("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("largest"))
    following = F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key")))
    return ranged.withColumn("following", following).join(tops, "part").select("key", F.coalesce("following", "below", "largest").alias("next_key"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last floor(n/3) code points give way to the first ones of the
    next document in descending order of ids.

    A null id counts as the smallest (as -2**63 does, which comes back as null). Where rows repeat an id, the next document is the row with the least text.
    """
    least = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), least).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = written(successors(rows.select("key")), "successors")
    third = F.floor(F.char_length("text") / 3).cast("int")
    takes = rows.groupBy("key").agg(F.max(third).alias("take")).join(pairs, "key").select("next_key", F.col("key").alias("to"), "take")
    # both joins shuffle the same rows by the same key, so the texts move once; neither other side has a size bound
    lent = rows.join(takes.hint("merge"), rows["key"] == takes["next_key"]).select(F.col("to").alias("key"), F.expr("left(text, take)").alias("lent"))
    lent = lent.groupBy("key").agg(F.min("lent").alias("lent"))
    joined = rows.join(lent.hint("merge"), "key").select("key", "text", "lent", F.char_length("text").alias("n"))
    edited = F.concat(F.expr("left(text, n - cast(floor(n / 3) as int))"), F.expr("left(lent, cast(floor(n / 3) as int))"))
    joined = joined.select("key", F.col("n").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    found = fingerprint_columns(joined.withColumn("_sha", F.unhex(F.sha2("edited", 256))), {"text": "fingerprint", "edited": "edited_fingerprint"})
    found = written(found, "fingerprints")
    following = found.groupBy("key").agg(F.min("fingerprint").alias("next_fingerprint")).withColumnRenamed("key", "next_key")
    rows = found.join(pairs, "key").join(following, "next_key")
    rows = with_likeness(rows, {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")})
    doc_id = F.when(F.col("key") != least, F.col("key")).alias("doc_id")
    return rows.select(doc_id, "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
