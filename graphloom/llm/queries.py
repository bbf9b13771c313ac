"""One query for each operator, as `__spark_entry__` registers them, with SQL where it can express the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import fim, fingerprints, language, lines, mixing, packing, quality, simhash, substrings, token_files, toxicity, urls, vectors
from graphloom.llm.common import shared_dir, table, written


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"))
    return packing.pack(written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


#: Targets of the mix: shares of what has the same parent; a source that isn't named weighs 1.
MIX = {"domain": {"web": 3.0, "reference": 2.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {"src0": 9.0}}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_domain(table(spark, sf_dir, "documents")).withColumn("tokens", mixing.n_tokens())
    mixed = mixing.mix(docs.select("doc_id", "domain", "lang", "source", "tokens"), weights=MIX)
    return mixed.select("doc_id", "domain", "lang", "source", "tokens", "budget", "copies")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    files = spark.read.schema(token_files.SEGMENTS).parquet(path)
    decoded = token_files.decode_segments(files).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    rows = decoded.join(token_files.segment_starts(files), ["part", "segment"])
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_fuzzy_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = F.sha2(fim.restore(), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vectors.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (
    op11_fill_in_middle, op12_vector_codes, op13_toxicity,
    op1_fingerprints, op3_language_id, op5_mixing, op8_fuzzy_lines, op4_url_filters, op9_quality_rules, op2_packing, op6_token_files, op7_substring_dedup, op10_simhash,
)}

#: op5: the tree's budgets level by level (a child is full if its capacity for a unit of weight lies under the water line),
#: then the prefix of each leaf in the order seeded for its epoch.
_LEVEL = """
  {name}_nodes AS (SELECT {path}, sum(capacity) AS capacity, {weight} AS weight FROM leaves GROUP BY {path}),
  {name}_given AS (SELECT n.*, {given} AS given FROM {name}_nodes n {parent}),
  {name}_lines AS (SELECT *, (given - coalesce(sum(capacity) OVER (PARTITION BY {siblings} ORDER BY capacity / weight, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (PARTITION BY {siblings} ORDER BY capacity / weight, {level} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line FROM {name}_given),
  {name}_open AS (SELECT *, max(CASE WHEN capacity / weight > line THEN line END) OVER (PARTITION BY {siblings}) AS open_line FROM {name}_lines),
  {name} AS (SELECT {path}, least(capacity, coalesce(open_line * weight, capacity)) AS given FROM {name}_open),"""


def _weight_sql(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX.get(level, {}).items()) + " ELSE 1.0 END::DOUBLE"


def _op5_sql() -> str:
    parts, above = [], None
    for i, level in enumerate(mixing.LEVELS):
        path = ", ".join(mixing.LEVELS[: i + 1])
        parent = f"JOIN {above} p ON " + " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in mixing.LEVELS[:i]) if above else ""
        given = "p.given" if above else "(SELECT least(sum(tokens)::DOUBLE, sum(capacity)) FROM leaves)"
        parts.append(_LEVEL.format(name=f"l{i}", path=path, weight=_weight_sql(level), given=given, parent=parent, siblings=", ".join(mixing.LEVELS[:i]) or "1", level=level))
        above = f"l{i}"
    same = " AND ".join(f"d.{c} IS NOT DISTINCT FROM p.{c}" for c in mixing.LEVELS)
    return f"""
WITH docs AS (SELECT doc_id, CASE WHEN try_cast(regexp_extract(source, '[0-9]+') AS INTEGER) < 10 THEN 'web' ELSE 'reference' END AS domain, lang, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents),
  leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {mixing.MAX_EPOCHS})::DOUBLE AS capacity FROM docs GROUP BY ALL),{"".join(parts)}
  plan AS (SELECT d.domain, d.lang, d.source, d.tokens AS n, floor(p.given + 1e-6)::BIGINT AS budget FROM leaves d JOIN {above} p ON {same}),
  placed AS (SELECT d.*, p.budget, p.n, CASE WHEN p.n > 0 THEN least(p.budget // greatest(p.n, 1), {mixing.MAX_EPOCHS}) ELSE 1 END AS epochs FROM docs d JOIN plan p ON {same}),
  ordered AS (SELECT *, md5('{mixing.SEED}:' || epochs || ':' || doc_id) AS place FROM placed),
  summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ordered)
SELECT doc_id, domain, lang, source, tokens, budget, (epochs + CASE WHEN epochs < {mixing.MAX_EPOCHS} AND upto <= budget - epochs * n THEN 1 ELSE 0 END)::BIGINT AS copies FROM summed"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: op7: every window by its words, and the least document that has it.
_OP7 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
  starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {substrings.WINDOW} + 2)) AS i FROM docs),
  windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {substrings.WINDOW} - 1], ' ')) AS h FROM starts),
  firsts AS (SELECT h, min(doc_id) AS source FROM windows GROUP BY h),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substrings.WINDOW})) AS p FROM windows JOIN firsts USING (h) WHERE source < doc_id),
  lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN words ELSE list_filter(words, lambda x, k: NOT list_contains(ps, k)) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN lists USING (doc_id)"""

#: op9: counts, then for each stratum and rule the cutoff that its labelled documents allow.
_OP9 = f"""
WITH texts AS (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
  starts AS (SELECT doc_id, i, words[i:i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM texts)),
  often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM starts),
  covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM often WHERE n > 1) GROUP BY doc_id),
  full_lines AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS filled FROM texts),
  counts AS (SELECT doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      len(filled)::BIGINT AS n_lines, (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM full_lines LEFT JOIN covered USING (doc_id)),
  judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
  scores AS (SELECT doc_id, stratum, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'long_words', 'short_words']) AS rule, unnest([floor(1000 * n_symbols / greatest(word_chars, 1)),
      floor(1000 * n_dup_lines / greatest(n_lines, 1)), floor(1000 * n_repeat_words / greatest(n_words, 1)), least(floor(100 * word_chars / greatest(n_words, 1)), 5000), -least(floor(100 * word_chars / greatest(n_words, 1)), 5000)]) AS score FROM judged),
  marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
  held AS (SELECT stratum, rule, score, (quality > 0)::BIGINT AS good FROM scores JOIN marks USING (doc_id) WHERE NOT base_failed),
  tallies AS (SELECT stratum, rule, score, sum(good) AS good, sum(1 - good) AS bad FROM held GROUP BY ALL),
  sizes AS (SELECT stratum, sum(good) AS n_good, sum(bad) AS n_bad FROM tallies WHERE rule = 'symbols' GROUP BY stratum),
  terms AS (SELECT stratum, n_good, unnest(range(0, (floor(n_good * {quality.RISK / 5!r}) + 1)::BIGINT)) AS k FROM sizes),
  chances AS (SELECT stratum, k, sum(exp(log_chance)) OVER (PARTITION BY stratum ORDER BY k) AS below FROM (SELECT stratum, k, sum(CASE WHEN k = 0 THEN n_good * ln(1 - {quality.RISK / 5!r})
      ELSE ln((n_good - k + 1)::DOUBLE / greatest(k, 1)) + ln({quality.RISK / 5!r} / (1 - {quality.RISK / 5!r})) END) OVER (PARTITION BY stratum ORDER BY k) AS log_chance FROM terms)),
  allowed AS (SELECT stratum, max(k) AS most FROM chances WHERE below <= {quality.DELTA!r} / (5 * (SELECT count(*) FROM sizes)) GROUP BY stratum),
  tried AS (SELECT stratum, rule, score, coalesce(sum(good) OVER above, 0) AS good, coalesce(sum(bad) OVER above, 0) AS bad FROM tallies WINDOW above AS (PARTITION BY stratum, rule ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  gains AS (SELECT stratum, rule, score, bad::DOUBLE / greatest(n_bad, 1) - good::DOUBLE / greatest(n_good, 1) AS gain FROM tried JOIN sizes USING (stratum) JOIN allowed USING (stratum) WHERE good <= most),
  best AS (SELECT stratum, rule, score AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, score DESC) AS r FROM gains WHERE gain > 0) WHERE r = 1),
  rejected AS (SELECT DISTINCT doc_id FROM scores JOIN best USING (stratum, rule) WHERE score > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r.doc_id IS NULL AS kept FROM judged LEFT JOIN rejected r USING (doc_id)"""


#: op11: the lines of each text, cut at two ranks that the hash of the id gives.
_OP11 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units, sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  hashed AS (SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM texts),
  ranked AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {fim.RATE} THEN 'plain' WHEN h4 % 100 < {fim.SPM} THEN 'spm' ELSE 'psm' END AS form FROM hashed),
  parts AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM ranked)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts"""


def _op12_sql() -> str:
    """op12: a row for each component; every round finds each part's nearest entry and moves the entries."""
    near = """a{k} AS MATERIALIZED (SELECT row, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (SELECT v.row, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS far
    FROM parts v JOIN c{k} c ON v.part = c.part AND v.place = c.place GROUP BY ALL) GROUP BY row, part)"""
    move = """c{n} AS MATERIALIZED (SELECT c.part, c.entry, c.place, CASE WHEN s.n IS NULL THEN c.x ELSE (s.total - ((s.total % s.n) + s.n) % s.n) // s.n END AS x FROM c{k} c LEFT JOIN (SELECT v.part, a.entry, v.place, count(*) AS n, sum(v.x)::BIGINT AS total
    FROM parts v JOIN a{k} a ON v.row = a.row AND v.part = a.part GROUP BY ALL) s ON c.part = s.part AND c.entry = s.entry AND c.place = s.place)"""
    rounds = ",\n  ".join(f"{near.format(k=k)},\n  {move.format(k=k, n=k + 1)}" for k in range(vectors.ROUNDS))
    return f"""
WITH whole AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, embedding, len(embedding) // {vectors.PARTS} AS width FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
  parts AS MATERIALIZED (SELECT row, vec_id, (i // width)::BIGINT AS part, (i % width)::BIGINT AS place, floor({vectors.SCALE} * embedding[i + 1]::DOUBLE)::BIGINT AS x FROM (SELECT *, unnest(range(len(embedding))) AS i FROM whole)),
  starts AS (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole QUALIFY entry < {vectors.ENTRIES}),
  c0 AS MATERIALIZED (SELECT part, entry, place, x FROM parts JOIN starts USING (row)),
  {rounds},
  {near.format(k=vectors.ROUNDS)},
  books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{vectors.ROUNDS}),
  codes AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{vectors.ROUNDS} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM whole JOIN codes USING (row) CROSS JOIN books"""


ORACLE_SQL: dict[str, str] = {"op11_fill_in_middle": _OP11, "op12_vector_codes": _op12_sql(), "op5_mixing": _op5_sql(), "op7_substring_dedup": _OP7, "op9_quality_rules": _OP9}
