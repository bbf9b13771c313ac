"""A corpus pipeline of five stages over `documents`: quality rules, fuzzy line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, which `run` writes as Parquet and reads
again. All but the last return the columns of `documents`; a document from which lines went has its `n_chars` counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import lines, mixing, packing, quality, simhash
from graphloom.llm.common import table, written
from graphloom.llm.queries import MIX


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep, as they are.

    Null and empty texts fail the base rules and go; a null language is a stratum of its own; repeated rows, null ids among them,
    are judged alike; an empty table stays empty; columns beside those of `documents` are kept.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that an earlier document has, exactly or nearly; `n_chars` is counted anew where text is left.

    Documents that lose all lines stay with empty lines (the next stage keeps one of these); null texts stay null; rows that
    repeat an id and text lose the same lines; null ids come last; an empty table stays empty; other columns are kept.
    """
    kept = lines.drop_fuzzy_lines(docs).drop("n_removed")
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id, as it is.

    Texts without words (null ones too) are one group; of repeated rows one stays; rows without an id stay only where their
    group has none with one; an empty table stays empty; other columns are kept.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, each as often as epochs take it (up to four times).

    Null sources and languages are values of their own; texts without words cost nothing and are taken with their
    epoch; rows that repeat an id are taken or left together; an empty table stays empty; other columns are kept.
    """
    return mixing.apply_mix(docs, weights=MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row of docs, placed in sequences of 1024 tokens.

    Null and empty texts are one piece, the end id; repeated rows (null ids among them) are packed as often as they occur; an
    empty table gives no rows; other columns are ignored.
    """
    pieces = packing.token_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(written(pieces, "pieces"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL has no XXH64, no tokenizer and no fuzzy components, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


QUERIES = {"pipeline": run}
