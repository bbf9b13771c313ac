"""Notes and reviews of objects, kept as rows of their own, so that a rebuild of the objects keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "object_id string, seq bigint, note string, reviewed boolean"


def append(spark: SparkSession, path: str, rows: list[tuple[str, int, str | None, bool]]) -> None:
    """Add notes (object_id, seq, note, reviewed) to the table at `path`."""
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)


def latest(notes: DataFrame, by: str = "object_id") -> DataFrame:
    """The last note (by seq) of each object, and whether any row reviewed it."""
    return notes.groupBy(by).agg(F.max_by("note", "seq").alias("note"), F.bool_or("reviewed").alias("reviewed"))


def whole(notes: DataFrame, by: str = "object_id", separator: str = "\n") -> DataFrame:
    """All notes of each object in order, joined."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "note"))), lambda x: x["note"])
    return notes.groupBy(by).agg(F.array_join(ordered, separator).alias("notes"))


def annotated(objects: DataFrame, notes: DataFrame) -> DataFrame:
    """Objects with `reviewed` and `notes`; notes of objects that are gone are left out."""
    both = latest(notes).join(whole(notes), "object_id").select(F.col("object_id").alias("id"), "reviewed", "notes")
    return objects.join(both, "id", "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
