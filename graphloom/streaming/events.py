"""Extensions: event streams by windows, sessions and distinct keys, as Structured Streaming reads them.

Each runs over what is there (availableNow) and equals the batch result; state lives in the checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.lineage import shared_folder
from graphloom.plans.registry import Catalogue

C = Catalogue()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a file source reads folders: the table is one, or a file in one
    rows = spark.readStream.schema(kept).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(rows: DataFrame, mode: str) -> DataFrame:
    """The rows of a stream once all input is read, as a table in the session's shared folder; none pass the driver."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], rows.schema).write.parquet(f"{path}/rows")  # a stream without input writes nothing
    sink = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        sink = sink.format("parquet").option("path", f"{path}/rows")
    else:  # complete: each batch holds all rows
        sink = sink.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows"))
    sink.start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


@C.add("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    counts = event_stream(spark, d).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return drained(counts, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@C.add("""SELECT user_id, min(ts) AS began, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    sessions = event_stream(spark, d).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return drained(sessions, "complete").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("began"), "n")


@C.add("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return drained(event_stream(spark, d).dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"), "append")


QUERIES, ORACLE_SQL = C.queries, C.sql
