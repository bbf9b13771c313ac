"""Cutting lineage in loops: tables written to the folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir; a temporary folder stands in only where the session names none."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="graphloom-"))
    return spark.conf.get("spark.checkpoint.dir")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows into the shared folder and read them back; unlike a checkpoint this computes them once."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that are written at a time: small jobs leave most cores to others.
TOGETHER = 8


def cut_all(**tables: DataFrame | Callable[[], DataFrame]) -> dict[str, DataFrame]:
    """cut() of tables that don't depend on each other, several at a time; a function is called for its table first."""
    with ThreadPoolExecutor(TOGETHER) as pool:
        jobs = {k: pool.submit(lambda t=t: cut(t() if callable(t) else t)) for k, t in tables.items()}
        return {k: job.result() for k, job in jobs.items()}
