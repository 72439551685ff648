"""Counted outputs of ingest: how many messages took which way, counted while they are written.

The counts ride on the write of the records as an ``Observation``, so there is
no second pass. Each run or micro-batch keeps its own, overwritten when it is
repeated. Status and reason are fixed lists, so a count is a few numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from buoyline.operators.normalize import REASONS, STATUSES

COUNTS = "status string, reason string, n long"
_KEYS = [(s, r) for s in STATUSES for r in ("", *REASONS)]


def observed(records: DataFrame) -> tuple[DataFrame, Observation]:
    """The records, counting themselves by (status, reason) when an action reads all of them."""
    seen = Observation()
    reason = F.coalesce("reason", F.lit(""))
    counts = [F.count_if((F.col("status") == s) & (reason == r)).alias(f"n{i}") for i, (s, r) in enumerate(_KEYS)]
    return records.observe(seen, *counts), seen


def write_counts(spark: SparkSession, seen: Observation, path: str) -> None:
    """One row per (status, reason) that occurred, as one file; call it after the action."""
    got = seen.get
    rows = [(s, r, got[f"n{i}"]) for i, (s, r) in enumerate(_KEYS) if got[f"n{i}"]]
    spark.createDataFrame(rows, COUNTS).coalesce(1).write.mode("overwrite").parquet(path)


def read_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """(status, reason, n) over all runs or batches of an ingest's folder."""
    path = f"{out_dir.rstrip('/')}/counts"
    return spark.read.schema(COUNTS).parquet(path).groupBy("status", "reason").agg(F.sum("n").alias("n"))
