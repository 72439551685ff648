"""Ingest: raw messages -> typed records -> points, latest state, rejects.

``ingest`` is lazy: every output is a DataFrame over the same classification.
``ingest_to`` runs it as a batch job that survives executor loss: the
classified records are written once (cutting lineage and avoiding a second
JSON parse), and points, latest state and rejects are derived from that table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buoyline.operators import normalize, points, state
from buoyline.operators.decode import decode
from buoyline.plans import counters
from buoyline.sources import store


@dataclass
class Ingested:
    records: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return normalize.accepted(self.records)

    @property
    def points(self) -> DataFrame:
        return points.to_points(self.records)

    def latest(self, by: str = "arrival", only_stored: bool = False) -> DataFrame:
        return state.latest(self.records, by=by, only_stored=only_stored)

    @property
    def rejects(self) -> DataFrame:
        return normalize.rejects(self.records)

    @property
    def ignored(self) -> DataFrame:
        return self.records.where(F.col("status") == "ignored").select("arrival_seq", "topic")


def ingest(raw: DataFrame, ingest_time: str | None, keep_tags: bool = False, strict_time: bool = False,
           check_topic_device: bool = False) -> Ingested:
    """Decode, route and normalise raw messages (topic, payload, arrival_seq, arrival_ts)."""
    decoded = decode(raw)
    recs = normalize.classify(
        decoded, ingest_time, keep_tags=keep_tags, strict_time=strict_time, check_topic_device=check_topic_device
    )
    return Ingested(recs)


def ingest_to(raw: DataFrame, out_dir: str, ingest_time: str, keep_tags: bool = False, run: str | None = None) -> dict:
    """Batch ingest into ``out_dir``; every run owns ``run=<run>`` below each table.

    Tables: records/, points/ (by run and day), rejects/, latest/ (one candidate
    per device and run), counts/ (messages by status and reason, see ``counters``). Runs add up: ``read_points`` and ``read_latest`` merge
    them. Repeating a run under its name replaces exactly its own rows; without
    a name each call is a run of its own.
    """
    spark: SparkSession = raw.sparkSession
    out, part = out_dir.rstrip("/"), f"run={run or uuid.uuid4().hex}"
    res = ingest(raw, ingest_time, keep_tags=keep_tags)
    records, seen = counters.observed(res.records)
    records.write.mode("overwrite").parquet(f"{out}/records/{part}")
    counters.write_counts(spark, seen, f"{out}/counts/{part}")
    recs = Ingested(spark.read.parquet(f"{out}/records/{part}"))
    store.write_points(recs.points, f"{out}/points/{part}", mode="overwrite")
    recs.rejects.write.mode("overwrite").parquet(f"{out}/rejects/{part}")
    recs.latest().write.mode("overwrite").parquet(f"{out}/latest/{part}")
    return {k: f"{out}/{k}" for k in ("records", "points", "rejects", "latest", "counts")}


def read_latest(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest state per device over all runs: the candidate that arrived last."""
    return state.newest(spark.read.parquet(f"{out_dir.rstrip('/')}/latest").drop("run"))
