"""The legacy hub as one job: route by kind, parse, state, two point tables.

``hub(raw)`` is lazy and returns every output as a DataFrame over one
classification. ``hub_to(raw, out)`` runs it: the classified messages are
written once (cutting lineage and the second parse), then the measurement
table, the diagnostics table, the sensor state and the rejects are derived
from that table, so a lost executor costs a retry of one stage, not the job.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buoyline.operators import legacy as L
from buoyline.schemas import LEGACY_BUCKETS, LEGACY_DIAG, LEGACY_MEASUREMENT
from buoyline.sources import store


@dataclass
class Hub:
    classified: DataFrame
    ingest_time: str | None

    @property
    def routes(self) -> dict[str, DataFrame]:
        return L.route(self.classified)

    @property
    def measurements(self) -> DataFrame:
        return L.to_points(self.classified, LEGACY_MEASUREMENT, self.ingest_time)

    @property
    def diagnostics(self) -> DataFrame:
        return L.to_points(self.classified, LEGACY_DIAG, self.ingest_time)

    @property
    def sensors(self) -> DataFrame:
        return L.sensors(self.classified)

    @property
    def rejects(self) -> DataFrame:
        invalid = self.classified.where(F.col("status") == "invalid").select(
            "arrival_seq", "topic", "payload", F.lit("validate").alias("stage"), "reason", "detail"
        )
        return invalid.unionByName(L.write_failures(self.classified, LEGACY_MEASUREMENT)).unionByName(
            L.write_failures(self.classified, LEGACY_DIAG)
        )


def hub(raw: DataFrame, ingest_time: str | None) -> Hub:
    return Hub(L.classify(raw), ingest_time)


def hub_to(raw: DataFrame, out_dir: str, ingest_time: str | None, run: str | None = None) -> dict[str, str]:
    """Batch run of the hub into ``out_dir``: one folder per bucket, plus sensors/ and rejects/.

    Every run owns ``run=<run>`` below each table, as in ``ingest_to``;
    ``read_sensors`` merges the runs' sensor states.
    """
    spark = raw.sparkSession
    out, part = out_dir.rstrip("/"), f"run={run or uuid.uuid4().hex}"
    h = hub(raw, ingest_time)
    h.classified.write.mode("overwrite").parquet(f"{out}/classified/{part}")
    h = Hub(spark.read.parquet(f"{out}/classified/{part}"), ingest_time)
    paths = {
        LEGACY_MEASUREMENT: f"{out}/{LEGACY_BUCKETS[LEGACY_MEASUREMENT]}",
        LEGACY_DIAG: f"{out}/{LEGACY_BUCKETS[LEGACY_DIAG]}",
    }
    store.write_points(h.measurements, f"{paths[LEGACY_MEASUREMENT]}/{part}", mode="overwrite", key="sensor_id")
    store.write_points(h.diagnostics, f"{paths[LEGACY_DIAG]}/{part}", mode="overwrite", key="sensor_id")
    h.sensors.write.mode("overwrite").parquet(f"{out}/sensors/{part}")
    h.rejects.write.mode("overwrite").parquet(f"{out}/rejects/{part}")
    return {**paths, "sensors": f"{out}/sensors", "rejects": f"{out}/rejects"}


def read_sensors(spark: SparkSession, out_dir: str) -> DataFrame:
    """Sensor state over all runs."""
    return L.merge_sensors(spark.read.parquet(f"{out_dir.rstrip('/')}/sensors").drop("run"))
