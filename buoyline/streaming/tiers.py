"""Rollup tiers that stay exact while points are rewritten (documented extension X7).

Every micro-batch first adds its points to the store, then makes the buckets it
touched anew from all points stored for them, last write wins, and writes these
rows as its own batch. A bucket's newest row replaces the older ones on read,
so a rewritten value leaves no trace of the old one. Only the days between the
batch's oldest and newest bucket are read. Coarser tiers fold finer ones, as a
row holds sum, least, greatest and count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from buoyline.operators.points import resolve_long
from buoyline.schemas import SERIES_KEYS
from buoyline.sources import store
from buoyline.streaming.jobs import _write_batch_partition

KEYS = [*SERIES_KEYS, "field", "bucket"]
VALUES = ["sum_value", "min_value", "max_value", "n"]


def _with_bucket(points: DataFrame, every: str) -> DataFrame:
    return points.withColumn("bucket", F.window("time", every)["start"])


def _folded(points: DataFrame) -> DataFrame:
    return points.groupBy(*KEYS).agg(
        F.sum("value").alias("sum_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("value").alias("n"))


def tier_batch(batch: DataFrame, batch_id: int, out_dir: str, every: str = "1 day") -> None:
    """One micro-batch of long points: store them, then write the buckets they touched. A replay writes the same rows again."""
    out = out_dir.rstrip("/")
    batch = batch.persist()
    try:
        store.write_points_batch(batch, f"{out}/points", batch_id)
        touched = _with_bucket(batch, every).select(*KEYS).distinct()
        first, last = touched.agg(F.min("bucket"), F.max(F.col("bucket") + F.expr(f"INTERVAL {every}"))).first()
        if first is None:
            return
        stored = store.read_points(batch.sparkSession, f"{out}/points").where(
            F.col("event_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))) & (F.col("batch_id") <= batch_id))
        rows = _with_bucket(resolve_long(stored), every).alias("a")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEYS]
        _write_batch_partition(_folded(rows.join(touched.alias("b"), same, "left_semi")), f"{out}/tier", batch_id)
    finally:
        batch.unpersist()


def start_tier(points: DataFrame, out_dir: str, checkpoint: str, every: str = "1 day") -> StreamingQuery:
    """Run the tier over all points there are now; call again for later ones."""
    writer = points.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, bid: tier_batch(df, bid, out_dir, every))
    return writer.trigger(availableNow=True).start()


def read_tier(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest row of every bucket."""
    rows = spark.read.parquet(f"{out_dir.rstrip('/')}/tier")
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*VALUES), "batch_id").alias("x")).select(*KEYS, "x.*")


def coarser(tier: DataFrame, every: str) -> DataFrame:
    """A tier of longer buckets, each a whole number of the finer ones."""
    return tier.withColumn("bucket", F.window("bucket", every)["start"]).groupBy(*KEYS).agg(
        F.sum("sum_value").alias("sum_value"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("n").alias("n"))
