"""Documented extensions, not in the reference code: rollups, smoothing, range checks, retention.

All of them read *resolved* points (last write wins first), so a value
written twice is counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buoyline.functions.timefmt import parse_bound, ts_literal
from buoyline.operators.points import resolve_long
from buoyline.schemas import SENSOR_RANGES, SERIES_KEYS


def _bucket(every: str):
    return F.window("time", every)["start"].alias("bucket")


def rollup(points: DataFrame, every: str = "1 day") -> DataFrame:
    """avg/min/max/count per (series, field, time bucket) over resolved points.

    Two aggregations, both partial before their shuffle: the first resolves
    duplicates per (series, time, field), the second folds a whole bucket.
    """
    resolved = resolve_long(points)
    return resolved.groupBy(*SERIES_KEYS, "field", _bucket(every)).agg(
        F.avg("value").alias("avg_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count("value").alias("n"),
    )


def smooth(points: DataFrame, every: str = "1 hour") -> DataFrame:
    """Mean and exact median of the samples in each time bucket.

    Equal values are counted first (partial before the shuffle); a running
    count over the distinct values, in a window that spills, finds the middle.
    """
    keys = [*SERIES_KEYS, "field", "bucket"]
    counted = resolve_long(points).groupBy(*SERIES_KEYS, "field", _bucket(every), "value").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*keys).orderBy("value")
    ranked = counted.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "n", F.sum("c").over(Window.partitionBy(*keys)))
    # Ranks of the two middle samples (the same one for an odd count).
    holds = lambda rank: ((F.col("upto") - F.col("c") < rank) & (rank <= F.col("upto"))).cast("int")
    middles = holds(F.floor((F.col("n") + 1) / 2)) + holds(F.floor(F.col("n") / 2) + 1)
    return ranked.groupBy(*keys).agg(
        (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean_value"),
        (F.sum(F.when(middles > 0, F.col("value") * middles)) / 2).alias("median_value"),
        F.sum("c").alias("n"),
    )


def range_flags(points: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Resolved points with ``low``/``high`` and ``in_range`` (NULL for fields without a range)."""
    ranges = SENSOR_RANGES if ranges is None else ranges
    low = F.lit(None).cast("double")
    high = F.lit(None).cast("double")
    for f, (lo, hi) in ranges.items():
        low = F.when(F.col("field") == f, F.lit(float(lo))).otherwise(low)
        high = F.when(F.col("field") == f, F.lit(float(hi))).otherwise(high)
    resolved = resolve_long(points).withColumn("low", low).withColumn("high", high)
    return resolved.withColumn("in_range", F.col("value").between(F.col("low"), F.col("high")))


def out_of_range(points: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Threshold filter: resolved points outside their documented range."""
    return range_flags(points, ranges).where(~F.col("in_range"))


def split_by_age(points: DataFrame, now: str, keep_days: int) -> tuple[DataFrame, DataFrame]:
    """Retention: (kept, expired) by event age; write ``expired`` to an archive, keep the rest."""
    cutoff = ts_literal(now) - F.expr(f"INTERVAL {int(keep_days)} DAYS")
    kept = points.where(F.col("time") >= cutoff)
    expired = points.where(F.col("time") < cutoff)
    if "event_date" in points.columns:
        d = (parse_bound(now)).date()
        kept = kept.where(F.col("event_date") >= F.date_sub(F.lit(d), int(keep_days) + 1))
        expired = expired.where(F.col("event_date") <= F.date_sub(F.lit(d), int(keep_days)))
    return kept, expired


def age_part(now: str, keep_days: int, time: str = "time") -> Column:
    """'kept' or 'expired' by event age, to count both sides in one pass."""
    cutoff = ts_literal(now) - F.expr(f"INTERVAL {int(keep_days)} DAYS")
    return F.when(F.col(time) >= cutoff, F.lit("kept")).otherwise(F.lit("expired"))


def archive(points: DataFrame, now: str, keep_days: int, path: str, key: str = "device_id") -> None:
    """Write the expired points, resolved, as a point table of their own (X7); only their days are read."""
    from buoyline.operators.points import resolve_legacy
    from buoyline.sources import store

    _, expired = split_by_age(points, now, keep_days)
    resolved = resolve_legacy(expired) if key == "sensor_id" else resolve_long(expired)
    store.write_points(resolved, path, mode="overwrite", key=key)
