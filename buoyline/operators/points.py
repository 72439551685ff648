"""Records -> time-series points, point resolution and the long->wide pivot.

Points are kept in long form, one value per (series, time, field), like a
time-series store. A series is measurement + tag set (device_id, firmware,
location). Writing the same (series, time, field) twice keeps the value of
the later arrival; different fields of one (series, time) merge. Resolution
happens on read, so appends stay idempotent and need no MERGE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buoyline.schemas import MEASUREMENT, SERIES_KEYS, TELEMETRY_FIELDS


def to_points(records: DataFrame, measurement: str = MEASUREMENT, fields: tuple[str, ...] = TELEMETRY_FIELDS) -> DataFrame:
    """Stored records -> long points, one row per non-null field.

    ``records`` are the output of ``normalize.classify`` restricted to
    ``status = 'stored'`` (the caller may pass all records; others are dropped).
    """
    stored = records.where(F.col("status") == "stored") if "status" in records.columns else records
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return stored.select(
        F.lit(measurement).alias("measurement"),
        "device_id",
        "firmware",
        "location",
        F.col("event_time").cast("timestamp").alias("time"),
        F.inline(pairs),
        "arrival_seq",
    ).where(F.col("value").isNotNull())


def from_long(long_df: DataFrame, measurement: str = MEASUREMENT) -> DataFrame:
    """Adapt an external long table (device_id, time, field, value, arrival_seq) to points."""
    cols = set(long_df.columns)
    return long_df.select(
        (F.col("measurement") if "measurement" in cols else F.lit(measurement)).alias("measurement"),
        "device_id",
        (F.col("firmware") if "firmware" in cols else F.lit(None).cast("string")).alias("firmware"),
        (F.col("location") if "location" in cols else F.lit(None).cast("string")).alias("location"),
        F.col("time").cast("timestamp").alias("time"),
        "field",
        F.col("value").cast("double").alias("value"),
        F.col("arrival_seq").cast("long").alias("arrival_seq"),
    )


def resolve_long(points: DataFrame) -> DataFrame:
    """Last write wins per (series, time, field); stays in long form."""
    keys = [*SERIES_KEYS, "time", "field"]
    return points.groupBy(*keys).agg(
        F.max_by("value", "arrival_seq").alias("value"), F.max("arrival_seq").alias("arrival_seq")
    )


def resolve_wide(points: DataFrame, fields: tuple[str, ...] = TELEMETRY_FIELDS) -> DataFrame:
    """Last write wins per field, pivoted to one row per (series, time).

    One aggregation does both: for every field, the value of the newest
    arrival among the rows of that field. A field never written is NULL.
    The aggregation is partial before the shuffle, so a hot series is reduced
    map-side and never gathered whole into one task.
    """
    keys = [*SERIES_KEYS, "time"]
    aggs = [
        F.max_by(F.col("value"), F.when(F.col("field") == f, F.col("arrival_seq"))).alias(f) for f in fields
    ]
    present = F.col("field").isin(*fields)
    return (
        points.where(present)
        .groupBy(*keys)
        .agg(*aggs, F.max("arrival_seq").alias("arrival_seq"))
    )


def resolve_legacy(points: DataFrame) -> DataFrame:
    """Last write wins per (measurement, sensor, time, field) of legacy points: value, text and type together."""
    kept = F.struct("value", "value_string", "value_type")
    return points.groupBy("measurement", "sensor_id", "time", "field").agg(
        F.max_by(kept, "arrival_seq").alias("kept"), F.max("arrival_seq").alias("arrival_seq")
    ).select("measurement", "sensor_id", "time", "field", "kept.*", "arrival_seq")


def with_event_date(points: DataFrame) -> DataFrame:
    return points.withColumn("event_date", F.to_date("time"))
