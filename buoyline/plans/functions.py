"""The read operators as SQL table functions, planned inline like a view with parameters.

``register_functions`` makes them over resolved wide rows (``compaction.read_resolved``,
``points.resolve_wide``), after which plain SQL can call them:

    SELECT * FROM device_history('esp32-7', '2024-01-01T00:00:00Z', n => 100)

Arguments are substituted into the query, so device and time reach the scan as
pushed filters, the day as partition filter, and the limit becomes a top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buoyline.schemas import HISTORY_DEFAULT_LIMIT, HISTORY_MAX_LIMIT, MEASUREMENT, TELEMETRY_FIELDS

RESOLVED_VIEW = "buoyline_resolved"


def register_functions(spark: SparkSession, resolved: DataFrame, fields: tuple[str, ...] = TELEMETRY_FIELDS) -> list[str]:
    """Register ``device_history(device, start_at, stop_at, n)`` and ``device_latest(device)`` in the session.

    Start is inclusive, stop exclusive; a null bound is open, a null device is
    every device, a limit outside 1..5000 is an error. Bounds are cast as SQL
    timestamps: text that is none is an error under ANSI mode.
    """
    rows = resolved if "event_date" in resolved.columns else resolved.withColumn("event_date", F.to_date("time"))
    rows.createOrReplaceTempView(RESOLVED_VIEW)
    values = ", ".join(fields)
    returns = f"TABLE (device_id STRING, timestamp STRING, {', '.join(f'{f} DOUBLE' for f in fields)})"
    stamp = "date_format(time, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION device_history(
            device STRING, start_at STRING DEFAULT NULL, stop_at STRING DEFAULT NULL, n INT DEFAULT {HISTORY_DEFAULT_LIMIT})
        RETURNS {returns}
        RETURN SELECT device_id, {stamp}, {values} FROM (
            SELECT *, row_number() OVER (ORDER BY time DESC, arrival_seq DESC) AS place FROM {RESOLVED_VIEW}
            WHERE measurement = '{MEASUREMENT}' AND (device IS NULL OR device_id = device)
              AND (start_at IS NULL OR (time >= CAST(start_at AS TIMESTAMP) AND event_date >= to_date(CAST(start_at AS TIMESTAMP))))
              AND (stop_at IS NULL OR (time < CAST(stop_at AS TIMESTAMP) AND event_date <= to_date(CAST(stop_at AS TIMESTAMP)))))
        WHERE place <= CASE WHEN n BETWEEN 1 AND {HISTORY_MAX_LIMIT} THEN n
                            ELSE CAST(raise_error('INVALID_QUERY: limit is outside 1..{HISTORY_MAX_LIMIT}') AS INT) END
    """)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION device_latest(device STRING DEFAULT NULL)
        RETURNS {returns}
        RETURN SELECT device_id, {stamp.replace('time,', 'newest.time,')}, {', '.join(f'newest.{f}' for f in fields)} FROM (
            SELECT device_id, max_by(struct(time, {values}), struct(time, arrival_seq)) AS newest FROM {RESOLVED_VIEW}
            WHERE measurement = '{MEASUREMENT}' AND (device IS NULL OR device_id = device) GROUP BY device_id)
    """)
    return ["device_history", "device_latest"]
