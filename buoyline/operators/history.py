"""History read: range + equality filters, pivot, newest-first top-k, envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buoyline.functions.timefmt import hours_back, is_iso, parse_bound, to_iso_z, ts_literal
from buoyline.operators.points import resolve_wide
from buoyline.schemas import (
    HISTORY_DEFAULT_LIMIT,
    HISTORY_MAX_LIMIT,
    MEASUREMENT,
    SERIES_KEYS,
    TELEMETRY_FIELDS,
    UI_HISTORY_MAX_HOURS,
)


class InvalidQuery(ValueError):
    """Bad query parameters; raised on the driver before any plan is built."""

    code = "INVALID_QUERY"


def check_params(start: str | None, stop: str | None, limit: int) -> None:
    """Bounds must be ISO 8601, 1 <= limit <= 5000. ``start > stop`` is allowed (empty)."""
    for b in (start, stop):
        if b is not None and not is_iso(b):
            raise InvalidQuery(f"INVALID_QUERY: range bound {b!r} is no ISO 8601 time")
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1 or limit > HISTORY_MAX_LIMIT:
        raise InvalidQuery(f"INVALID_QUERY: limit {limit!r} is outside 1..{HISTORY_MAX_LIMIT}")


def select_points(
    points: DataFrame,
    device_id: str | None = None,
    start: str | None = None,
    stop: str | None = None,
    measurement: str = MEASUREMENT,
) -> DataFrame:
    """Range (start inclusive, stop exclusive), measurement and device filters.

    Written as plain predicates on scan columns so Catalyst pushes them into
    the Parquet scan. When the points carry the ``event_date`` partition
    column, the day range is added too, which prunes whole directories.
    """
    cond = F.col("measurement") == F.lit(measurement)
    if device_id is not None:
        cond = cond & (F.col("device_id") == F.lit(device_id))
    has_date = "event_date" in points.columns
    if start is not None:
        cond = cond & (F.col("time") >= ts_literal(start))
        if has_date:
            cond = cond & (F.col("event_date") >= F.lit(parse_bound(start).date()))
    if stop is not None:
        cond = cond & (F.col("time") < ts_literal(stop))
        if has_date:
            cond = cond & (F.col("event_date") <= F.lit(parse_bound(stop).date()))
    return points.where(cond)


def newest_times(points: DataFrame, limit: int) -> DataFrame:
    """Only the points at or after the ``limit``-th newest distinct time.

    Every result row is one (series, time), so no older point can reach the
    answer. Times are collapsed in every task before their shuffle and cut by
    a top-k; the oldest one left is a scalar bound on the points, which thus
    never pass through one task however many of them tie on a time.
    """
    newest = points.groupBy("time").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("time").desc()).limit(limit)
    return points.where(F.col("time") >= newest.agg(F.min("time")).scalar())


def newest_rows(wide: DataFrame, limit: int, per_series: bool = False) -> DataFrame:
    """The newest ``limit`` resolved rows, of all or of each series."""
    order = [F.col("time").desc(), F.col("arrival_seq").desc()]
    if per_series:
        w = Window.partitionBy(*SERIES_KEYS).orderBy(*order)
        return wide.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")
    return wide.orderBy(*order).limit(limit)


def history_rows(
    points: DataFrame,
    device_id: str | None = None,
    start: str | None = None,
    stop: str | None = None,
    limit: int = HISTORY_DEFAULT_LIMIT,
    per_series: bool = False,
    measurement: str = MEASUREMENT,
    fields: tuple[str, ...] = TELEMETRY_FIELDS,
) -> DataFrame:
    """Resolved wide rows, newest first, limited; keeps series keys and ``time``.

    ``per_series=False``: one limit over the whole result (the documented
    contract) -> a top-k that keeps ``limit`` rows per task before merging.
    ``per_series=True``: the limit applies per series (store table
    semantics) -> ``row_number() <= limit``, planned as a window group limit
    whose partial step runs in every task.
    Points are resolved by a hash aggregation that is partial before its
    shuffle. A history of one device reads its points once; the global form over
    all devices first cuts them by ``newest_times``, a second, narrow read that
    spares the shuffle of everything in the range.
    """
    check_params(start, stop, limit)
    selected = select_points(points, device_id, start, stop, measurement).where(F.col("field").isin(*fields))
    cut = device_id is None and not per_series
    wide = resolve_wide(newest_times(selected, limit) if cut else selected, fields)
    return newest_rows(wide, limit, per_series)


def project_points(rows: DataFrame, fields: tuple[str, ...] = TELEMETRY_FIELDS) -> DataFrame:
    """Point projection: device, time at whole seconds as ``...Z`` text, value fields; no tags."""
    return rows.select("device_id", to_iso_z("time").alias("timestamp"), *fields)


def history(
    points: DataFrame,
    device_id: str | None = None,
    start: str | None = None,
    stop: str | None = None,
    limit: int = HISTORY_DEFAULT_LIMIT,
    per_series: bool = False,
    measurement: str = MEASUREMENT,
    fields: tuple[str, ...] = TELEMETRY_FIELDS,
) -> DataFrame:
    """History of one device (or all devices when ``device_id`` is None)."""
    rows = history_rows(points, device_id, start, stop, limit, per_series, measurement, fields)
    return project_points(rows, fields)


def recent_history(points: DataFrame, device_id: str, now: str, hours: int = 6, limit: int = 100, **kw) -> DataFrame:
    """The UI's relative window: the last ``hours`` hours before ``now``."""
    if not isinstance(hours, int) or hours < 1 or hours > UI_HISTORY_MAX_HOURS:
        raise InvalidQuery(f"INVALID_QUERY: hours must be between 1 and {UI_HISTORY_MAX_HOURS}.")
    start, stop = hours_back(now, hours)
    return history(points, device_id, start, stop, limit, **kw)


def envelope(history_df: DataFrame, fields: tuple[str, ...] = TELEMETRY_FIELDS) -> DataFrame:
    """``{device_id, points, count}`` per device; points newest first.

    For histories only: their limit bounds the rows (of each series when
    per-series), and with them what one device's list can hold.
    """
    pt = F.struct(F.col("timestamp"), *[F.col(f) for f in fields])
    return history_df.groupBy("device_id").agg(
        F.sort_array(F.collect_list(pt), asc=False).alias("points"), F.count(F.lit(1)).alias("count")
    )


def envelope_for(history_df: DataFrame, device_id: str, fields: tuple[str, ...] = TELEMETRY_FIELDS) -> DataFrame:
    """Envelope of one requested device; an empty history gives count 0, not an error."""
    spark = history_df.sparkSession
    env = envelope(history_df.where(F.col("device_id") == device_id), fields)
    pt_type = env.schema["points"].dataType
    empty = spark.range(1).select(
        F.lit(device_id).alias("device_id"),
        F.array().cast(pt_type).alias("points"),
        F.lit(0).cast("long").alias("count"),
    )
    both = env.unionByName(empty)
    return both.groupBy("device_id").agg(
        F.max_by("points", "count").alias("points"), F.max("count").alias("count")
    )
