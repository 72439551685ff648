"""Latest state per device and the views built on it.

The reference keeps a dict keyed by device that each accepted record
replaces, so the latest state is "last arrival wins". Here it is a grouped
``max_by`` over accepted records: partial aggregation keeps one candidate per
device per task before the shuffle, so a device sending a third of all
messages costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buoyline.functions.timefmt import parse_iso, ts_literal
from buoyline.schemas import DEVICE_STATE, TELEMETRY_FIELDS, UNKNOWN_FIRMWARE

LATEST_COLUMNS = ("device_id", "timestamp", *TELEMETRY_FIELDS, "firmware", "location", "arrival_seq", "arrival_ts", "payload")


def latest(records: DataFrame, by: str = "arrival", columns: tuple[str, ...] = LATEST_COLUMNS,
           only_stored: bool = False) -> DataFrame:
    """One row per device: the whole last record.

    ``by='arrival'`` (the reference): order of arrival, so a late message
    moves ``last_seen`` backwards. ``by='event_time'``: newest event time,
    ties broken by arrival. State is updated before the store write, so by
    default a record the store refused still counts; ``only_stored=True``
    gives the view consistent with the stored points.
    """
    if "status" in records.columns:
        keep = ("stored",) if only_stored else ("stored", "latest")
        records = records.where(F.col("status").isin(*keep))
    cols = [c for c in columns if c in records.columns]
    rec = F.struct(*[F.col(c) for c in cols])
    if by == "arrival":
        key = F.col("arrival_seq")
    elif by == "event_time":
        key = F.struct(parse_iso(F.col("timestamp")).alias("t"), F.col("arrival_seq").alias("s"))
    else:
        raise ValueError(f"by must be 'arrival' or 'event_time', not {by!r}")
    return (
        records.groupBy("device_id")
        .agg(F.max_by(rec, key).alias("r"))
        .select(F.col("r.*"))
        .withColumn("last_seen", F.col("timestamp"))
    )


def newest(candidates: DataFrame) -> DataFrame:
    """One row per device out of latest-state candidates of several runs or batches."""
    cols = [c for c in candidates.columns if c != "device_id"]
    return (
        candidates.groupBy("device_id")
        .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col("arrival_seq")).alias("r"))
        .select("device_id", "r.*")
    )


def device(latest_df: DataFrame, device_id: str) -> DataFrame:
    """State of one device (empty when unknown)."""
    return latest_df.where(F.col("device_id") == F.lit(device_id))


class ResourceNotFound(LookupError):
    code = "RESOURCE_NOT_FOUND"


def require(df: DataFrame) -> DataFrame:
    """Raise ``ResourceNotFound`` when a lookup result is empty (API-style lookups)."""
    if df.isEmpty():
        raise ResourceNotFound("RESOURCE_NOT_FOUND: device not found")
    return df


def sole_device(latest_df: DataFrame) -> DataFrame:
    """No id given: the device if exactly one is known, else empty.

    A global aggregate: each task sends one partial row, so nothing grows
    with the data in the final step.
    """
    cols = latest_df.columns
    agg = latest_df.agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(F.struct(*[F.col(c) for c in cols]), F.col("device_id")).alias("_r")
    )
    return agg.where(F.col("_n") == 1).select("_r.*")


def lookup(latest_df: DataFrame, device_id: str | None = None) -> DataFrame:
    return device(latest_df, device_id) if device_id else sole_device(latest_df)


def is_active(last_seen_ts, now: str, timeout_s: float):
    """``now - last_seen < timeout`` (strict), in microseconds."""
    return (F.unix_micros(ts_literal(now)) - F.unix_micros(last_seen_ts)) < F.lit(int(round(timeout_s * 1_000_000)))


def device_info(latest_df: DataFrame, now: str | None = None, timeout_s: float | None = None) -> DataFrame:
    """Device view: id, state, firmware (or ``unknown``), last_seen.

    Without ``now``/``timeout_s`` the state is the constant ``online`` (the
    reference); with them it is ``online``/``offline`` from the timeout.
    """
    if now is None or timeout_s is None:
        state = F.lit(DEVICE_STATE)
    else:
        active = is_active(parse_iso(F.col("last_seen")), now, timeout_s)
        state = F.when(active, F.lit("online")).otherwise(F.lit("offline"))
    fw = F.coalesce(F.nullif(F.col("firmware"), F.lit("")), F.lit(UNKNOWN_FIRMWARE))
    return latest_df.select(
        "device_id", state.alias("state"), fw.alias("firmware_version"), "last_seen"
    )


def latest_view(latest_df: DataFrame, fields: tuple[str, ...] = TELEMETRY_FIELDS) -> DataFrame:
    """Latest telemetry view: the record's fields (NULL = absent)."""
    cols = [c for c in ("device_id", "timestamp", *fields, "firmware", "location") if c in latest_df.columns]
    return latest_df.select(*cols)


def active_devices(latest_df: DataFrame, now: str, timeout_s: float, last_seen: str = "last_seen") -> DataFrame:
    """Devices seen within ``timeout_s`` seconds before ``now``."""
    c = F.col(last_seen)
    ts = parse_iso(c) if dict(latest_df.dtypes)[last_seen] == "string" else c.cast("timestamp")
    return latest_df.where(is_active(ts, now, timeout_s))
