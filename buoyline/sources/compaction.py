"""Point compaction: the runs or batches of a day folded into resolved rows, which readers take as they are.

The point store only ever grows, and duplicates resolve on read. Compaction
writes, beside it, one row per (series, time) and day:

    <root>/days/event_date=D/version=N/   resolved rows, ordered by (device, time)
    <root>/manifest/                      one row per version: its days, and the parts of the store folded into it

A version counts once its manifest row is there, which is written last and as
one file; readers take each day's newest version of the manifest and resolve
only days into which later runs or batches wrote. So a range read of folded
days has no shuffle for resolution. An interrupted compaction leaves files that
no manifest names; the next one overwrites them. Versions are never changed
once committed, so running readers keep theirs. One compaction runs at a time.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buoyline.functions.timefmt import parse_bound
from buoyline.operators import history as H
from buoyline.operators.points import resolve_wide
from buoyline.schemas import HISTORY_DEFAULT_LIMIT, MEASUREMENT, SERIES_KEYS, TELEMETRY_FIELDS
from buoyline.sources.store import pruned_by

MANIFEST = "version long, days array<date>, parts array<string>, upto long"


@dataclass
class Manifest:
    """What the committed versions hold: bounded by the numbers of days and of runs, never by rows."""

    version: int = 0
    days: dict[dt.date, int] = field(default_factory=dict)  # a day's newest version
    parts: set[str] = field(default_factory=set)  # runs folded so far
    upto: int = -1  # batches up to this one are folded

    def is_folded(self, part: str) -> Column:
        if part == "batch_id":
            return F.col(part) <= F.lit(self.upto)
        return F.col(part).isin(sorted(self.parts)) if self.parts else F.lit(False)

    def holds(self, days: list[dt.date] | None = None) -> Column:
        """Partition predicate of the newest version of each day (of `days`, or of all)."""
        per_version: dict[int, list[dt.date]] = {}
        for day, version in sorted(self.days.items()):
            if days is None or day in days:
                per_version.setdefault(version, []).append(day)
        cond = F.lit(False)
        for version, of in per_version.items():
            cond = cond | ((F.col("version") == F.lit(version)) & F.col("event_date").isin(of))
        return cond


def manifest(spark: SparkSession, root: str) -> Manifest:
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy("version").collect()
    except AnalysisException as e:  # nothing compacted yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Manifest()
    out = Manifest()
    for r in rows:
        out.version = r["version"]
        out.days.update(dict.fromkeys(r["days"], r["version"]))
        out.parts.update(r["parts"])
        out.upto = max(out.upto, r["upto"])
    return out


def _stored(spark: SparkSession, points_path: str) -> tuple[DataFrame, str]:
    """The point store with the partition column that tells its runs or batches apart."""
    # Run names may look like numbers; as text they compare with the manifest's.
    points = spark.read.option("basePath", points_path).parquet(points_path)
    for part in ("run", "batch_id"):
        if part in points.columns:
            return points.withColumn(part, F.col(part).cast("string" if part == "run" else "long")), part
    raise ValueError(f"{points_path} is no store of runs or batches")


def _in_range(start: str | None, stop: str | None) -> Column:
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("event_date") >= F.lit(parse_bound(start).date()))
    if stop is not None:
        cond = cond & (F.col("event_date") <= F.lit(parse_bound(stop).date()))
    return cond


def _resolved(points: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per (day, series, time), with each field's own arrival so that later rows can still meet it."""
    newest = [F.max(F.when(F.col("field") == f, F.col("arrival_seq"))).alias(f) for f in fields]
    keys = [*SERIES_KEYS, "time", "event_date"]
    present = points.where(F.col("field").isin(*fields))
    values = [F.max_by("value", F.when(F.col("field") == f, F.col("arrival_seq"))).alias(f"v_{f}") for f in fields]
    wide = present.groupBy(*keys).agg(*values, *newest, F.max("arrival_seq").alias("arrival_seq"))
    return wide.select(*keys, *[F.col(f"v_{f}").alias(f) for f in fields], "arrival_seq", F.struct(*fields).alias("arrivals"))


def _long(wide: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Resolved rows as points again, each value with its own arrival."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col("arrivals")[f].alias("arrival_seq")) for f in fields])
    return wide.select(*SERIES_KEYS, "time", "event_date", F.inline(each)).where(F.col("arrival_seq").isNotNull())


def _folded(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/days").parquet(f"{root}/days")


def compact(spark: SparkSession, points_path: str, root: str, upto_batch: int | None = None,
            fields: tuple[str, ...] = TELEMETRY_FIELDS, partitions: int | None = None) -> int:
    """Fold what the store gained since the last version; returns the newest version.

    Only days that gained points are written again, from their newest version
    and the new points. Runs must be finished when they are folded; a run that
    is repeated under its name afterwards is not seen again. Of a stream's
    batches pass the last committed one as `upto_batch` (all by default, for a
    stream that stands still).
    """
    known = manifest(spark, root)
    points, part = _stored(spark, points_path)
    new = points.where(~known.is_folded(part))
    if part == "batch_id" and upto_batch is not None:
        new = new.where(F.col(part) <= F.lit(int(upto_batch)))
    # Partition columns only: this reads directory names and footers, and its rows are directories.
    gained = new.select("event_date", part).distinct().collect()
    if not gained:
        return known.version
    days = sorted({r["event_date"] for r in gained})
    parts = sorted({str(r[part]) for r in gained})
    if part == "run":  # exactly what was listed, should a run begin meanwhile
        new = new.where(F.col(part).isin(parts))
    else:
        new = new.where(F.col(part) <= F.lit(max(int(p) for p in parts)))
    columns = [*SERIES_KEYS, "time", "event_date", "field", "value", "arrival_seq"]
    both = new.where(F.col("event_date").isin(days)).select(*columns)
    if any(d in known.days for d in days):
        both = both.unionByName(_long(_folded(spark, root).where(known.holds(days)), fields).select(*columns))
    version = known.version + 1
    rows = _resolved(both, fields).withColumn("version", F.lit(version))
    keys = ["event_date", "device_id", "time"]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    writer = dealt.sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    pruned_by(writer, "device_id").partitionBy("event_date", "version").parquet(f"{root}/days")
    entry = (version, days, parts if part == "run" else [], max(int(p) for p in parts) if part == "batch_id" else -1)
    spark.createDataFrame([entry], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version


def read_resolved(spark: SparkSession, points_path: str, root: str, start: str | None = None, stop: str | None = None,
                  fields: tuple[str, ...] = TELEMETRY_FIELDS) -> DataFrame:
    """Resolved wide rows of the days of a range: folded days as stored, the others resolved with their later points.

    Equals ``points.resolve_wide`` over the whole store, with `event_date`.
    """
    known = manifest(spark, root)
    points, part = _stored(spark, points_path)
    later = points.where(~known.is_folded(part) & _in_range(start, stop))
    open_days = sorted(r[0] for r in later.select("event_date").distinct().collect())
    columns = [*SERIES_KEYS, "time", "event_date", *fields, "arrival_seq"]
    out = None
    if known.days:
        folded = _folded(spark, root)
        closed = [d for d in known.days if d not in open_days]
        out = folded.where(known.holds(closed) & _in_range(start, stop)).select(*columns)
    if open_days or out is None:
        long = [*SERIES_KEYS, "time", "event_date", "field", "value", "arrival_seq"]
        rest = later.where(F.col("event_date").isin(open_days)).select(*long)
        if any(d in known.days for d in open_days):
            rest = rest.unionByName(_long(folded.where(known.holds(open_days)), fields).select(*long))
        merged = resolve_wide(rest, fields).withColumn("event_date", F.to_date("time")).select(*columns)
        out = merged if out is None else out.unionByName(merged)
    return out


def history(spark: SparkSession, points_path: str, root: str, device_id: str | None = None, start: str | None = None,
            stop: str | None = None, limit: int = HISTORY_DEFAULT_LIMIT, per_series: bool = False,
            measurement: str = MEASUREMENT, fields: tuple[str, ...] = TELEMETRY_FIELDS) -> DataFrame:
    """``history.history`` over the compacted store: filter and top-k, no shuffle for folded days."""
    H.check_params(start, stop, limit)
    wide = H.select_points(read_resolved(spark, points_path, root, start, stop, fields), device_id, start, stop, measurement)
    return H.project_points(H.newest_rows(wide, limit, per_series), fields)
