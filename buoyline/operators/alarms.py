"""Alarms with hysteresis: intervals between a raise and a clear level (documented extension X9).

A sample at or beyond the raise level sets the alarm, one at or beyond the clear
level resets it, and one between the two keeps what was. The state of a sample
thus depends on all before it, but a stretch of samples acts on the state by
three numbers only: its first mark, its last mark and the rises between them.
Such summaries combine associatively. A series is cut into splits of equal size
(``moving.ranked``); each split is a window partition of its own, the summaries
(one row per split) are combined in order, and every split then knows the state
and the number of alarms it starts from. A hot device spreads over its splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buoyline.operators.moving import SPLIT, ranked
from buoyline.operators.points import resolve_long
from buoyline.schemas import SERIES_KEYS


def marks(levels: dict[str, tuple[float, float]]) -> Column:
    """1 where a sample sets its field's alarm, 0 where it resets it, NULL where it does neither.

    ``levels`` holds (raise, clear) per field; a clear level below the raise
    level guards against high values, one above it against low values. NaN,
    NULL and fields without levels leave the state as it is.
    """
    mark = F.lit(None).cast("int")
    v = F.col("value")
    for field, (up, down) in levels.items():
        if up == down:
            raise ValueError(f"{field}: raise and clear level are equal ({up})")
        on, off = (v >= up, v <= down) if up > down else (v <= up, v >= down)
        own = F.when(F.isnan(v), F.lit(None)).when(on, 1).when(off, 0)
        mark = F.when(F.col("field") == field, own).otherwise(mark)
    return mark.cast("int")


def summaries(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Per split: the state before it (``state_in``) and the alarms raised before it (``raised_in``)."""
    own = marked.where("mark IS NOT NULL").groupBy(*keys, "part").agg(
        F.min_by("mark", "rank").alias("first_mark"), F.max_by("mark", "rank").alias("last_mark"), F.sum("rise").alias("rises"))
    # Splits without a mark leave no row here; they take the summary of the split before them in the join below.
    every = marked.select(*keys, "part").distinct().join(_named(own, keys), _same(keys, "part"), "left").drop(*[f"o_{k}" for k in (*keys, "part")])
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stated = every.withColumn("state_in", F.coalesce(F.last("last_mark", ignorenulls=True).over(before), F.lit(0)))
    raised = F.coalesce(F.col("rises"), F.lit(0)) + F.when((F.col("first_mark") == 1) & (F.col("state_in") == 0), 1).otherwise(0)
    return stated.withColumn("raised_in", F.coalesce(F.sum(raised).over(before), F.lit(0))).select(*keys, "part", "state_in", "raised_in")


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"o_{k}" for k in (*keys, "part")})


def _same(keys: list[str], part: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys] + [F.col(part) == F.col(f"o_{part}")]


def alarms(points: DataFrame, levels: dict[str, tuple[float, float]], split: int = SPLIT) -> DataFrame:
    """One row per alarm: series, field, ``number`` (from 1), raised_at, cleared_at (NULL while it lasts), peak and samples.

    Duplicates are resolved first (last write wins). ``peak`` is the value
    farthest beyond the raise level and ``samples`` counts the samples from the
    raise to before the clear. Series without a raise have no row.
    """
    if split < 1:
        raise ValueError("a split holds one sample at least")
    keys = [*SERIES_KEYS, "field"]
    wanted = points.where(F.col("field").isin(*levels)) if levels else points.limit(0)
    rows = ranked(resolve_long(wanted)).withColumn("part", F.floor(F.col("rank") / split)).withColumn("mark", marks(levels))
    inside = Window.partitionBy(*keys, "part").orderBy("rank")
    known = lambda to: F.last("mark", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, to))
    marked = rows.withColumns({"own": known(0), "own_before": known(-1)})
    marked = marked.withColumn("rise", F.when((F.col("mark") == 1) & (F.col("own_before") == 0), 1).otherwise(0))
    joined = marked.join(_named(summaries(marked, keys), keys), _same(keys, "part"))
    joined = joined.withColumns({"state": F.coalesce("own", "state_in"), "state_before": F.coalesce("own_before", "state_in")})
    start = F.when((F.col("state") == 1) & (F.col("state_before") == 0), 1).otherwise(0)
    counted = joined.withColumn("number", F.col("raised_in") + F.sum(start).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    on = F.col("state") == 1
    held = counted.where(on | (F.col("state_before") == 1))
    low = F.col("field").isin(*[f for f, (up, down) in levels.items() if up < down])
    finite = F.when(on & ~F.isnan("value"), F.col("value"))
    return held.groupBy(*keys, "number").agg(
        F.min(F.when(on, F.col("time"))).alias("raised_at"), F.max(F.when(~on, F.col("time"))).alias("cleared_at"),
        F.when(low, F.min(finite)).otherwise(F.max(finite)).alias("peak"), F.count(F.when(on, 1)).alias("samples"))
