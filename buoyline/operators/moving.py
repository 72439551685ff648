"""Moving mean and median over the last n samples of a series (documented extension X8).

A window partitioned by series would put a hot device into one task. Here every
sample first gets its rank in its series, from counts per day (which are small)
and a rank inside the day; ranks cut the series into splits of equal size, and
a split also gets the n - 1 samples before its first one (its halo). Each split
is a window partition of its own, so the work spreads however the samples are
dealt over devices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buoyline.operators.points import resolve_long
from buoyline.schemas import SERIES_KEYS

SPLIT = 10_000  # samples of one split


def ranked(resolved: DataFrame) -> DataFrame:
    """Resolved points with ``rank`` (from 0) by time in their series and field."""
    keys = [*SERIES_KEYS, "field"]
    days = resolved.withColumn("day", F.to_date("time"))
    counts = days.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = days.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "day").orderBy("time")) - 1)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "day")]
    joined = inside.alias("a").join(starts.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in (*keys, "time", "value")], (F.col("b.start") + F.col("a.place")).alias("rank"))


def moving(points: DataFrame, n: int, split: int = SPLIT) -> DataFrame:
    """Per sample: mean and exact median of it and the n - 1 samples before it in its series and field, and how many there were.

    Duplicates are resolved first (last write wins). ``split`` bounds the
    samples of one window partition; it must not be below n.
    """
    if n < 1 or split < n:
        raise ValueError(f"a window of {n} samples needs 1 <= n <= split ({split})")
    keys = [*SERIES_KEYS, "field"]
    rows = ranked(resolve_long(points))
    own = F.floor(F.col("rank") / split)
    next_too = F.when(F.col("rank") % split > split - n, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.select("*", F.explode(next_too).alias("part"))
    window = Window.partitionBy(*keys, "part").orderBy("rank").rowsBetween(-(n - 1), 0)
    seen = dealt.withColumn("seen", F.array_sort(F.collect_list("value").over(window)))
    size = F.size("seen")
    middle = (F.element_at("seen", F.floor((size + 1) / 2).cast("int")) + F.element_at("seen", (F.floor(size / 2) + 1).cast("int"))) / 2
    mean = F.aggregate("seen", F.lit(0.0), lambda total, v: total + v) / size
    kept = seen.where(F.floor(F.col("rank") / split) == F.col("part"))
    return kept.select(*keys, "time", "value", mean.alias("mean_value"), middle.alias("median_value"), size.alias("n"))
