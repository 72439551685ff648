"""Quantiles of rollup tiers by mergeable sketches (documented extensions X7, X8).

A mean or a maximum of a day follows from its hours; a median does not. Each
bucket of the finest tier therefore keeps a KLL sketch of its values, built by
Spark's own aggregate (partial in every task, so a hot series never meets in
one), and a coarser tier merges sketches without going back to the samples.
A sketch of at most ``k`` values is exact; beyond that its rank error is about
1.33 % at k = 200 and falls with 1/k (about 0.33 % at the default 800).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buoyline.operators.points import resolve_long
from buoyline.schemas import SERIES_KEYS

K = 800  # accuracy parameter of the sketches


def tier(points: DataFrame, every: str = "1 hour", keys: Sequence[str] = (*SERIES_KEYS, "field"), k: int = K) -> DataFrame:
    """keys, bucket, sketch, n, min_value, max_value per time bucket of resolved points; NULL and NaN values are left out."""
    rows = resolve_long(points).where("value IS NOT NULL AND NOT isnan(value)")
    return rows.groupBy(*keys, F.window("time", every)["start"].alias("bucket")).agg(
        F.kll_sketch_agg_double("value", k).alias("sketch"), F.count("value").alias("n"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def coarser(finer: DataFrame, every: str, keys: Sequence[str] = (*SERIES_KEYS, "field")) -> DataFrame:
    """A coarser tier of the same columns, merged from a finer one; ``keys`` may be fewer than the finer tier's."""
    return finer.groupBy(*keys, F.window("bucket", every)["start"].alias("bucket")).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def quantiles(rolled: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The tier with one column per name in ``shares``, its quantile at that share, in place of the sketch."""
    asked = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))) for name, share in shares.items()}
    return rolled.withColumns(asked).drop("sketch")
