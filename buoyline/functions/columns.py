"""Plan-shaping helpers for column projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, *cols: Column | str) -> DataFrame:
    """Project ``cols`` so each is computed exactly once per row.

    Catalyst pushes a filter below a projection by substituting the projected
    expressions into the condition, with no cost check. For an expensive
    projection (a JSON parse and dozens of member extractions) that means the
    work is repeated inside every pushed filter. Emitting the projection
    through a one-element generator keeps later filters above it: they see
    plain attributes. The columns are computed by a projection below it, where
    common subexpressions are found, which a generator does not do; the
    generator copies nothing but the row it already has.
    """
    computed = df.select(*cols)
    return computed.select(F.inline(F.array(F.struct(*computed.columns))))
