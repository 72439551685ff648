"""Free SQL over stored points (A9): named views and parameterised queries.

Errors propagate to the caller; a failing query is never turned into an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from buoyline.operators.points import resolve_legacy, resolve_long, resolve_wide


def _resolved(points: DataFrame) -> DataFrame:
    return resolve_legacy(points) if "sensor_id" in points.columns else resolve_long(points)


def views(points: DataFrame | None = None, diagnostics: DataFrame | None = None, measurements: DataFrame | None = None) -> dict[str, DataFrame]:
    """``telemetry`` (resolved, one row per series and time), ``telemetry_points`` (resolved long form).

    ``diagnostics`` and ``measurements`` are long tables of either dialect: the
    hub's own (by sensor, with text values) or telemetry points.
    """
    out = {}
    if points is not None:
        out |= {"telemetry": resolve_wide(points), "telemetry_points": resolve_long(points)}
    for name, table in (("diagnostics", diagnostics), ("measurements", measurements)):
        if table is not None:
            out[name] = _resolved(table)
    return out


def register_views(spark: SparkSession, points: DataFrame | None = None, **tables: DataFrame) -> list[str]:
    """Register the views as session temp views for interactive SQL."""
    made = views(points, **tables)
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return sorted(made)


def query(spark: SparkSession, text: str, points: DataFrame | None = None, **tables: DataFrame) -> DataFrame:
    """Run SQL that names the views as ``{telemetry}``, ``{telemetry_points}``, ``{diagnostics}``, ``{measurements}``."""
    return spark.sql(text, **views(points, **tables))
