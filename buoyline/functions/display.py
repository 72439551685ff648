"""Presentation projections: local time labels and fixed-digit numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buoyline.functions.timefmt import parse_iso
from buoyline.schemas import ACCEL_FIELDS, DISPLAY_ZONE, EMPTY_DISPLAY, TELEMETRY_FIELDS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_time_label(ts_text: Column | str, zone: str = DISPLAY_ZONE) -> Column:
    """ISO text -> ``yyyy-MM-dd HH:mm:ss CET|CEST`` in the display zone.

    Empty or NULL -> the empty-display mark; text that does not parse is
    returned unchanged. The zone label comes from the offset in force at that
    instant, not from the session zone.
    """
    s = _col(ts_text)
    utc = parse_iso(s)
    local = F.from_utc_timestamp(utc, zone)
    offset = F.unix_seconds(local) - F.unix_seconds(utc)
    label = F.when(offset == 7200, F.lit("CEST")).when(offset == 3600, F.lit("CET")).otherwise(
        F.format_string("UTC%+03d:%02d", (offset / 3600).cast("int"), F.abs(offset % 3600 / 60).cast("int"))
    )
    text = F.concat_ws(" ", F.date_format(local, "yyyy-MM-dd HH:mm:ss"), label)
    return F.when(s.isNull() | (s == ""), F.lit(EMPTY_DISPLAY)).when(utc.isNull(), s).otherwise(text)


def _exact_digits(digits: int):
    """Rounds the stored binary value half-even (1.005 -> 1.00), which the JVM's formatter does not.

    Display rows are few (a history limit at most), so an Arrow-batched UDF is no cost here.
    """

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None or x != x else f"{x:.{digits}f}")

    return run


def fixed_digits(value: Column | str, digits: int = 2, numeric: bool = True) -> Column:
    """Number -> fixed-digit text; NULL -> empty-display mark; non-number text unchanged."""
    v = _col(value)
    fmt = _exact_digits(digits)
    if numeric:
        return F.when(v.isNull(), F.lit(EMPTY_DISPLAY)).otherwise(fmt(v.cast("double")))
    d = F.trim(v.cast("string")).try_cast("double")
    return F.when(v.isNull(), F.lit(EMPTY_DISPLAY)).when(d.isNull(), v.cast("string")).otherwise(
        fmt(d)
    )


def history_display(history: DataFrame, time_col: str = "timestamp", fields=TELEMETRY_FIELDS) -> DataFrame:
    """Display rows of a history result: local time label, 2 digits, 3 for acceleration."""
    cols = []
    for f in history.schema.fields:
        if f.name == time_col:
            cols.append(local_time_label(F.col(f.name)).alias(f.name))
        elif f.name in fields:
            numeric = isinstance(f.dataType, T.NumericType)
            digits = 3 if f.name in ACCEL_FIELDS else 2
            cols.append(fixed_digits(F.col(f.name), digits, numeric).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return history.select(*cols)
