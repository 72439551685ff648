"""Time parsing and formatting expressions.

All of them assume ``spark.sql.session.timeZone=UTC`` (see ``session``): a
time string without a zone is UTC, as in the message contract.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 8601 calendar date, optional time with fraction, optional zone.
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|z|[+-]\d{2}(:?\d{2})?)?$"
_ISO_RE = re.compile(ISO_PATTERN)
ISO_Z_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_iso(s: Column | str) -> Column:
    """ISO 8601 text -> TIMESTAMP; NULL for anything else (``'10:15'`` is not today 10:15)."""
    c = _col(s)
    return F.when(c.rlike(ISO_PATTERN), F.try_to_timestamp(F.regexp_replace(c, ",", ".")))


def to_iso_z(ts: Column | str) -> Column:
    """TIMESTAMP -> ``YYYY-MM-DDTHH:MM:SSZ`` (whole seconds)."""
    return F.date_format(_col(ts), ISO_Z_FORMAT)


def is_iso(value: str | None) -> bool:
    """Driver-side check of a query bound, before any plan is built."""
    if not isinstance(value, str) or not _ISO_RE.match(value):
        return False
    try:
        _dt.datetime.fromisoformat(value.replace("Z", "+00:00").replace("z", "+00:00"))
    except ValueError:
        return False
    return True


def parse_bound(value: str) -> _dt.datetime:
    """Query bound -> aware UTC datetime (naive means UTC)."""
    dt = _dt.datetime.fromisoformat(value.replace("Z", "+00:00").replace("z", "+00:00"))
    if dt.tzinfo is None:
        dt = dt.replace(tzinfo=_dt.timezone.utc)
    return dt.astimezone(_dt.timezone.utc)


def ts_literal(value: str) -> Column:
    """A validated bound as a TIMESTAMP literal."""
    return F.lit(parse_bound(value).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp")


def hours_back(now: str, hours: int) -> tuple[str, str]:
    """Bounds of "the last ``hours`` hours before ``now``" as ISO strings."""
    end = parse_bound(now)
    start = end - _dt.timedelta(hours=hours)
    fmt = "%Y-%m-%dT%H:%M:%SZ"
    return start.strftime(fmt), end.strftime(fmt)
