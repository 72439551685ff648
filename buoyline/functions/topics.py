"""Topic building, parsing and wildcard matching as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from buoyline.schemas import LEGACY_BROADCAST_TARGET, LEGACY_DOMAIN, LEGACY_REGISTER_CALL, TOPIC_KINDS, TOPIC_ROOT


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def build_topic(device_id: Column | str, kind: Column | str, root: str = TOPIC_ROOT) -> Column:
    """``<root>/<device>/<kind>``; NULL when the device is empty or the kind is not allowed."""
    d, k = _col(device_id), _col(kind)
    ok = d.isNotNull() & (d != "") & k.isin(*TOPIC_KINDS)
    return F.when(ok, F.concat_ws("/", F.lit(root), d, k))


def is_telemetry_topic(topic: Column | str) -> Column:
    """Suffix test: any topic ending in ``/telemetry``, deeper ones included."""
    return _col(topic).endswith("/telemetry")


def topic_kind(topic: Column | str) -> Column:
    """Last level of a topic."""
    return F.element_at(F.split(_col(topic), "/"), -1)


def topic_device(topic: Column | str) -> Column:
    """Second level of ``<root>/<device>/<kind>``; NULL for a topic of one level."""
    return F.get(F.split(_col(topic), "/"), F.lit(1))


def legacy_topic(target: Column | str, source: Column | str, small_topic: Column | str) -> Column:
    """``ws/<target>/<source>/<small_topic>``."""
    return F.concat_ws("/", F.lit(LEGACY_DOMAIN), _col(target), _col(source), _col(small_topic))


def register_call_topic(hub_id: Column | str) -> Column:
    return legacy_topic(F.lit(LEGACY_BROADCAST_TARGET), _col(hub_id), F.lit(LEGACY_REGISTER_CALL))


def subscribe_filter(hub_id: str) -> str:
    return f"{LEGACY_DOMAIN}/{hub_id}/+/#"


def parse_legacy_topic(topic: Column | str) -> Column:
    """Struct(domain, target, source, small_topic); NULL unless >= 4 levels under ``ws``.

    Levels after the third are joined back, so ``a/b`` stays one kind.
    """
    parts = F.split(_col(topic), "/")
    n = F.size(parts)
    ok = (n >= 4) & (F.element_at(parts, 1) == LEGACY_DOMAIN)
    return F.when(
        ok,
        F.struct(
            F.element_at(parts, 1).alias("domain"),
            F.element_at(parts, 2).alias("target"),
            F.element_at(parts, 3).alias("source"),
            F.concat_ws("/", F.slice(parts, 4, n - 3)).alias("small_topic"),
        ),
    )


def filter_regex(pattern: str) -> str:
    """Anchored regular expression for an MQTT subscription filter.

    ``+`` matches exactly one level, a trailing ``#`` matches the parent level
    and everything below it. Wildcards do not match topics starting with ``$``.
    """
    levels = pattern.split("/")
    out = []
    for i, level in enumerate(levels):
        last = i == len(levels) - 1
        if level == "#":
            if not last:
                raise ValueError(f"'#' must be the last level: {pattern}")
            out.append("#")
        elif level == "+":
            out.append("[^/]*")
        else:
            if "+" in level or "#" in level:
                raise ValueError(f"wildcard must fill a whole level: {pattern}")
            out.append(re.escape(level))
    if out and out[-1] == "#":
        head = "/".join(out[:-1])
        body = f"{head}(/.*)?" if len(out) > 1 else ".*"  # "/#" has an empty first level
    else:
        body = "/".join(out)
    guard = "(?!\\$)" if levels[0] in ("+", "#") else ""
    return f"^{guard}{body}$"


def topic_matches(topic: Column | str, pattern: str) -> Column:
    return _col(topic).rlike(filter_regex(pattern))
