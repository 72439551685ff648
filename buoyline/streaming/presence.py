"""Duplicate deliveries and online/offline transitions of message streams.

At-least-once delivery repeats messages: ``deduplicated`` keeps one of each,
with state bounded by the watermark. ``transitions`` (a table) and
``transition_stream`` (a stream with timers) give the moments at which devices
come online and go offline: a device is online while ``now - last seen <
timeout``, so it goes offline exactly ``timeout`` after its last message.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from buoyline.functions.timefmt import ts_literal


def deduplicated(raw: DataFrame, identity: Iterable[str] = ("topic", "payload"), delay: str = "10 minutes") -> DataFrame:
    """One of the messages of equal ``identity`` that arrive within ``delay`` of each other.

    Name the columns that tell messages apart: the topic and the bridge's
    message id where there is one. By topic and payload alone, equal readings
    sent twice on purpose count as one until the watermark has passed.
    """
    return raw.withWatermark("arrival_ts", delay).dropDuplicatesWithinWatermark(list(identity))


def transitions(seen: DataFrame, timeout_s: int, now: str | None = None, key: str = "device_id", time: str = "arrival_ts") -> DataFrame:
    """(key, event, time): 'online' at a device's first message and after each gap of the timeout or more, 'offline' where a gap begins.

    Messages of one stretch of ``timeout`` never lie a timeout apart, so their
    first and last are all that matters: they are taken in every task before
    the shuffle, and a device's window sees one row per stretch, however often
    it sends. The last 'offline' of a device needs ``now`` (None: not given).
    """
    micros, t = int(timeout_s) * 1_000_000, F.unix_micros(F.col(time).cast("timestamp"))
    rows = seen.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias(key), t.alias("t"))
    stretches = rows.groupBy(key, F.floor(F.col("t") / micros).alias("stretch")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    w = Window.partitionBy(key).orderBy("stretch")
    near = stretches.select(key, "first", "last", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))
    up = F.col("before").isNull() | (F.col("first") - F.col("before") >= micros)
    ended = F.col("last") + micros <= (F.lit(-(1 << 62)) if now is None else F.unix_micros(ts_literal(now)))
    down = F.when(F.col("after").isNull(), ended).otherwise(F.col("after") - F.col("last") >= micros)
    events = F.array_compact(F.array(
        F.when(up, F.struct(F.lit("online").alias("event"), F.col("first").alias("t"))),
        F.when(down, F.struct(F.lit("offline").alias("event"), (F.col("last") + micros).alias("t")))))
    return near.select(key, F.explode(events).alias("e")).select(key, "e.event", F.timestamp_micros("e.t").alias("time"))


def transition_stream(seen: DataFrame, timeout_s: int, delay: str = "10 minutes", key: str = "device_id", time: str = "arrival_ts") -> DataFrame:
    """The events of ``transitions`` as a stream: 'online' at once, 'offline' by the next message or by a timer of the watermark.

    State is one time per device that is online; a timer removes it. A message
    older than the device's newest changes nothing.
    """
    micros = int(timeout_s) * 1_000_000

    def step(keys, batches, state: GroupState):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "event": ["offline"], "t": [last + micros]})
            return
        times = np.sort(np.concatenate([b["t"].to_numpy(np.int64) for b in batches]))
        last = state.get[0] if state.exists else None
        before = np.append(np.int64(times[0] - micros if last is None else last), times[:-1])
        gap = np.flatnonzero(times - np.maximum.accumulate(before) >= micros)
        ends = [(int(before[i]) + micros, "offline") for i in gap if i or last is not None]
        events = sorted([(int(times[i]), "online") for i in gap] + ends)
        newest = int(max(times[-1], before.max() if last is not None else times[-1]))
        state.update((newest,))
        state.setTimeoutTimestamp(max((newest + micros) // 1000, state.getCurrentWatermarkMs() + 1))
        if events:
            yield pd.DataFrame({key: [keys[0]] * len(events), "event": [e for _, e in events], "t": [t for t, _ in events]})

    rows = seen.where(F.col(key).isNotNull()).withWatermark(time, delay).select(key, time, F.unix_micros(F.col(time)).alias("t"))
    out = rows.groupBy(key).applyInPandasWithState(step, f"{key} string, event string, t long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, "event", F.timestamp_micros("t").alias("time"))
