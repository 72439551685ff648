"""Transitions, duplicate deliveries, exact rollup tiers and moving windows against plain Python."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from buoyline.operators import moving as M
from buoyline.streaming import jobs, presence, tiers

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def plain_transitions(seen, timeout, now):
    out = []
    for device in {d for d, _ in seen}:
        times = sorted(t for d, t in seen if d == device)
        for i, t in enumerate(times):
            if i == 0 or t - times[i - 1] >= timeout:
                out.append((device, "online", at(t)))
            if (i + 1 < len(times) and times[i + 1] - t >= timeout) or (i + 1 == len(times) and t + timeout <= now):
                out.append((device, "offline", at(t + timeout)))
    return sorted(out)


def test_transitions_equal_plain_python(spark):
    rng = random.Random(2)
    # Gaps below, at and above the timeout, ties, and one device with most messages.
    seen = [("hot", t) for t in rng.choices(range(0, 40_000), k=600)] + [(f"d{rng.randrange(5)}", rng.randrange(0, 40_000, 60)) for _ in range(200)]
    df = spark.createDataFrame([(d, at(t)) for d, t in seen] + [(None, at(1)), ("x", None)], "device_id string, arrival_ts timestamp")
    got = presence.transitions(df, 120, at(40_000).isoformat() + "Z")
    assert sorted(map(tuple, got.collect())) == plain_transitions(seen, 120, 40_000)
    assert presence.transitions(df.limit(0), 120).collect() == []


def test_transition_stream_restarts_where_it_stopped(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    parts = [[("a", 0), ("a", 100), ("b", 50)], [("a", 220), ("b", 5000), ("a", 339)], [("c", 9000), ("a", 9000)]]
    for part in parts:  # a run each, from the checkpoint of the one before
        spark.createDataFrame([(d, at(t)) for d, t in part], "device_id string, arrival_ts timestamp").coalesce(1).write.mode("append").parquet(src)
        stream = presence.transition_stream(spark.readStream.schema("device_id string, arrival_ts timestamp").parquet(src), 120, "1 second")
        stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = [e for e in plain_transitions([x for p in parts for x in p], 120, 8999)]
    assert got == want


def test_deduplicated_state_is_bounded_by_the_watermark(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    schema = "topic string, payload string, arrival_ts timestamp"
    for part in [[("t", "x", 0), ("t", "x", 5), ("u", "x", 5)], [("t", "x", 60), ("t", "y", 61)], [("t", "z", 5000)], [("t", "x", 5001)]]:
        spark.createDataFrame([(a, b, at(t)) for a, b, t in part], schema).coalesce(1).write.mode("append").parquet(src)
        once = presence.deduplicated(spark.readStream.schema(schema).parquet(src), delay="10 minutes")
        once.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted((r.topic, r.payload) for r in spark.read.schema(schema).parquet(out).collect())
    assert got == [("t", "x"), ("t", "x"), ("t", "y"), ("t", "z"), ("u", "x")]  # the last x comes after its state has gone


POINT = "measurement string, device_id string, firmware string, location string, time timestamp, field string, value double, arrival_seq long"


def points(spark, rows):
    return spark.createDataFrame([("environment", d, None, None, at(t), f, v, s) for d, t, f, v, s in rows], POINT)


def test_tiers_follow_rewrites_and_replays(spark, tmp_path):
    out = str(tmp_path / "out")
    batches = [[("a", 10, "t", 1.0, 1), ("a", 20, "t", 5.0, 2), ("b", 86_500, "t", 2.0, 3)], [("a", 10, "t", 9.0, 4), ("a", 90_000, "t", 4.0, 5)], [("a", 20, "t", 7.0, 1)]]
    for i, rows in enumerate(batches):
        tiers.tier_batch(points(spark, rows), i, out)
    tiers.tier_batch(points(spark, batches[2]), 2, out)  # a replay
    got = {(r.device_id, r.bucket.day): (r.sum_value, r.min_value, r.max_value, r.n) for r in tiers.read_tier(spark, out).collect()}
    assert got == {("a", 1): (14.0, 5.0, 9.0, 2), ("b", 2): (2.0, 2.0, 2.0, 1), ("a", 2): (4.0, 4.0, 4.0, 1)}
    (week,) = tiers.coarser(tiers.read_tier(spark, out).where("device_id = 'a'"), "7 days").collect()
    assert (week.sum_value, week.n) == (18.0, 3)


def test_moving_windows_over_split_series(spark):
    rng = random.Random(4)
    rows = [("hot", t * 3600, "t", round(rng.uniform(0, 9), 2), t) for t in range(300)] + [("d", t * 50_000, "t", float(t % 4), t) for t in range(12)]
    got = {(r.device_id, r.time): (r.mean_value, r.median_value, r.n) for r in M.moving(points(spark, rows + rows[:5]), 4, split=7).collect()}
    assert len(got) == 312
    for device in ("hot", "d"):
        own = [(at(t), v) for d, t, _, v, _ in rows if d == device]
        for i, (t, _) in enumerate(own):
            seen = [v for _, v in own[max(0, i - 3):i + 1]]
            mean, median, n = got[device, t]
            assert abs(mean - sum(seen) / len(seen)) < 1e-9 and abs(median - statistics.median(seen)) < 1e-9 and n == len(seen)


def test_a_hot_series_spreads_over_window_partitions(spark):
    rows = [("hot", t, "t", 1.0, t) for t in range(1000)]
    parts = M.ranked(points(spark, rows)).select(F.floor(F.col("rank") / 50).alias("part")).distinct().count()
    assert parts == 20
