"""Subscription tables, alarms with hysteresis and mergeable quantiles against plain Python."""

import datetime as dt
import itertools
import random
import re

from pyspark.sql import functions as F

from buoyline.functions.topics import filter_regex
from buoyline.operators import alarms as A
from buoyline.operators import quantiles as Q
from buoyline.operators import subscriptions as S

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def valid(pattern):
    try:
        filter_regex(pattern)
    except ValueError:
        return False
    return True


def test_every_filter_of_small_levels_meets_every_topic(spark):
    names = ["a", "b", "", "$s"]
    topics = ["/".join(t) for n in (1, 2, 3) for t in itertools.product(names, repeat=n)] + ["+", "a/+", "#", "a/#", "a/b/a/b/a"]
    levels = ["a", "", "$s", "+", "#", "a+"]
    filters = ["/".join(f) for n in (1, 2, 3) for f in itertools.product(levels, repeat=n)]
    t = spark.createDataFrame([(x,) for x in topics * 2 + [None]], "topic string")
    f = spark.createDataFrame([(x,) for x in filters + filters[:9] + [None]], "filter string")
    got = [tuple(r) for r in S.matching_filters(t, f, salts=3).collect()]
    want = {(x, p) for p in filters if valid(p) for x in topics if re.search(filter_regex(p), x)}
    assert len(got) == len(set(got)) and set(got) == want
    bad = {r.filter for r in f.where(S.invalid_reason("filter").isNotNull()).collect()}
    assert bad == {p for p in filters if not valid(p)} | {None}


def test_deliveries_keep_repeated_messages_and_hot_topics(spark):
    rng = random.Random(3)
    rows = [(i, "s/hot/t" if i % 3 else f"s/d{rng.randrange(6)}/t", "x") for i in range(600)] + [(7, "s/hot/t", "x")] * 2
    subs = [("one", "s/hot/t"), ("two", "s/+/t"), ("two", "s/hot/#"), ("two", "s/+/t"), ("none", "t/#"), ("bad", "s/#/t"), ("three", "s/d1/+")]
    m = spark.createDataFrame(rows, "seq long, topic string, extra string")
    got = S.deliveries(m, spark.createDataFrame(subs, "subscription_id string, filter string"), salts=4)
    assert got.columns == ["seq", "topic", "extra", "subscription_id"]
    want = sorted((seq, s) for seq, t, _ in rows for s in {s for s, p in subs if valid(p) and re.search(filter_regex(p), t)})
    assert sorted((r.seq, r.subscription_id) for r in got.collect()) == want
    empty = spark.createDataFrame([], "subscription_id string, filter string")
    assert S.deliveries(m, empty).collect() == [] and S.deliveries(m.limit(0), empty).collect() == []


def test_no_cross_join_in_the_walk(spark):
    t = spark.createDataFrame([("a/b",)], "topic string")
    plan = S.matching_filters(t, spark.createDataFrame([("a/+",), ("#",)], "filter string"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


POINT = "measurement string, device_id string, firmware string, location string, time timestamp, field string, value double, arrival_seq long"


def points(spark, rows):
    return spark.createDataFrame([("environment", d, None, None, at(t), f, v, s) for d, t, f, v, s in rows], POINT)


def plain_alarms(samples, up, down):
    out, state = [], 0
    for t, v in samples:
        if v is not None and v == v:
            on, off = (v >= up, v <= down) if up > down else (v <= up, v >= down)
            if on and not state:
                out.append([at(t), None, [], 0])
            if off and state:
                out[-1][1] = at(t)
            state = 1 if on else 0 if off else state
        if state:
            out[-1][2] += [v] if v is not None and v == v else []
            out[-1][3] += 1
    pick = max if up > down else min
    return [(i + 1, a, c, pick(vs), n) for i, (a, c, vs, n) in enumerate(out)]


def test_alarms_over_split_series(spark):
    rng = random.Random(8)
    levels = {"t": (7.0, 3.0), "h": (2.0, 5.0)}
    rows = []
    for device, n in (("hot", 400), ("calm", 30), ("never", 12)):
        for f in ("t", "h", "other"):
            for i in range(n):
                # Long stretches between the levels, so that whole splits hold no mark, and some NaN.
                v = 4.0 if device == "never" or rng.random() < 0.8 else rng.choice([float("nan"), 1.0, 2.0, 3.0, 5.0, 7.0, 9.0])
                rows.append((device, i * 997, f, v, i))
    again = [(d, t, f, 99.0, -1) for d, t, f, _, _ in rows[:50]]  # older writes, which lose
    for split in (1, 7, 10_000):
        got = A.alarms(points(spark, rows + again), levels, split=split).collect()
        for device in ("hot", "calm", "never"):
            for f, (up, down) in levels.items():
                own = sorted((r.number, r.raised_at, r.cleared_at, r.peak, r.samples) for r in got if (r.device_id, r.field) == (device, f))
                assert own == plain_alarms([(t, v) for d, t, g, v, _ in rows if (d, g) == (device, f)], up, down), (split, device, f)
        assert not [r for r in got if r.field == "other"]
    assert A.alarms(points(spark, rows).limit(0), levels).collect() == [] and A.alarms(points(spark, rows), {}).collect() == []


def test_quantiles_of_merged_tiers_stay_within_the_stated_rank_error(spark):
    rng = random.Random(1)
    values = [round(rng.lognormvariate(2, 1), 4) for _ in range(30_000)]
    rows = [(f"d{i % 3}", i * 2, "t", v, i) for i, v in enumerate(values)] + [("d0", 1, "t", float("nan"), 0), ("d0", 3, "t", None, 0)]
    hours = Q.tier(points(spark, rows), "1 hour")
    (day,) = Q.quantiles(Q.coarser(hours, "1 day", ("field",)), {"p50": 0.5, "p95": 0.95}).collect()
    assert (day.n, day.min_value, day.max_value) == (30_000, min(values), max(values))
    for got, share in ((day.p50, 0.5), (day.p95, 0.95)):
        assert abs(sum(v <= got for v in values) / len(values) - share) < 0.0066  # twice the stated error of k = 800
    few = Q.quantiles(Q.tier(points(spark, rows[:501]), "1 day", ("field",)), {"m": 0.5}).first().m
    assert few == sorted(values[:501])[250]  # exact below k values
    assert Q.coarser(hours.limit(0), "1 day").collect() == []
