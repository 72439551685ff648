"""Points, last write wins, pivot, history and its parameters."""

import datetime as dt

import pytest

from buoyline.operators import history as H
from buoyline.operators import points as PT
from buoyline.plans.ingest import ingest

T = "sensors/BUOY-7/telemetry"
NOW = "2025-03-04T12:00:00Z"


def _points(spark, rows):
    df = spark.createDataFrame(
        [(d, dt.datetime.fromisoformat(t), f, v, s) for d, t, f, v, s in rows],
        "device_id string, time timestamp, field string, value double, arrival_seq long",
    )
    return PT.from_long(df)


def test_a_record_becomes_one_point_per_value(raw_df):
    p = '{"device_id":"quay 12","timestamp":"2025-03-04T06:05:00Z","accel_z":9.81,"gas_resistance":55000}'
    pts = ingest(raw_df([(8, "sensors/quay 12/telemetry", p)]), NOW).points.collect()
    assert sorted((r["field"], r["value"], r["measurement"], r["device_id"], r["arrival_seq"]) for r in pts) == [
        ("accel_z", 9.81, "environment", "quay 12", 8), ("gas_resistance", 55000.0, "environment", "quay 12", 8)]
    assert {r["time"] for r in pts} == {dt.datetime(2025, 3, 4, 6, 5)}


def _tied(spark):
    """10,000 points of 5,000 devices on one time, and one older point."""
    rows = spark.range(10_000).selectExpr(
        "concat('D', id % 5000) AS device_id", "timestamp'2024-01-05 00:00:00' AS time",
        "IF(id < 5000, 'temperature', 'humidity') AS field", "CAST(id AS double) AS value", "id AS arrival_seq")
    old = spark.range(1).selectExpr("'OLD' AS device_id", "timestamp'2024-01-01 00:00:00' AS time", "'humidity' AS field",
                                    "1.0D AS value", "20000L AS arrival_seq")
    return PT.from_long(rows.unionByName(old))


def test_ties_on_one_time_never_gather_unresolved_points(spark):
    pts = _tied(spark)
    one = H.history(pts, None, None, None, limit=1)
    assert [r["device_id"] for r in one.collect()] == ["D4999"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("Exchange SinglePartition")[1:]:
        assert "partial_" in part.split("Exchange")[0] or "LocalLimit" in part or "TakeOrdered" in plan  # partial results only
    assert "Window" not in plan
    each = H.history(pts, None, None, None, limit=1, per_series=True)
    assert each.count() == 5001


def test_legacy_points_resolve_value_text_and_type_together(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("m", "s", t, "f", 1.0, None, "int", 1), ("m", "s", t, "f", None, "x", "str", 3), ("m", "s", t, "f", 2.0, None, "int", 2)],
        "measurement string, sensor_id string, time timestamp, field string, value double, value_string string, value_type string, arrival_seq long")
    r = PT.resolve_legacy(df).collect()
    assert [(x["value"], x["value_string"], x["value_type"], x["arrival_seq"]) for x in r] == [(None, "x", "str", 3)]


def test_last_write_wins_per_field(spark):
    pts = _points(spark, [
        ("A", "2024-01-01 00:00:00", "temperature", 1.0, 10),
        ("A", "2024-01-01 00:00:00", "temperature", 2.0, 30),
        ("A", "2024-01-01 00:00:00", "humidity", 5.0, 20),
        ("A", "2024-01-01 00:00:00", "temperature", 3.0, 25),
    ])
    row = PT.resolve_wide(pts).collect()[0]
    assert (row["temperature"], row["humidity"], row["arrival_seq"]) == (2.0, 5.0, 30)


def test_history_newest_first_limited_and_range(spark):
    rows = [("A", f"2024-01-0{d} 00:00:00", "temperature", float(d), d) for d in range(1, 10)]
    rows.append(("B", "2024-01-05 00:00:00", "temperature", 99.0, 50))
    hist = H.history(_points(spark, rows), "A", "2024-01-02T00:00:00Z", "2024-01-08T00:00:00Z", limit=3).collect()
    assert [r["timestamp"] for r in hist] == ["2024-01-07T00:00:00Z", "2024-01-06T00:00:00Z", "2024-01-05T00:00:00Z"]
    assert [r["temperature"] for r in hist] == [7.0, 6.0, 5.0]
    # stop is exclusive, start inclusive
    full = H.history(_points(spark, rows), "A", "2024-01-02T00:00:00Z", "2024-01-08T00:00:00Z").collect()
    assert [r["timestamp"][:10] for r in full][-1] == "2024-01-02" and len(full) == 6


def test_history_per_series_and_global(spark):
    rows = [(d, f"2024-01-0{i} 00:00:00", "temperature", float(i), i * 10 + k)
            for k, d in enumerate("AB") for i in range(1, 6)]
    g = H.history(_points(spark, rows), None, None, None, limit=2).collect()
    assert len(g) == 2
    s = H.history(_points(spark, rows), None, None, None, limit=2, per_series=True).collect()
    assert sorted((r["device_id"], r["timestamp"][:10]) for r in s) == [
        ("A", "2024-01-04"), ("A", "2024-01-05"), ("B", "2024-01-04"), ("B", "2024-01-05")]


@pytest.mark.parametrize("bad", [("invalid", "2024-01-02T00:00:00Z", 10), ("2024-01-01T00:00:00Z", "10:15", 10),
                                 ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", 5001),
                                 ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", 0)])
def test_history_parameter_check(spark, bad):
    with pytest.raises(H.InvalidQuery):
        H.history(_points(spark, [("A", "2024-01-01 00:00:00", "temperature", 1.0, 1)]), "A", *bad)


def test_envelope_counts_and_empty(spark):
    pts = _points(spark, [("A", "2024-01-01 00:00:00", "temperature", 1.0, 1)])
    hist = H.history(pts, "A", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", limit=10)
    env = H.envelope_for(hist, "A").collect()[0]
    assert env["count"] == 1 and env["points"][0]["timestamp"] == "2024-01-01T00:00:00Z"
    empty = H.envelope_for(H.history(pts, "Z", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"), "Z").collect()[0]
    assert empty["count"] == 0 and empty["points"] == []


def test_history_prunes_scan(spark, tmp_path):
    from buoyline.sources import store

    pts = _points(spark, [("A", "2024-01-01 00:00:00", "temperature", 1.0, 1),
                          ("B", "2024-01-03 00:00:00", "temperature", 2.0, 2)])
    store.write_points(pts, str(tmp_path / "p"))
    scan = store.read_points(spark, str(tmp_path / "p"))
    plan = H.history(scan, "A", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters" in plan and "device_id" in plan and "PartitionFilters" in plan
    assert H.history(scan, "A", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z").count() == 1


def test_history_limit_counts_only_requested_fields(spark):
    rows = [("A", f"2024-01-0{d} 00:00:00", "humidity", float(d), d) for d in range(5, 10)]
    rows += [("A", f"2024-01-0{d} 00:00:00", "temperature", float(d), 100 + d) for d in range(1, 5)]
    hist = H.history(_points(spark, rows), "A", None, None, limit=3, fields=("temperature",)).collect()
    assert [r["timestamp"][:10] for r in hist] == ["2024-01-04", "2024-01-03", "2024-01-02"]


def test_iso_bounds_and_relative_window(spark):
    from buoyline.functions.timefmt import hours_back, is_iso

    for ok in ("2024-01-02T00:00:00Z", "2024-01-02", "2024-01-02T10:15:00+02:00", "2024-01-02T10:15:00.123Z",
               "2024-01-02 10:15:00"):
        assert is_iso(ok), ok
    for bad in ("invalid", "10:15", "2024-13-01T00:00:00Z", "2024-01-32", "", None, "2024/01/02"):
        assert not is_iso(bad), bad
    assert hours_back("2024-01-31T00:00:00Z", 6) == ("2024-01-30T18:00:00Z", "2024-01-31T00:00:00Z")
    pts = _points(spark, [("A", "2024-01-30 20:00:00", "temperature", 1.0, 1),
                          ("A", "2024-01-30 10:00:00", "temperature", 2.0, 2)])
    got = H.recent_history(pts, "A", "2024-01-31T00:00:00Z", hours=6).collect()
    assert [r["temperature"] for r in got] == [1.0]
    for hours in (0, 169):
        with pytest.raises(H.InvalidQuery):
            H.recent_history(pts, "A", "2024-01-31T00:00:00Z", hours=hours)
