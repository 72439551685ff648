"""Latest state, device views, lookups and activity."""

import pytest

from buoyline.operators import state as S
from buoyline.plans.ingest import ingest

NOW = "2025-03-04T12:00:00Z"


def _t(d):
    return f"sensors/{d}/telemetry"


def _latest(raw_df, rows, **kw):
    return ingest(raw_df(rows), NOW).latest(**kw)


def test_registry_keeps_last_record_by_arrival(raw_df):
    rows = [
        (1, _t("A"), '{"device_id":"A","timestamp":"2024-01-02T00:00:00Z","temperature":1}'),
        (2, _t("A"), '{"device_id":"A","timestamp":"2024-01-01T00:00:00Z","humidity":2}'),  # late
    ]
    r = _latest(raw_df, rows).collect()[0]
    # whole record replaced; last_seen moves backwards on a late message
    assert (r["temperature"], r["humidity"], r["last_seen"]) == (None, 2.0, "2024-01-01T00:00:00Z")
    e = _latest(raw_df, rows, by="event_time").collect()[0]
    assert (e["temperature"], e["last_seen"]) == (1.0, "2024-01-02T00:00:00Z")


def test_latest_includes_records_the_store_refused(raw_df):
    rows = [(1, _t("A"), '{"device_id":"A","timestamp":"2024-01-02T00:00:00Z","temperature":"abc"}')]
    res = ingest(raw_df(rows), NOW)
    assert res.latest().count() == 1 and res.points.count() == 0
    assert res.latest(only_stored=True).count() == 0  # the view consistent with the store


def test_device_view_and_lookups(raw_df):
    rows = [(1, _t("A"), '{"device_id":"A","timestamp":"2025-03-04T11:59:00Z","temperature":1}'),
            (2, _t("B"), '{"device_id":"B","timestamp":"2025-03-04T10:00:00Z","temperature":1}')]
    latest = _latest(raw_df, rows)
    info = {r["device_id"]: r for r in S.device_info(latest).collect()}
    assert info["A"]["state"] == "online" and info["A"]["firmware_version"] == "unknown"
    timed = {r["device_id"]: r["state"] for r in S.device_info(latest, NOW, 120).collect()}
    assert timed == {"A": "online", "B": "offline"}
    assert S.lookup(latest, "A").count() == 1
    assert S.sole_device(latest).count() == 0  # two devices: nobody is "the" device
    assert S.sole_device(S.device(latest, "B")).collect()[0]["device_id"] == "B"
    with pytest.raises(LookupError):
        S.require(S.lookup(latest, "missing"))
    act = [r["device_id"] for r in S.active_devices(latest, NOW, 120).collect()]
    assert act == ["A"]


def test_active_is_strict(raw_df):
    rows = [(1, _t("A"), '{"device_id":"A","timestamp":"2025-03-04T11:58:00Z","temperature":1}')]
    latest = _latest(raw_df, rows)
    assert S.active_devices(latest, NOW, 120).count() == 0
    assert S.active_devices(latest, NOW, 121).count() == 1


def test_tags_reach_points_and_device_view_when_kept(raw_df):
    p = '{"device_id":"BUOY-7","timestamp":"2025-03-04T06:05:00Z","firmware":"1.0.0","temperature":22.4}'
    res = ingest(raw_df([(1, _t("BUOY-7"), p)]), NOW, keep_tags=True)
    pt = res.points.collect()[0]
    assert (pt["measurement"], pt["device_id"], pt["firmware"], pt["field"], pt["value"]) == (
        "environment", "BUOY-7", "1.0.0", "temperature", 22.4)
    view = S.device_info(S.lookup(res.latest())).collect()[0]  # no id: the sole device
    assert (view["device_id"], view["firmware_version"], view["last_seen"]) == (
        "BUOY-7", "1.0.0", "2025-03-04T06:05:00Z")
    lat = S.latest_view(res.latest()).collect()[0]
    assert (lat["device_id"], lat["timestamp"], lat["temperature"]) == ("BUOY-7", "2025-03-04T06:05:00Z", 22.4)
