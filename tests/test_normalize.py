"""Decode, validation and normalisation rules (telemetry dialect)."""

import json

from buoyline.operators import normalize
from buoyline.plans.ingest import ingest

T = "sensors/BUOY-7/telemetry"
NOW = "2025-03-04T12:00:00Z"


def _records(raw_df, rows, **kw):
    res = ingest(raw_df(rows), NOW, **kw)
    return {r["arrival_seq"]: r.asDict() for r in res.records.collect()}


def test_every_declared_field_reaches_the_record(raw_df):
    values = {"temperature": -3.75, "humidity": 91, "pressure": 987.125, "gas_resistance": 5.5e4, "accel_x": 0.25,
              "accel_y": -0.5, "accel_z": 9.81}
    seen = {"device_id": "quay 12", "timestamp": "2025-03-04T06:05:07.250Z"}
    r = _records(raw_df, [(4, "sensors/quay 12/telemetry", json.dumps(seen | values))])[4]
    assert {f: r[f] for f in values} == values
    assert {k: r[k] for k in seen} == seen and (r["status"], r["ts_defaulted"]) == ("stored", False)
    assert r["event_time"].microsecond == 250_000


def test_missing_timestamp_is_generated_with_z(raw_df):
    r = _records(raw_df, [(1, T, '{"device_id":"BUOY-7","temperature":21.0}')])[1]
    assert r["ts_defaulted"] is True
    assert r["timestamp"] == NOW and r["timestamp"].endswith("Z")
    assert r["status"] == "stored"


def test_falsy_values_count_as_missing(raw_df):
    rows = [
        (1, T, '{"timestamp":"2025-03-04T06:05:00Z","temperature":1}'),
        (2, T, '{"device_id":"","temperature":1}'),
        (3, T, '{"device_id":0,"temperature":1}'),
        (4, T, '{"device_id":false,"temperature":1}'),
        (5, T, '{"device_id":null,"temperature":1}'),
        (6, T, '{"device_id":[],"temperature":1}'),
        (7, T, '{"device_id":{},"temperature":1}'),
        (8, T, '{"device_id":"0","temperature":1}'),
        (9, T, '{"device_id":" ","temperature":1}'),
        (10, T, '{"device_id":"A","timestamp":"","temperature":1}'),
        (11, T, '{"device_id":"A","timestamp":0,"temperature":1}'),
    ]
    r = _records(raw_df, rows)
    for seq in range(1, 8):
        assert r[seq]["status"] == "rejected" and r[seq]["reason"] == "missing_fields", seq
        assert r[seq]["detail"] == "device_id"
    assert r[8]["status"] == "stored" and r[8]["device_id"] == "0"
    assert r[9]["status"] == "stored"
    assert r[10]["ts_defaulted"] and r[11]["ts_defaulted"]


def test_decode_and_route(raw_df):
    rows = [
        (1, "sensors/BUOY-7/status", "not json"),
        (2, "sensors/BUOY-7/status", '{"device_id":"BUOY-7"}'),
        (3, T, "[1,2]"),
        (4, T, "null"),
        (5, "a/b/c/telemetry", '{"device_id":"X","temperature":1}'),
    ]
    r = _records(raw_df, rows)
    assert r[1]["reason"] == "invalid_json" and r[1]["status"] == "rejected"
    assert r[2]["status"] == "ignored" and r[2]["reason"] is None
    assert r[3]["reason"] == "not_an_object" and r[4]["reason"] == "not_an_object"
    assert r[5]["status"] == "stored"  # suffix test: deeper topics pass


def test_value_casts_follow_float_rules(raw_df):
    rows = [
        (1, T, '{"device_id":"A","timestamp":"2024-01-01T00:00:00Z","temperature":"22.4"}'),
        (2, T, '{"device_id":"A","timestamp":"2024-01-01T00:00:00Z","temperature":true}'),
        (3, T, '{"device_id":"A","timestamp":"2024-01-01T00:00:00Z","temperature":"abc","humidity":5}'),
        (4, T, '{"device_id":"A","timestamp":"2024-01-01T00:00:00Z","temperature":null}'),
        (5, T, '{"device_id":"A","timestamp":"garbage","temperature":1}'),
    ]
    r = _records(raw_df, rows)
    assert r[1]["temperature"] == 22.4 and r[1]["status"] == "stored"
    assert r[2]["temperature"] == 1.0
    # the whole point is refused, but the record still becomes "latest"
    assert r[3]["status"] == "latest" and r[3]["reason"] == "uncastable_field" and r[3]["detail"] == "temperature"
    assert r[4]["status"] == "latest" and r[4]["reason"] == "no_fields"
    assert r[5]["status"] == "latest" and r[5]["reason"] == "invalid_timestamp"


def test_tags_dropped_unless_kept(raw_df):
    p = '{"device_id":"A","timestamp":"2024-01-01T00:00:00Z","temperature":1,"firmware":"1.0.0","location":"lab","x":1}'
    assert _records(raw_df, [(1, T, p)])[1]["firmware"] is None
    kept = _records(raw_df, [(1, T, p)], keep_tags=True)[1]
    assert (kept["firmware"], kept["location"]) == ("1.0.0", "lab")


def test_extension_checks(raw_df):
    rows = [
        (1, "sensors/OTHER/telemetry", '{"device_id":"A","timestamp":"2024-01-01T00:00:00Z","temperature":1}'),
        (2, T, '{"device_id":"BUOY-7","timestamp":"10:15","temperature":1}'),
    ]
    r = _records(raw_df, rows, check_topic_device=True, strict_time=True)
    assert r[1]["reason"] == "device_mismatch" and r[1]["detail"] == "OTHER"
    assert r[2]["reason"] == "invalid_timestamp" and r[2]["status"] == "rejected"


def test_encode_messages_sparse_json(raw_df):
    p = '{"device_id":"BUOY-7","timestamp":"2025-03-04T06:05:00Z","temperature":22.4}'
    res = ingest(raw_df([(1, T, p)]), NOW)
    msg = normalize.encode_messages(res.accepted).collect()[0]
    assert msg["topic"] == "sensors/BUOY-7/telemetry"
    assert json.loads(msg["payload"]) == {"device_id": "BUOY-7", "timestamp": "2025-03-04T06:05:00Z",
                                          "temperature": 22.4}


def test_rejects_output(raw_df):
    rows = [(1, T, "not json"), (2, T, '{"temperature":1}'), (3, T, '{"device_id":"A","temperature":"x"}')]
    rej = {r["arrival_seq"]: r for r in ingest(raw_df(rows), NOW).rejects.collect()}
    assert (rej[1]["stage"], rej[1]["reason"]) == ("decode", "invalid_json")
    assert (rej[2]["stage"], rej[2]["reason"]) == ("validate", "missing_fields")
    assert (rej[3]["stage"], rej[3]["reason"]) == ("store", "uncastable_field")


def test_classification_is_evaluated_once(raw_df):
    """A filter on the status must not re-inline the JSON parse into the scan."""
    res = ingest(raw_df([(1, T, '{"device_id":"A","temperature":1}')]), NOW)
    plan = res.rejects._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 1


def test_invalid_utf8_bytes(spark):
    from buoyline.operators.decode import decode

    df = spark.createDataFrame([(b'{"device_id":"A\xff","temperature":1}',), (b'  {"a":1} ',)], "payload binary")
    strict = decode(df).collect()
    assert strict[0]["text"] is None and strict[0]["json"] is None  # rejected as invalid_json
    assert strict[1]["json"] is not None
    lenient = decode(df, lenient=True).collect()
    assert lenient[0]["text"] == '{"device_id":"A�","temperature":1}' and lenient[0]["json"] is not None
    assert lenient[1]["text"] == '{"a":1}'


def test_strict_time_refuses_impossible_months_and_topics_may_be_short(raw_df):
    rows = [
        (1, T, '{"device_id":"BUOY-7","timestamp":"2024-13-45T00:00:00Z","temperature":1}'),
        (2, "lonely", '{"device_id":"BUOY-7","temperature":1}'),
        (3, "/telemetry", '{"device_id":"BUOY-7","temperature":1}'),
    ]
    r = _records(raw_df, rows, check_topic_device=True, strict_time=True)
    assert (r[1]["status"], r[1]["reason"]) == ("rejected", "invalid_timestamp")
    assert r[2]["status"] == "ignored" and r[3]["reason"] == "device_mismatch"


def test_without_ingest_time_the_arrival_time_is_the_default(raw_df):
    res = ingest(raw_df([(5, T, '{"device_id":"BUOY-7","temperature":1}')]), None)
    assert res.records.collect()[0]["timestamp"] == "2024-01-01T00:00:05Z"
