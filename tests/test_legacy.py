"""Legacy dialect: topics, spec-driven parsing, points and sensor state."""

from pyspark.sql import functions as F

from buoyline.functions import topics as TP
from buoyline.operators import legacy as L

NOW = "2025-03-04T12:00:00Z"


def test_topic_parse_and_build(spark):
    df = spark.createDataFrame([("ws/hub1/S1/measurement",), ("ws/hub1/S1/a/b",), ("other/hub1/S1/x",),
                                ("ws/hub1/S1",)], "topic string")
    out = [r["t"] for r in df.select(TP.parse_legacy_topic("topic").alias("t")).collect()]
    assert out[0].asDict() == {"domain": "ws", "target": "hub1", "source": "S1", "small_topic": "measurement"}
    assert out[1]["small_topic"] == "a/b" and out[2] is None and out[3] is None
    b = spark.range(1).select(TP.legacy_topic(F.lit("hub1"), F.lit("S1"), F.lit("diag")).alias("a"),
                              TP.register_call_topic(F.lit("rpi1")).alias("b"),
                              TP.build_topic(F.lit("FS-1"), F.lit("telemetry")).alias("c"),
                              TP.build_topic(F.lit("FS-1"), F.lit("nope")).alias("d"),
                              TP.build_topic(F.lit(""), F.lit("status")).alias("e")).collect()[0]
    assert (b["a"], b["b"], b["c"], b["d"], b["e"]) == (
        "ws/hub1/S1/diag", "ws/all/rpi1/registerCall", "sensors/FS-1/telemetry", None, None)


def test_wildcards(spark):
    df = spark.createDataFrame([("ws/hub1/S1/measurement",), ("ws/hub1",), ("ws/hub2/S1/x",), ("$SYS/x",)],
                               "topic string")
    got = [tuple(r) for r in df.select(
        TP.topic_matches("topic", "ws/hub1/+/#"), TP.topic_matches("topic", "ws/#"),
        TP.topic_matches("topic", "#"), TP.topic_matches("topic", "ws/+/S1/+")).collect()]
    assert got == [(True, True, True, True), (False, True, True, False), (False, True, True, True),
                   (False, False, False, False)]


def _raw(raw_df):
    return raw_df([
        (1, "ws/hub1/S1/measurement", '{"ts":1704067200000,"t":21.5,"p":"3.7","voc":7}'),
        (2, "ws/hub1/S1/measurement", '{"t":1}'),
        (3, "ws/hub1/S1/registerMe", " hello "),
        (4, "ws/hub1/S1/diag", '{"ts":1704067260000,"V":4.1,"rssi":-60,"fw":"v2"}'),
        (5, "ws/hub1/S2/a/b", '{"ts":1}'),
        (6, "x/hub1/S3/measurement", '{"ts":1}'),
        (7, "ws/hub1/S4/measurement", '{"ts":null,"t":"2.5","h":3.9}'),
        (8, "ws/hub1/S4/measurement", '[1]'),
    ])


def test_parse_rules(raw_df):
    cls = L.classify(_raw(raw_df))
    st = {r["arrival_seq"]: (r["status"], r["reason"]) for r in cls.collect()}
    assert st[1] == ("parsed", None) and st[2] == ("invalid", "missing_fields") and st[3] == ("registered", None)
    assert st[5] == ("ignored", "no_handler") and st[6] == ("ignored", "unexpected_topic")
    assert st[8] == ("invalid", "not_an_object")
    m = {r["arrival_seq"]: r for r in L.parse(cls, "measurement", NOW).collect()}
    assert m[1]["t"] == 21.5 and m[1]["p"] is None and m[1]["raw_values"] == {"p": '"3.7"'}
    assert m[1]["extra_keys"] == ["voc"]
    assert m[7]["t"] == 2.5 and m[7]["h"] == 3.9 and m[7]["ts"] is None
    assert str(m[7]["time"]).startswith("2025-03-04 12:00")  # null ts -> processing time


def test_points_keep_raw_values_and_unknown_keys(raw_df):
    cls = L.classify(_raw(raw_df))
    pts = {(r["arrival_seq"], r["field"]): r for r in L.to_points(cls, "measurement", NOW).collect()}
    assert pts[(1, "t")]["value"] == 21.5 and pts[(1, "p")]["value_string"] == "3.7"
    assert pts[(1, "voc")]["value"] == 7.0 and (1, "ts") not in pts
    d = {r["field"]: r for r in L.to_points(cls, "diag", NOW).collect()}
    assert d["fw"]["value_string"] == "v2" and d["rssi"]["value"] == -60.0 and d["rssi"]["value_type"] == "int"
    assert {r["measurement"] for r in d.values()} == {"sensor_diag"}


def test_sensor_state(raw_df):
    st = {r["sensor_id"]: r for r in L.sensors(L.classify(_raw(raw_df))).collect()}
    assert set(st) == {"S1", "S4"}  # S2 has no handler, S3 a foreign root
    s1 = st["S1"]
    assert s1["registered"] and s1["last_measurement"]["seq"] == 1 and s1["last_diag"]["seq"] == 4
    assert s1["last_diag"]["fw"] == "v2"
    assert st["S4"]["last_measurement"]["seq"] == 7 and not st["S4"]["registered"]


def test_remap_units(raw_df):
    cls = L.classify(_raw(raw_df))
    r = L.remap(L.parse(cls, "measurement", NOW).select("arrival_seq", "ts", "t", "p"), "hPa").collect()
    assert {"timestamp", "temperature", "pressure"} <= set(r[0].asDict())
