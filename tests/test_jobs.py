"""Batch jobs that write tables: ingest, the legacy hub, the publisher."""

import json

from buoyline.operators import normalize
from buoyline.plans.hub import hub, hub_to
from buoyline.plans.ingest import ingest, ingest_to
from buoyline.sources import store
from buoyline.sources import tables as TB
from buoyline.sources import fixtures as P

SF = "/root/testdata/sf0.001"


def test_ingest_to_matches_lazy_ingest(spark, tmp_path):
    raw = TB.raw_messages(spark, SF)
    paths = ingest_to(raw, str(tmp_path / "out"), P.INGEST_TIME)
    lazy = ingest(raw, P.INGEST_TIME)
    assert store.read_points(spark, paths["points"]).count() == lazy.points.count()
    assert spark.read.parquet(paths["rejects"]).count() == lazy.rejects.count()
    assert spark.read.parquet(paths["latest"]).count() == lazy.latest().count()
    days = {r[0] for r in store.read_points(spark, paths["points"]).select("event_date").distinct().collect()}
    assert len(days) >= 28  # one directory per day of January


def test_hub_to_routes_two_tables(spark, tmp_path):
    raw = TB.legacy_messages(spark, SF)
    paths = hub_to(raw, str(tmp_path / "hub"), P.INGEST_TIME)
    h = hub(raw, P.INGEST_TIME)
    m = store.read_points(spark, paths["measurement"])
    d = store.read_points(spark, paths["diag"])
    assert m.count() == h.measurements.count() and d.count() == h.diagnostics.count()
    assert {r[0] for r in m.select("measurement").distinct().collect()} == {"sensor_measurement"}
    assert {r[0] for r in d.select("measurement").distinct().collect()} == {"sensor_diag"}
    assert spark.read.parquet(paths["sensors"]).count() == h.sensors.count()
    reasons = {r[0] for r in spark.read.parquet(paths["rejects"]).select("reason").distinct().collect()}
    assert reasons == {"missing_fields"}
    routes = h.routes
    assert routes["ignored"].count() > 0 and routes["registerMe"].count() > 0


def test_publish_round_trip(spark, tmp_path):
    raw = TB.raw_messages(spark, SF)
    msgs = normalize.encode_messages(ingest(raw, P.INGEST_TIME).accepted)
    store.publish(msgs, str(tmp_path / "pub"))
    back = spark.read.json(str(tmp_path / "pub"))
    assert back.count() == msgs.count()
    one = back.first()
    assert one["topic"].startswith("sensors/") and "device_id" in json.loads(one["payload"])


def test_runs_add_up_and_a_repeated_run_replaces_itself(spark, tmp_path, raw_df):
    from buoyline.plans.hub import read_sensors
    from buoyline.plans.ingest import read_latest

    def msg(seq, dev, v):
        return (seq, f"sensors/{dev}/telemetry", json.dumps({"device_id": dev, "timestamp": "2024-01-01T00:00:00Z", "temperature": v}))

    out = str(tmp_path / "runs")
    for run, rows in (("a", [msg(1, "A", 1.0)]), ("b", [msg(2, "B", 2.0)]), ("a", [msg(1, "A", 1.0)])):
        paths = ingest_to(raw_df(rows), out, P.INGEST_TIME, run=run)
    assert {(r["device_id"], r["temperature"]) for r in read_latest(spark, out).collect()} == {("A", 1.0), ("B", 2.0)}
    assert store.read_points(spark, paths["points"]).count() == 2

    def legacy(seq, s):
        return (seq, f"ws/h/{s}/measurement", json.dumps({"ts": 1, "t": 1.5}))

    out = str(tmp_path / "hub-runs")
    for run, rows in (("a", [legacy(1, "S1")]), ("b", [legacy(2, "S2")]), ("a", [legacy(1, "S1")])):
        hub_to(raw_df(rows), out, P.INGEST_TIME, run=run)
    assert {r["sensor_id"] for r in read_sensors(spark, out).collect()} == {"S1", "S2"}


def test_archive_holds_the_expired_points_and_reads_their_days_only(spark, tmp_path):
    from buoyline.operators import rollup as R

    store.write_points(ingest(TB.raw_messages(spark, SF), P.INGEST_TIME).points, str(tmp_path / "p"))
    stored = store.read_points(spark, str(tmp_path / "p"))
    kept, expired = R.split_by_age(stored, P.NOW, 7)
    plan = expired._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    R.archive(stored, P.NOW, 7, str(tmp_path / "archive"))
    back = store.read_points(spark, str(tmp_path / "archive"))
    assert back.count() == expired.select("measurement", "device_id", "time", "field").distinct().count() > 0


def test_legacy_points_and_status_parse_each_message_once(spark):
    from buoyline.plans import catalog

    plan = catalog.QUERIES["legacy_points"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    plan = catalog.QUERIES["retention_split"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    plan = catalog.QUERIES["route_telemetry"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "struct<" not in plan and plan.count("Relation [") == 1


def test_register_views_for_free_sql(spark):
    from buoyline.plans.views import register_views

    pts = ingest(TB.raw_messages(spark, SF), P.INGEST_TIME).points
    names = register_views(spark, pts)
    assert names == ["telemetry", "telemetry_points"]
    n_wide = spark.sql("SELECT count(*) FROM telemetry").first()[0]
    n_long = spark.sql("SELECT count(DISTINCT device_id, time) FROM telemetry_points").first()[0]
    assert n_wide == n_long > 0


def test_retention_split_on_the_stored_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from buoyline.operators import rollup as R

    pts = ingest(TB.raw_messages(spark, SF), P.INGEST_TIME).points
    store.write_points(pts, str(tmp_path / "p"))
    stored = store.read_points(spark, str(tmp_path / "p"))
    kept, expired = R.split_by_age(stored, P.NOW, 7)
    assert kept.count() + expired.count() == stored.count()
    cutoff = F.lit("2024-01-24 00:00:00").cast("timestamp")
    assert kept.where(F.col("time") < cutoff).count() == 0 and expired.where(F.col("time") >= cutoff).count() == 0
    assert "PartitionFilters: [isnotnull(event_date" in kept._jdf.queryExecution().executedPlan().toString()
