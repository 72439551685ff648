"""Point compaction, Bloom filters, SQL table functions and counted outputs."""

import datetime as dt
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from buoyline.operators import history as H
from buoyline.operators import points as PT
from buoyline.plans.counters import read_counts
from buoyline.plans.functions import register_functions
from buoyline.plans.ingest import ingest_to
from buoyline.sources import compaction, store
from buoyline.streaming import jobs

POINT = "measurement string, device_id string, firmware string, location string, time timestamp, field string, value double, arrival_seq long"


def _points(spark, rows):
    """(device, day, minute, field, value, seq) as points."""
    full = [("environment", d, None, None, dt.datetime(2024, 1, day, 0, m), f, v, s) for d, day, m, f, v, s in rows]
    return spark.createDataFrame(full, POINT)


def _random_rows(seed, first, n=60):
    r = random.Random(seed)
    return [(f"D{r.randrange(3)}", r.randrange(1, 4), r.randrange(4), r.choice(["temperature", "humidity"]), float(r.randrange(100)), first + i)
            for i in range(n)]


def _wide(df):
    cols = ["device_id", "time", "temperature", "humidity", "arrival_seq"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _plain(rows):
    best, last = {}, {}
    for d, day, m, f, v, s in rows:
        at = (d, dt.datetime(2024, 1, day, 0, m))
        if s > best.get((at, f), (-1, 0))[0]:
            best[at, f] = (s, v)
        last[at] = max(last.get(at, -1), s)
    return sorted((*at, best.get((at, "temperature"), (0, None))[1], best.get((at, "humidity"), (0, None))[1], s) for at, s in last.items())


def test_runs_fold_and_later_points_still_win_by_arrival(spark, tmp_path):
    path, root, rows = str(tmp_path / "p"), str(tmp_path / "c"), []
    # The second run arrived before the first: what is folded first is not what wins.
    for i, (run, first) in enumerate((("a", 1000), ("b", 0), ("c", 2000))):
        part = _random_rows(i, first)
        store.write_points(_points(spark, part), f"{path}/run={run}")
        rows += part
        assert _wide(compaction.read_resolved(spark, path, root)) == _plain(rows)  # before it is folded
        assert compaction.compact(spark, path, root) == i + 1
        assert _wide(compaction.read_resolved(spark, path, root)) == _plain(rows)
    assert compaction.compact(spark, path, root) == 3  # nothing new, no new version


def test_only_touched_days_are_written_and_an_unfinished_version_is_not_read(spark, tmp_path):
    path, root = str(tmp_path / "p"), str(tmp_path / "c")
    store.write_points(_points(spark, [("D", 1, 0, "temperature", 1.0, 1), ("D", 2, 0, "temperature", 2.0, 2)]), f"{path}/run=a")
    compaction.compact(spark, path, root)
    store.write_points(_points(spark, [("D", 2, 0, "humidity", 3.0, 3)]), f"{path}/run=b")
    # A crash: version 2 of both days lies there, no manifest names it.
    half = spark.read.parquet(f"{root}/days").where("version = 1").withColumn("temperature", F.lit(-1.0)).withColumn("version", F.lit(2))
    half.write.mode("append").partitionBy("event_date", "version").parquet(f"{root}/days")
    want = [("D", dt.datetime(2024, 1, 1), 1.0, None, 1), ("D", dt.datetime(2024, 1, 2), 2.0, 3.0, 3)]
    assert _wide(compaction.read_resolved(spark, path, root)) == want
    assert compaction.compact(spark, path, root) == 2
    assert _wide(compaction.read_resolved(spark, path, root)) == want
    known = compaction.manifest(spark, root)
    assert known.days == {dt.date(2024, 1, 1): 1, dt.date(2024, 1, 2): 2} and known.parts == {"a", "b"}


def test_run_names_that_look_like_numbers(spark, tmp_path):
    path, root = str(tmp_path / "p"), str(tmp_path / "c")
    store.write_points(_points(spark, [("D", 1, 0, "temperature", 1.0, 1)]), f"{path}/run=7")
    compaction.compact(spark, path, root)
    store.write_points(_points(spark, [("D", 1, 1, "temperature", 2.0, 2)]), f"{path}/run=8")
    assert len(_wide(compaction.read_resolved(spark, path, root))) == 2
    assert compaction.compact(spark, path, root) == 2 and compaction.compact(spark, path, root) == 2


def test_history_of_folded_days_has_no_shuffle(spark, tmp_path):
    path, root = str(tmp_path / "p"), str(tmp_path / "c")
    rows = _random_rows(9, 0, 200)
    store.write_points(_points(spark, rows), f"{path}/run=a")
    compaction.compact(spark, path, root)
    args = ("D1", "2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z", 5)
    df = compaction.history(spark, path, root, *args)
    plan = _plan(df)
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(device_id,D1)" in plan
    assert df.collect() == H.history(store.read_points(spark, path), *args).collect()
    both = dict(limit=2, per_series=True)
    assert sorted(compaction.history(spark, path, root, **both).collect()) == sorted(H.history(store.read_points(spark, path), **both).collect())
    # Points that arrive later are resolved for their day only.
    store.write_points(_points(spark, [("D1", 2, 0, "temperature", 777.0, 10_000)]), f"{path}/run=b")
    assert compaction.history(spark, path, root, *args).collect() == H.history(store.read_points(spark, path), *args).collect()
    with pytest.raises(H.InvalidQuery):
        compaction.history(spark, path, root, limit=0)


def test_batches_of_a_stream_fold_up_to_the_given_one(spark, tmp_path):
    path, root, rows = str(tmp_path / "p"), str(tmp_path / "c"), []
    for batch in range(3):
        part = _random_rows(20 + batch, 100 * batch)
        store.write_points_batch(_points(spark, part), path, batch)
        rows += part
    assert compaction.compact(spark, path, root, upto_batch=1) == 1
    assert compaction.manifest(spark, root).upto == 1
    assert _wide(compaction.read_resolved(spark, path, root)) == _plain(rows)
    assert compaction.compact(spark, path, root) == 2
    assert _wide(compaction.read_resolved(spark, path, root)) == _plain(rows)


def test_a_store_without_runs_is_refused(spark, tmp_path):
    store.write_points(_points(spark, [("D", 1, 0, "temperature", 1.0, 1)]), str(tmp_path / "p"))
    with pytest.raises(ValueError):
        compaction.compact(spark, str(tmp_path / "p"), str(tmp_path / "c"))


def _plan(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def _scanned(df):
    """Rows that the scans of an executed query gave out, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_bloom_filters_skip_row_groups_that_a_range_covers(spark, tmp_path):
    rows = spark.range(200_000).select(
        F.lit("environment").alias("measurement"), F.sha2(F.col("id").cast("string"), 256).alias("device_id"),
        F.lit(None).cast("string").alias("firmware"), F.lit(None).cast("string").alias("location"),
        F.lit("2024-01-01").cast("timestamp").alias("time"), F.lit("temperature").alias("field"), F.lit(1.0).alias("value"), "id")
    rows = rows.coalesce(1).withColumnRenamed("id", "arrival_seq")
    paths = {}
    for name in ("plain", "bloom"):  # unsorted: every row group covers the whole range of device ids
        writer = rows.write.option("parquet.block.size", str(1 << 20))
        paths[name] = str(tmp_path / name)
        (store.pruned_by(writer, "device_id", 20_000) if name == "bloom" else writer).parquet(paths[name])
    one = spark.range(1).select(F.sha2(F.lit("77777"), 256)).first()[0]
    reads = {n: spark.read.parquet(p).where(F.col("device_id") == one) for n, p in paths.items()}
    assert reads["plain"].collect() == reads["bloom"].collect() and len(reads["bloom"].collect()) == 1
    assert _scanned(reads["bloom"]) < _scanned(reads["plain"]) / 3


def test_sql_functions_equal_the_operators_and_push_their_filters(spark, tmp_path):
    path, root = str(tmp_path / "p"), str(tmp_path / "c")
    store.write_points(_points(spark, _random_rows(5, 0, 200)), f"{path}/run=a")
    compaction.compact(spark, path, root)
    register_functions(spark, compaction.read_resolved(spark, path, root))
    df = spark.sql("SELECT * FROM device_history('D1', '2024-01-02T00:00:00Z', '2024-01-04T00:00:00Z', n => 4)")
    want = H.history(store.read_points(spark, path), "D1", "2024-01-02T00:00:00Z", "2024-01-04T00:00:00Z", 4)
    plan = _plan(df)
    assert sorted(df.collect()) == sorted(want.collect()) and df.columns == want.columns
    assert "EqualTo(device_id,D1)" in plan and "TakeOrderedAndProject" in plan and "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    newest = spark.sql("SELECT * FROM device_latest()").collect()
    assert sorted(newest) == sorted(H.history(store.read_points(spark, path), limit=1, per_series=True).collect())
    assert len(spark.sql("SELECT * FROM device_history(NULL, n => 7)").collect()) == 7
    for n in (0, 5001):
        with pytest.raises(PySparkException, match="INVALID_QUERY"):
            spark.sql(f"SELECT * FROM device_history('D1', n => {n})").collect()


def test_counts_of_runs_and_batches(spark, tmp_path, raw_df):
    def msg(seq, payload, topic="sensors/A/telemetry"):
        return (seq, topic, payload if isinstance(payload, str) else json.dumps(payload))

    rows = [msg(1, {"device_id": "A", "temperature": 1}), msg(2, "{"), msg(3, {"temperature": 1}), msg(4, {"device_id": "A"}),
            msg(5, {"device_id": "A", "temperature": "x"}), msg(6, {}, "other/topic"), msg(7, {"device_id": "A", "humidity": 2})]
    want = {("stored", "", 2), ("rejected", "invalid_json", 1), ("rejected", "missing_fields", 1), ("latest", "no_fields", 1),
            ("latest", "uncastable_field", 1), ("ignored", "", 1)}
    for run in ("a", "a"):  # a repeated run replaces its counts
        ingest_to(raw_df(rows), str(tmp_path / "batch"), "2024-01-01T00:00:00Z", run=run)
    assert {tuple(r) for r in read_counts(spark, str(tmp_path / "batch")).collect()} == want
    for batch in (0, 1, 1):
        jobs.ingest_batch(raw_df(rows).repartition(3), batch, str(tmp_path / "stream"), "2024-01-01T00:00:00Z")
    assert {tuple(r) for r in read_counts(spark, str(tmp_path / "stream")).collect()} == {(s, r, 2 * n) for s, r, n in want}
    ingest_to(raw_df([]), str(tmp_path / "none"), "2024-01-01T00:00:00Z", run="a")
    assert read_counts(spark, str(tmp_path / "none")).count() == 0
