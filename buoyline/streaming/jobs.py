"""Structured Streaming jobs: raw messages in, points / latest state / rejects out.

The source is a directory of raw message files (a broker bridge drops them,
or Kafka with the same RAW columns). Each micro-batch is classified once,
persisted, and written to three sinks. Every sink writes its own
``batch_id=<n>`` partition with overwrite, so a replayed batch (after a
failure, from the checkpoint) rewrites exactly its own files: the job is
idempotent without a table format that supports MERGE. A message without a
time gets its own arrival time unless ``ingest_time`` is given, so a replay
under a later clock gives the same rows. Duplicates across batches resolve on read (points: last write wins; latest: newest arrival).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from buoyline.operators import normalize, state
from buoyline.operators.points import to_points
from buoyline.plans import counters
from buoyline.plans.ingest import ingest
from buoyline.schemas import RAW_SCHEMA
from buoyline.sources import store


def raw_stream(spark: SparkSession, source_dir: str, fmt: str = "parquet", max_files: int | None = None, schema=RAW_SCHEMA) -> DataFrame:
    """Streaming scan of raw message files with a fixed schema (RAW unless given; no inference)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", int(max_files))
    return reader.load(source_dir)


def subscribe(raw: DataFrame, pattern: str) -> DataFrame:
    """Keep messages whose topic matches an MQTT subscription filter (``root/#``, ``ws/hub1/+/#``)."""
    from buoyline.functions.topics import topic_matches

    return raw.where(topic_matches("topic", pattern))


OFFSET_BITS = 44  # 17.6e12 offsets per partition; 2^19 partitions


def from_kafka(records: DataFrame) -> DataFrame:
    """Kafka records (key, value, topic, partition, offset, timestamp) -> RAW messages.

    The MQTT topic travels as the record key (a broker bridge writes it there);
    without a key the Kafka topic is used. Arrival order is the offset inside a
    partition; across partitions (the key is a topic, so one device's kinds lie
    in several) it is the broker's timestamp. ``arrival_seq`` packs (timestamp,
    partition, offset) into one decimal, which every ``max_by`` orders rightly.
    """
    place = F.shiftleft(F.col("partition").cast("long"), OFFSET_BITS) + F.col("offset").cast("long")
    millis = F.unix_millis(F.col("timestamp").cast("timestamp")).cast("decimal(19,0)")
    return records.select(
        (millis * F.lit(str(1 << 63)).cast("decimal(19,0)") + place.cast("decimal(19,0)")).cast("decimal(38,0)").alias("arrival_seq"),
        F.col("timestamp").cast("timestamp").alias("arrival_ts"),
        F.coalesce(F.col("key").cast("string"), F.col("topic")).alias("topic"),
        F.col("value").cast("string").alias("payload"),
    )


def _write_batch_partition(df: DataFrame, path: str, batch_id: int) -> None:
    (
        df.withColumn("batch_id", store.batch_label(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def _together(spark: SparkSession, *writes) -> None:
    """Independent writes of one micro-batch at the same time: the few tasks that end one leave cores to the others.

    All have ended when this returns or raises the first one's failure.
    """
    with ThreadPoolExecutor(len(writes)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]
    for write in started:
        write.result()


def ingest_batch(batch: DataFrame, batch_id: int, out_dir: str, ingest_time: str | None = None,
                 keep_tags: bool = False) -> None:
    """One micro-batch: classify once, write points, latest candidates, rejects and counts.

    Rejects go first: that write has no shuffle, so it reads every record in tasks
    that count once each, whatever is lost and repeated.
    """
    out = out_dir.rstrip("/")
    counted, seen = counters.observed(ingest(batch, ingest_time, keep_tags=keep_tags).records)
    recs = counted.persist()
    try:
        _write_batch_partition(normalize.rejects(recs), f"{out}/rejects", batch_id)
        counters.write_counts(batch.sparkSession, seen, f"{out}/counts/batch_id={int(batch_id)}")
        store.write_points_batch(to_points(recs), f"{out}/points", batch_id)
        _write_batch_partition(state.latest(recs), f"{out}/latest_updates", batch_id)
    finally:
        recs.unpersist()


def start_ingest(raw: DataFrame, out_dir: str, checkpoint: str, ingest_time: str | None = None,
                 keep_tags: bool = False, available_now: bool = False,
                 processing_time: str | None = None) -> StreamingQuery:
    """Start the ingest stream; ``checkpoint`` must be on storage every executor shares."""
    writer = raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, bid: ingest_batch(df, bid, out_dir, ingest_time, keep_tags)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_points(spark: SparkSession, out_dir: str) -> DataFrame:
    return store.read_points(spark, f"{out_dir.rstrip('/')}/points").drop("batch_id")


def _fs_list_snapshots(spark: SparkSession, root: str) -> list[int]:
    """Versions ``v=<n>`` below ``root`` whose write committed (``_SUCCESS`` present).

    Without a driver context (Spark Connect) no snapshot is used: still
    correct, since compaction never removes the per-batch candidates.
    """
    try:
        jvm = spark.sparkContext._jvm
    except Exception:
        return []
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def _candidates(spark: SparkSession, out_dir: str, name: str, upto: int | None = None) -> DataFrame:
    """The newest committed snapshot of a state table plus the candidates of later batches.

    With ``upto``, what snapshot ``v=<upto>`` is made of: versions below it and batches up to it.
    """
    out = out_dir.rstrip("/")
    updates = spark.read.parquet(f"{out}/{name}_updates")
    versions = [v for v in _fs_list_snapshots(spark, f"{out}/{name}_snapshot") if upto is None or v < upto]
    if upto is not None:
        updates = updates.where(F.col("batch_id") <= upto)
    if not versions:
        return updates.drop("batch_id")
    snapshot = spark.read.parquet(f"{out}/{name}_snapshot/v={versions[-1]}")
    return snapshot.unionByName(updates.where(F.col("batch_id") > versions[-1]).drop("batch_id"))


def _compact(spark: SparkSession, out_dir: str, name: str, upto_batch: int, fold) -> str:
    root = f"{out_dir.rstrip('/')}/{name}_snapshot"
    path = f"{root}/v={int(upto_batch)}"
    if int(upto_batch) not in _fs_list_snapshots(spark, root):
        fold(_candidates(spark, out_dir, name, upto=int(upto_batch))).write.mode("overwrite").parquet(path)
    return path


def read_latest(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest state per device: the newest committed snapshot plus later per-batch candidates."""
    return state.newest(_candidates(spark, out_dir, "latest"))


def compact_latest(spark: SparkSession, out_dir: str, upto_batch: int) -> str:
    """Fold the candidates of batches ``<= upto_batch`` into snapshot ``v=<upto_batch>``.

    Idempotent (a committed version is left as it is; an unfinished one is
    written again from the versions below it) and safe against a crash:
    readers only use versions whose write committed, so reads stay bounded by
    the number of devices plus the batches since the last snapshot. Old
    ``batch_id`` folders below the snapshot are no longer read and can be
    expired by the storage's retention.
    """
    return _compact(spark, out_dir, "latest", upto_batch, state.newest)


def read_rejects(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir.rstrip('/')}/rejects").drop("batch_id")


def latest_stream(raw: DataFrame, ingest_time: str, by: str = "arrival") -> DataFrame:
    """Native stateful latest-per-device (update/complete mode): one state row per device."""
    return state.latest(ingest(raw, ingest_time).records, by=by)


def rollup_stream(points: DataFrame, every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Windowed rollup of a point stream (extension X7), for ``append`` output.

    The watermark on event time closes a window once no point older than
    ``delay`` can arrive; state is one running aggregate per open window,
    series and field. Points arrive unresolved here: a value rewritten for the
    same (series, time, field) inside one window counts twice, unlike the
    batch ``rollup``; ``tiers`` keeps rollups of a stream exact under rewrites.
    """
    from buoyline.schemas import SERIES_KEYS

    return (
        points.withWatermark("time", delay)
        .groupBy(*SERIES_KEYS, "field", F.window("time", every).alias("w"))
        .agg(
            F.avg("value").alias("avg_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.count("value").alias("n"),
        )
        .select(*SERIES_KEYS, "field", F.col("w.start").alias("bucket"), "avg_value", "min_value", "max_value", "n")
    )


def hub_batch(batch: DataFrame, batch_id: int, out_dir: str, ingest_time: str | None = None) -> None:
    """One micro-batch of the legacy hub: classify once, write both point tables, sensor candidates, rejects."""
    from buoyline.plans.hub import hub
    from buoyline.schemas import LEGACY_BUCKETS, LEGACY_DIAG, LEGACY_MEASUREMENT

    out = out_dir.rstrip("/")
    h = hub(batch, ingest_time)
    cls = h.classified.persist()
    try:
        from buoyline.plans.hub import Hub

        h = Hub(cls, h.ingest_time)
        points = ((LEGACY_MEASUREMENT, h.measurements), (LEGACY_DIAG, h.diagnostics))
        _together(
            batch.sparkSession,
            *[partial(store.write_points_batch, pts, f"{out}/{LEGACY_BUCKETS[kind]}", batch_id, key="sensor_id") for kind, pts in points],
            partial(_write_batch_partition, h.sensors, f"{out}/sensor_updates", batch_id),
            partial(_write_batch_partition, h.rejects, f"{out}/rejects", batch_id),
        )
    finally:
        cls.unpersist()


def start_hub(raw: DataFrame, out_dir: str, checkpoint: str, ingest_time: str | None = None,
              available_now: bool = False, processing_time: str | None = None) -> StreamingQuery:
    """Start the legacy hub as a stream (one foreachBatch, persisted once, four writes)."""
    writer = raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, bid: hub_batch(df, bid, out_dir, ingest_time)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_sensors(spark: SparkSession, out_dir: str) -> DataFrame:
    """Sensor state: the newest committed snapshot merged with later per-batch candidates."""
    from buoyline.operators.legacy import merge_sensors

    return merge_sensors(_candidates(spark, out_dir, "sensor"))


def compact_sensors(spark: SparkSession, out_dir: str, upto_batch: int) -> str:
    """Fold the sensor candidates of batches ``<= upto_batch`` into a snapshot, as ``compact_latest`` does."""
    from buoyline.operators.legacy import merge_sensors

    return _compact(spark, out_dir, "sensor", upto_batch, merge_sensors)
