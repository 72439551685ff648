"""Point and table storage on Parquet: the sink and the scan of the point store.

Layout: ``<root>/<measurement>/event_date=YYYY-MM-DD/part-*.parquet``, rows
sorted by (device_id, time) inside each file so row-group statistics prune
device lookups, and day directories prune time ranges. Files also carry a
Bloom filter of the key, for devices that a row group's range covers but which
it does not hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from buoyline.operators.points import with_event_date

DEVICES_PER_GROUP = 50_000  # distinct keys that a row group's Bloom filter is laid out for, some 64 KB


def pruned_by(writer: DataFrameWriter, key: str, distinct: int = DEVICES_PER_GROUP) -> DataFrameWriter:
    """Write Bloom filters of `key`; a group whose keys fit a dictionary page is pruned by that instead."""
    return (
        writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(int(distinct)))
    )


def write_points(points: DataFrame, path: str, mode: str = "append", partitions: int | None = None,
                 key: str = "device_id") -> None:
    """Batch sink for long points.

    Range partitioning on (event_date, key, time) samples the data first, so
    a device holding a third of all rows is cut into many tasks instead of
    one; each task then writes few day directories, sorted for pruning.
    ``mode='append'`` never rewrites old data; duplicates resolve on read.
    """
    df = with_event_date(points) if "event_date" not in points.columns else points
    keys = ["event_date", key, "time"]
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    writer = dealt.sortWithinPartitions("event_date", key, "time").write.mode(mode)
    pruned_by(writer, key).partitionBy("event_date").parquet(path)


def batch_label(batch_id: int) -> Column:
    """The partition value of a micro-batch, as text: a number would be written into the generated code, text is not.

    All batches then run the same compiled classes, where each compiled (and
    warmed up) its own before. Folder names are the same, readers find a number.
    """
    return F.lit(str(int(batch_id)))


def write_points_batch(points: DataFrame, path: str, batch_id: int, key: str = "device_id") -> None:
    """Micro-batch sink: each batch owns ``batch_id=<n>`` below every day, overwritten on replay.

    A replayed batch rewrites exactly its own files, so the sink is idempotent
    without a table format that supports MERGE. Rows are first brought together
    by day: adaptive execution merges small days and cuts a large one into parts
    of the advisory size, so files and tasks follow the batch's bytes.
    """
    df = with_event_date(points).withColumn("batch_id", batch_label(batch_id))
    writer = (
        df.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", key, "time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
    )
    pruned_by(writer, key).partitionBy("event_date", "batch_id").parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Scan of the point store, all runs; ``event_date`` is the partition column."""
    return spark.read.option("basePath", path).parquet(path).drop("run")


def publish(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Record publisher sink (A7): (topic, payload) messages as JSON lines for a broker bridge.

    ``messages`` comes from ``normalize.encode_messages``; a Kafka sink takes
    the same two columns as key/value with ``format("kafka")``.
    """
    messages.select("topic", "payload").write.mode(mode).json(path)
