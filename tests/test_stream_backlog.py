"""Micro-batches of a long backlog: how many there are, and what each costs anew."""

import glob

import pytest

from buoyline.plans import catalog
from buoyline.sources import tables
from buoyline.streaming import jobs
from tests.conftest import SF_SMALL


def compiled(spark) -> int:
    return spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME().getCount()


@pytest.mark.parametrize("batch,messages", [(jobs.hub_batch, tables.legacy_messages), (jobs.ingest_batch, tables.raw_messages)])
def test_later_batches_run_the_code_of_the_first(spark, tmp_path, batch, messages):
    messages(spark, SF_SMALL).repartition(2).write.parquet(f"{tmp_path}/source")
    counts = []
    for batch_id in range(3):
        batch(spark.read.parquet(f"{tmp_path}/source"), batch_id, f"{tmp_path}/out", "2024-02-01T00:00:00Z")
        counts.append(compiled(spark))
    assert counts[2] == counts[1]
    assert {p.rsplit("/", 1)[1] for p in glob.glob(f"{tmp_path}/out/rejects/*=*")} == {"batch_id=0", "batch_id=1", "batch_id=2"}


def test_a_long_backlog_takes_larger_batches_up_to_a_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "STREAM_FILE_ROWS", 5)
    raw = tables.raw_messages(spark, SF_SMALL)  # 1,000 rows
    assert catalog._drop_messages(raw.limit(100), f"{tmp_path}/short") == catalog.STREAM_FILES
    monkeypatch.setattr(catalog, "STREAM_FILES", 2)
    assert catalog._drop_messages(raw, f"{tmp_path}/long") == 1000 // 5 // catalog.STREAM_BATCHES
    monkeypatch.setattr(catalog, "STREAM_FILES_MOST", 7)
    assert catalog._drop_messages(raw, f"{tmp_path}/bounded") == 7
    assert spark.read.parquet(f"{tmp_path}/bounded").exceptAll(spark.read.parquet(f"{tmp_path}/long")).isEmpty()
    assert len(glob.glob(f"{tmp_path}/long/*.parquet")) >= 200
