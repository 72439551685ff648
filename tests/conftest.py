import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from buoyline.session import REQUIRED_CONF

    ckpt = tempfile.mkdtemp(prefix="buoyline-test-ckpt-")
    b = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", ckpt)
    )
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def raw_df(spark):
    """Build a RAW message frame from (seq, topic, payload) triples."""

    def make(rows):
        from buoyline.schemas import RAW_SCHEMA
        import datetime as dt

        base = dt.datetime(2024, 1, 1)
        data = [(seq, base + dt.timedelta(seconds=seq), topic, payload) for seq, topic, payload in rows]
        return spark.createDataFrame(data, RAW_SCHEMA)

    return make
