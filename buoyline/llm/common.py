"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import buoyline

from buoyline.session import checkpoint_root

# Rows per Arrow batch. A batch of long documents stays a few dozen MB; the
# operators cut it further into blocks of TEXT_BLOCK bytes before they expand it.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings and the shared checkpoint folder the operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    checkpoint_root(spark)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, as Python workers import it."""
    sc = spark.sparkContext
    if any(name.startswith("buoyline-src") for name in sc._python_includes):
        return
    top = os.path.dirname(os.path.abspath(buoyline.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="buoyline-src-"), f"buoyline-src-{sc.applicationId}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def column(key: str | Column) -> Column:
    """The key column of an operator: a name, or any expression (such as a struct of all columns to carry)."""
    return F.col(key) if isinstance(key, str) else key


def name(key: str | Column) -> str:
    return key if isinstance(key, str) else "key"


def carried(docs: DataFrame) -> Column:
    """All columns as one struct, which an operator carries along whatever their names."""
    return F.struct(*[docs[c] for c in docs.columns])


def identity(key: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart where a key may be null or repeated: the key (nulls last) and the text's hash."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("mark"))
