"""Readers for the input tables and the message views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from buoyline.sources import fixtures


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    text = sql.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    return spark.sql(text, events=events(spark, sf_dir))


def telemetry_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in long form with colliding (device, day, field) keys."""
    return _view(spark, sf_dir, fixtures.TELEMETRY_LONG)


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw telemetry-dialect messages (topic + JSON text) with every defect class."""
    return _view(spark, sf_dir, fixtures.RAW_MESSAGES)


def legacy_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw legacy-dialect messages (ws/<hub>/<sensor>/<kind>)."""
    return _view(spark, sf_dir, fixtures.LEGACY_MESSAGES)


def status_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and diagnostics messages of the documented extension contract."""
    return _view(spark, sf_dir, fixtures.STATUS_MESSAGES)


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subscription_id, filter) of the consumers of the raw messages, with repeated and invalid rows."""
    return _view(spark, sf_dir, fixtures.SUBSCRIPTIONS)
