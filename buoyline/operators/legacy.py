"""The legacy dialect: ``ws/<hub>/<sensor>/<kind>`` topics, spec-driven payloads.

Messages are routed by kind to handlers (registration, measurement, diag).
A payload is parsed against the field spec of its kind: known fields are cast
to their declared type, a failed cast keeps the raw value, unknown fields pass
through, a missing required field or a non-object payload drops the message.
Parsed payloads update per-sensor state and become points in one of two
tables (measurements, diagnostics).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buoyline.functions import json as J
from buoyline.functions.columns import evaluate_once
from buoyline.functions.timefmt import ts_literal
from buoyline.functions.topics import parse_legacy_topic
from buoyline.operators.decode import decode
from buoyline.schemas import (
    LEGACY_DIAG,
    LEGACY_MEASUREMENT,
    LEGACY_REGISTER,
    LEGACY_RENAMES,
    LEGACY_TABLES,
    LEGACY_TIME_KEY,
    FieldSpec,
    legacy_spec,
)

HANDLED_KINDS = (LEGACY_REGISTER, LEGACY_MEASUREMENT, LEGACY_DIAG)
PARSED_KINDS = (LEGACY_MEASUREMENT, LEGACY_DIAG)


def _spec_of(kinds=PARSED_KINDS):
    return {k: legacy_spec(k) for k in kinds}


def classify(raw: DataFrame) -> DataFrame:
    """One row per message: sensor, kind, status and the lenient decode.

    status: ``ignored`` (topic does not parse, or no handler for the kind),
    ``registered``, ``invalid`` (payload not an object / required field
    missing: the handler drops it and state is untouched), ``parsed``.
    """
    d = decode(raw, lenient=True)
    t = parse_legacy_topic(F.col("topic"))
    j = F.col("json")
    parsed_topic = d.select("arrival_seq", "arrival_ts", "topic", t.alias("_t"), "text", "json")
    kind = F.col("_t.small_topic")
    missing = F.lit("")
    for k_name, spec in _spec_of().items():
        req = [f.key for f in spec if f.required]
        names = F.concat_ws(", ", *[F.when(J.member(j, k).isNull(), F.lit(k)) for k in req])
        missing = F.when(kind == k_name, names).otherwise(missing)
    status = (
        F.when(F.col("sensor_id").isNull() | ~F.col("kind").isin(*HANDLED_KINDS), F.lit("ignored"))
        .when(F.col("kind") == LEGACY_REGISTER, F.lit("registered"))
        .when(~F.col("_object"), F.lit("invalid"))
        .when(F.col("_missing") != "", F.lit("invalid"))
        .otherwise(F.lit("parsed"))
    )
    reason = (
        F.when(F.col("sensor_id").isNull(), F.lit("unexpected_topic"))
        .when(~F.col("kind").isin(*HANDLED_KINDS), F.lit("no_handler"))
        .when(F.col("kind") == LEGACY_REGISTER, F.lit(None))
        .when(~F.col("_object"), F.lit("not_an_object"))
        .when(F.col("_missing") != "", F.lit("missing_fields"))
    )
    x = evaluate_once(
        parsed_topic,
        F.col("arrival_seq"),
        F.col("arrival_ts"),
        F.col("topic"),
        F.col("_t.source").alias("sensor_id"),
        kind.alias("kind"),
        F.col("text").alias("payload"),
        j.alias("json"),
        J.is_object(j).alias("_object"),
        missing.alias("_missing"),
    )
    return x.select(
        "arrival_seq", "arrival_ts", "topic", "sensor_id", "kind", "payload", "json",
        status.alias("status"), reason.alias("reason"),
        F.when(reason == "missing_fields", F.col("_missing")).alias("detail"),
    )


def route(classified: DataFrame) -> dict[str, DataFrame]:
    """Split by handler; unknown kinds and bad topics go to ``ignored``."""
    out = {k: classified.where((F.col("kind") == k) & (F.col("status") != "ignored")) for k in HANDLED_KINDS}
    out["ignored"] = classified.where(F.col("status") == "ignored")
    return out


def extra_keys(spec: tuple[FieldSpec, ...], json: Column | None = None) -> Column:
    """Unknown keys, passed through (sorted)."""
    json = F.col("json") if json is None else json
    keys = F.map_keys(F.try_variant_get(json, "$", "map<string,variant>"))
    return F.sort_array(F.array_except(keys, F.array(*[F.lit(f.key) for f in spec])))


def event_time(ts: Column, ts_present_null: Column, ingest_time: str | None) -> Column:
    """ms epoch -> TIMESTAMP; a null ``ts`` means the processing time (None: the message's arrival time)."""
    now = F.col("arrival_ts").cast("timestamp") if ingest_time is None else ts_literal(ingest_time)
    return F.when(ts.isNotNull(), F.timestamp_millis(ts)).when(ts_present_null, now)


def parse(classified: DataFrame, kind: str, ingest_time: str) -> DataFrame:
    """Parsed payloads of one kind: typed spec fields, failed-cast raw values, unknown keys, time."""
    spec = legacy_spec(kind)
    j = F.col("json")
    mine = classified.where((F.col("kind") == kind) & (F.col("status") == "parsed")).select(
        "arrival_seq", "arrival_ts", "sensor_id", "payload", "json",
        J.members(j, [f.key for f in spec]).alias("_m"),
    )
    m = {f.key: F.col("_m")[f.key] for f in spec}
    cast = {f.key: J.v_cast(m[f.key], f.type) for f in spec}
    empty = F.create_map().cast("map<string,string>")
    raw = F.map_concat(*[
        F.when(m[f.key].isNotNull() & cast[f.key].isNull(), F.create_map(F.lit(f.key), F.to_json(m[f.key])))
        .otherwise(empty)
        for f in spec
    ])
    t = m[LEGACY_TIME_KEY] if LEGACY_TIME_KEY in m else J.member(j, LEGACY_TIME_KEY)
    return mine.select(
        "arrival_seq",
        "arrival_ts",
        "sensor_id",
        *[cast[f.key].alias(f.key) for f in spec],
        raw.alias("raw_values"),
        extra_keys(spec, j).alias("extra_keys"),
        event_time(J.v_int(t), F.is_variant_null(t), ingest_time).alias("time"),
        "payload",
    )


def _value_columns(kind: Column, key: Column, v: Column, specs: dict[str, tuple[FieldSpec, ...]]):
    """Stored value of one payload member: (value DOUBLE, value_string STRING, value_type)."""
    t = J.json_type(v)
    spec_type = F.lit(None).cast("string")
    for name, spec in specs.items():
        for f in spec:
            spec_type = F.when((kind == name) & (key == f.key), F.lit(f.type)).otherwise(spec_type)
    as_int = F.try_variant_get(v, "$", "bigint")
    as_float = J.v_float(v)
    is_num = J.is_number_type(t)
    raw_num = F.when(is_num, as_float).when(t == "BOOLEAN", F.try_variant_get(v, "$", "double"))
    raw_type = F.when(is_num & t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("int")).when(
        is_num, F.lit("float")
    ).when(t == "BOOLEAN", F.lit("bool")).when(t == "STRING", F.lit("str"))
    raw_str = F.when(t == "STRING", F.try_variant_get(v, "$", "string"))
    str_cast = (
        F.when(t == "VOID", F.lit("None"))
        .when(t == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
        .otherwise(F.try_variant_get(v, "$", "string"))
    )
    cast_ok = F.when(spec_type == "int", as_int.isNotNull()).when(spec_type == "float", as_float.isNotNull()).when(
        spec_type == "str", F.lit(True)
    ).otherwise(F.lit(False))
    value = F.when(cast_ok & (spec_type == "int"), as_int.cast("double")).when(
        cast_ok & (spec_type == "float"), as_float
    ).when(~cast_ok, raw_num)
    value_string = F.when(cast_ok & (spec_type == "str"), str_cast).when(~cast_ok, raw_str)
    value_type = F.when(cast_ok, spec_type).otherwise(raw_type)
    return value, value_string, value_type


def to_points(classified: DataFrame, kind: str | None, ingest_time: str | None) -> DataFrame:
    """Parsed payloads of one kind -> long points (``ts`` excluded; null, arrays and objects skipped).

    ``kind=None`` takes both kinds in one pass over the messages. A ``ts`` that
    is present but not an integer fails the write: no points.
    """
    specs = {k: legacy_spec(k) for k in (PARSED_KINDS if kind is None else (kind,))}
    tables = F.lit(None).cast("string")
    for k in specs:
        tables = F.when(F.col("kind") == k, F.lit(LEGACY_TABLES[k])).otherwise(tables)
    j = F.col("json")
    ts = J.as_int(j, LEGACY_TIME_KEY)
    ts_member = J.member(j, LEGACY_TIME_KEY)
    ts_null = F.is_variant_null(ts_member)
    base = classified.where(F.col("kind").isin(*specs) & (F.col("status") == "parsed")).select(
        "arrival_seq",
        "sensor_id",
        "kind",
        event_time(ts, ts_null, ingest_time).alias("time"),
        F.explode(F.try_variant_get(j, "$", "map<string,variant>")).alias("key", "v"),
    )
    value, value_string, value_type = _value_columns(F.col("kind"), F.col("key"), F.col("v"), specs)
    return (
        base.where((F.col("key") != LEGACY_TIME_KEY) & F.col("time").isNotNull())
        .select(
            tables.alias("measurement"),
            "sensor_id",
            "time",
            F.col("key").alias("field"),
            value.alias("value"),
            value_string.alias("value_string"),
            value_type.alias("value_type"),
            "arrival_seq",
        )
        .where(F.col("value").isNotNull() | F.col("value_string").isNotNull())
    )


def write_failures(classified: DataFrame, kind: str) -> DataFrame:
    """Parsed payloads whose ``ts`` is present, not null and not an integer: the store write fails."""
    j = F.col("json")
    m = J.member(j, LEGACY_TIME_KEY)
    bad = m.isNotNull() & ~F.is_variant_null(m) & J.as_int(j, LEGACY_TIME_KEY).isNull()
    return classified.where((F.col("kind") == kind) & (F.col("status") == "parsed") & bad).select(
        "arrival_seq", "topic", "payload", F.lit("store").alias("stage"), F.lit("invalid_timestamp").alias("reason"),
        J.as_text(j, LEGACY_TIME_KEY).alias("detail"),
    )


def sensors(classified: DataFrame) -> DataFrame:
    """Per-sensor state: last_seen of any handled message, last measurement, last diag, registered.

    Invalid payloads do not touch the state (and do not create a sensor).
    """
    keys = list(dict.fromkeys(f.key for k in PARSED_KINDS for f in legacy_spec(k)))
    handled = classified.where(F.col("status").isin("registered", "parsed")).select(
        "sensor_id", "kind", "status", "arrival_seq", "arrival_ts", J.members(F.col("json"), keys).alias("_m")
    )
    parsed = F.col("status") == "parsed"
    aggs = [
        F.max("arrival_ts").alias("last_seen"),
        F.max("arrival_seq").alias("last_seq"),
        F.bool_or(F.col("kind") == LEGACY_REGISTER).alias("registered"),
    ]
    for kind, prefix in ((LEGACY_MEASUREMENT, "measurement"), (LEGACY_DIAG, "diag")):
        spec = legacy_spec(kind)
        rec = F.struct(
            F.col("arrival_seq").alias("seq"), *[J.v_cast(F.col("_m")[f.key], f.type).alias(f.key) for f in spec]
        )
        mine = parsed & (F.col("kind") == kind)
        aggs.append(F.max_by(F.when(mine, rec), F.when(mine, F.col("arrival_seq"))).alias(f"last_{prefix}"))
    return handled.groupBy("sensor_id").agg(*aggs)


def merge_sensors(states: DataFrame) -> DataFrame:
    """Merge sensor states computed over separate slices (micro-batches) into one per sensor.

    Each part keeps its own clock: ``last_seen`` is the newest arrival, each payload kind keeps its newest ``seq``, registration is sticky.
    """
    return states.groupBy("sensor_id").agg(
        F.max("last_seen").alias("last_seen"),
        F.max("last_seq").alias("last_seq"),
        F.bool_or("registered").alias("registered"),
        F.max_by("last_measurement", "last_measurement.seq").alias("last_measurement"),
        F.max_by("last_diag", "last_diag.seq").alias("last_diag"),
    )


def remap(parsed_kind: DataFrame, pressure_unit: str = "Pa") -> DataFrame:
    """Documented legacy -> target names (extension). Pressure unit is a parameter: Pa or hPa."""
    if pressure_unit not in ("Pa", "hPa"):
        raise ValueError("pressure_unit must be 'Pa' or 'hPa'")
    cols = []
    for c in parsed_kind.columns:
        new = LEGACY_RENAMES.get(c, c)
        if c == "p":
            expr = F.col(c).cast("double") / 100.0 if pressure_unit == "hPa" else F.col(c)
            cols.append(expr.alias(new))
        elif c == LEGACY_TIME_KEY:
            cols.append(F.date_format(F.timestamp_millis(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(new))
        else:
            cols.append(F.col(c).alias(new))
    return parsed_kind.select(*cols)
