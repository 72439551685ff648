"""Registered queries: name -> (Spark plan builder, DuckDB oracle SQL).

Every query reads the given tables (``events`` and the message views Spark
derives from it), so its work grows with the data. Times leave as
``YYYY-MM-DDTHH:MM:SSZ`` text, the contract's output format, so that both
engines report one type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buoyline.functions import display as D
from buoyline.functions import topics as TP
from buoyline.functions.timefmt import to_iso_z
from buoyline.operators import history as H
from buoyline.operators import legacy as L
from buoyline.operators import normalize as N
from buoyline.operators import points as PT
from buoyline.operators import rollup as R
from buoyline.operators import state as S
from buoyline.operators.decode import decode
from buoyline.plans import oracle_sql as O
from buoyline.plans.ingest import ingest
from buoyline.schemas import TELEMETRY_FIELDS
from buoyline.sources import fixtures as P
from buoyline.sources import tables as TB

FIELDS = TELEMETRY_FIELDS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return deco


def _ingested(spark: SparkSession, sf_dir: str, **kw):
    return ingest(TB.raw_messages(spark, sf_dir), P.INGEST_TIME, **kw)


def _raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).points


def _tlong_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PT.from_long(TB.telemetry_long(spark, sf_dir))


def _fields_out(prefix: str = "") -> str:
    return ", ".join(f"{prefix}{f}" for f in FIELDS)


# --------------------------------------------------------------------------- decode, route, validate


@register(
    "ingest_rejects",
    f"""
WITH {O.CLASSIFIED}
SELECT arrival_seq, topic, payload,
       CASE WHEN reason = 'invalid_json' THEN 'decode' WHEN status = 'rejected' THEN 'validate' ELSE 'store' END AS stage,
       reason,
       CASE WHEN reason = 'missing_fields' THEN 'device_id'
            WHEN reason = 'uncastable_field' THEN failed
            WHEN reason = 'invalid_timestamp' THEN timestamp END AS detail
FROM c WHERE reason IN ('invalid_json','not_an_object','missing_fields','device_mismatch','invalid_timestamp','uncastable_field')
""",
)
def q_ingest_rejects(spark, sf_dir):
    return _ingested(spark, sf_dir).rejects


@register(
    "reject_counts",
    f"""
WITH {O.CLASSIFIED}
SELECT status, coalesce(reason, '') AS reason, count(*) AS n FROM c GROUP BY status, coalesce(reason, '')
""",
)
def q_reject_counts(spark, sf_dir):
    recs = _ingested(spark, sf_dir).records
    return recs.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "route_telemetry",
    f"""
WITH {O.CLASSIFIED}
SELECT arrival_seq, topic, split_part(topic, '/', 2) AS topic_device FROM c WHERE json_ok AND tele
""",
)
def q_route_telemetry(spark, sf_dir):
    """Topic and JSON validity only: the payload's members are not extracted."""
    decoded = decode(TB.raw_messages(spark, sf_dir).where(TP.is_telemetry_topic("topic")))
    return decoded.where(F.col("json").isNotNull()).select(
        "arrival_seq", "topic", TP.topic_device("topic").alias("topic_device"))


@register(
    "normalize_records",
    f"""
WITH {O.CLASSIFIED}
SELECT arrival_seq, device_id, timestamp, ts_defaulted, {O.ts_out('event_time')} AS event_time,
       {_fields_out()}, status, reason
FROM c WHERE status IN ('stored', 'latest')
""",
)
def q_normalize_records(spark, sf_dir):
    acc = _ingested(spark, sf_dir).accepted
    return acc.select(
        "arrival_seq", "device_id", "timestamp", "ts_defaulted", to_iso_z("event_time").alias("event_time"),
        *FIELDS, "status", "reason",
    )


@register(
    "encode_messages",
    f"""
WITH {O.CLASSIFIED}
SELECT arrival_seq,
       'sensors/' || device_id || '/telemetry' AS topic,
       '{{"device_id":"' || device_id || '","timestamp":"' || timestamp || '"'
       || {' || '.join(f"coalesce(',\"{f}\":' || CAST({f} AS VARCHAR), '')" for f in FIELDS)} || '}}' AS payload
FROM c WHERE status IN ('stored', 'latest')
""",
)
def q_encode_messages(spark, sf_dir):
    acc = _ingested(spark, sf_dir).accepted
    return N.encode_messages(acc)


# --------------------------------------------------------------------------- topics


@register(
    "topic_build",
    f"""
WITH raw AS ({P.RAW_MESSAGES})
SELECT arrival_seq,
       CASE WHEN parts[2] <> '' AND parts[-1] IN ('status','telemetry','diagnostics')
            THEN 'sensors/' || parts[2] || '/' || parts[-1] END AS topic,
       concat_ws('/', 'ws/hub1', parts[2], parts[-1]) AS legacy_topic,
       'ws/all/hub1/registerCall' AS register_call
FROM (SELECT arrival_seq, string_split(topic, '/') AS parts FROM raw)
""",
)
def q_topic_build(spark, sf_dir):
    raw = TB.raw_messages(spark, sf_dir)
    dev, kind = TP.topic_device("topic"), TP.topic_kind("topic")
    return raw.select(
        "arrival_seq",
        TP.build_topic(dev, kind).alias("topic"),
        TP.legacy_topic(F.lit("hub1"), dev, kind).alias("legacy_topic"),
        TP.register_call_topic(F.lit("hub1")).alias("register_call"),
    )


@register(
    "topic_parse",
    f"""
WITH l AS ({P.LEGACY_MESSAGES}), s AS (SELECT arrival_seq, string_split(topic, '/') AS parts FROM l)
SELECT arrival_seq,
       CASE WHEN len(parts) >= 4 AND parts[1] = 'ws' THEN parts[1] END AS domain,
       CASE WHEN len(parts) >= 4 AND parts[1] = 'ws' THEN parts[2] END AS target,
       CASE WHEN len(parts) >= 4 AND parts[1] = 'ws' THEN parts[3] END AS source,
       CASE WHEN len(parts) >= 4 AND parts[1] = 'ws' THEN array_to_string(parts[4:], '/') END AS small_topic
FROM s
""",
)
def q_topic_parse(spark, sf_dir):
    t = TP.parse_legacy_topic("topic")
    return TB.legacy_messages(spark, sf_dir).select(
        "arrival_seq", t["domain"].alias("domain"), t["target"].alias("target"), t["source"].alias("source"),
        t["small_topic"].alias("small_topic"),
    )


@register(
    "topic_match",
    f"""
WITH l AS ({P.LEGACY_MESSAGES})
SELECT arrival_seq,
       regexp_matches(topic, '^ws/hub1/[^/]*(/.*)?$') AS hub_filter,
       regexp_matches(topic, '^ws/[^/]*/[^/]*/measurement$') AS measurement_filter,
       NOT starts_with(topic, '$') AS all_filter
FROM l
""",
)
def q_topic_match(spark, sf_dir):
    return TB.legacy_messages(spark, sf_dir).select(
        "arrival_seq",
        TP.topic_matches("topic", TP.subscribe_filter("hub1")).alias("hub_filter"),
        TP.topic_matches("topic", "ws/+/+/measurement").alias("measurement_filter"),
        TP.topic_matches("topic", "#").alias("all_filter"),
    )


# --------------------------------------------------------------------------- points and history


@register(
    "points_long",
    f"""
WITH {O.CLASSIFIED}, {O.POINTS}
SELECT measurement, device_id, {O.ts_out('time')} AS time, field, value, arrival_seq FROM points
""",
)
def q_points_long(spark, sf_dir):
    pts = _raw_points(spark, sf_dir)
    return pts.select("measurement", "device_id", to_iso_z("time").alias("time"), "field", "value", "arrival_seq")


@register(
    "points_resolved",
    f"""
WITH {O.TLONG_POINTS}, w AS ({O.wide_from()})
SELECT device_id, {O.ts_out('time')} AS time, {_fields_out()}, arrival_seq FROM w
""",
)
def q_points_resolved(spark, sf_dir):
    wide = PT.resolve_wide(_tlong_points(spark, sf_dir))
    return wide.select("device_id", to_iso_z("time").alias("time"), *FIELDS, "arrival_seq")


def _history_oracle(points_cte: str, device: str | None, limit: int, per_series: bool = False) -> str:
    where = f"measurement = 'environment' AND time >= TIMESTAMP '{P.HISTORY_FROM[:10]} {P.HISTORY_FROM[11:19]}' " \
            f"AND time < TIMESTAMP '{P.HISTORY_TO[:10]} {P.HISTORY_TO[11:19]}'"
    if device:
        where += f" AND device_id = '{device}'"
    if per_series:
        return f"""
WITH {points_cte}, w AS ({O.wide_from(where=where)}),
r AS (SELECT *, row_number() OVER (PARTITION BY measurement, device_id, firmware, location
                                   ORDER BY time DESC, arrival_seq DESC) AS rn FROM w)
SELECT device_id, {O.ts_out('time')} AS timestamp, {_fields_out()} FROM r WHERE rn <= {limit}
"""
    return f"""
WITH {points_cte}, w AS ({O.wide_from(where=where)})
SELECT device_id, {O.ts_out('time')} AS timestamp, {_fields_out()} FROM w
ORDER BY time DESC, arrival_seq DESC LIMIT {limit}
"""


@register("history_device", _history_oracle(f"{O.CLASSIFIED}, {O.POINTS}", P.HISTORY_DEVICE, P.HISTORY_LIMIT))
def q_history_device(spark, sf_dir):
    """The main read path: raw messages -> points -> history of one device."""
    return H.history(_raw_points(spark, sf_dir), P.HISTORY_DEVICE, P.HISTORY_FROM, P.HISTORY_TO, P.HISTORY_LIMIT)


def _recent_oracle() -> str:
    start, stop = "2024-01-24 00:00:00", "2024-01-31 00:00:00"  # the last 168 hours before NOW
    return f"""
WITH {O.CLASSIFIED}, {O.POINTS}, w AS ({O.wide_from(where=f"measurement = 'environment' AND device_id = '{P.HISTORY_DEVICE}' AND time >= TIMESTAMP '{start}' AND time < TIMESTAMP '{stop}'")})
SELECT device_id, {O.ts_out('time')} AS timestamp, {_fields_out()} FROM w ORDER BY time DESC, arrival_seq DESC LIMIT 100
"""


@register("history_recent", _recent_oracle())
def q_history_recent(spark, sf_dir):
    """The UI window: the last 168 hours before ``now``, limit 100."""
    return H.recent_history(_raw_points(spark, sf_dir), P.HISTORY_DEVICE, P.NOW, hours=168, limit=100)


@register("history_resolved_device", _history_oracle(O.TLONG_POINTS, P.HISTORY_DEVICE, P.HISTORY_LIMIT))
def q_history_resolved_device(spark, sf_dir):
    """History over colliding writes: last write wins per field, then pivot, top-k."""
    return H.history(_tlong_points(spark, sf_dir), P.HISTORY_DEVICE, P.HISTORY_FROM, P.HISTORY_TO, P.HISTORY_LIMIT)


@register("history_per_series", _history_oracle(O.TLONG_POINTS, None, P.HISTORY_LIMIT, per_series=True))
def q_history_per_series(spark, sf_dir):
    """All devices, newest ``limit`` rows per series (store table semantics)."""
    return H.history(_tlong_points(spark, sf_dir), None, P.HISTORY_FROM, P.HISTORY_TO, P.HISTORY_LIMIT, per_series=True)


@register("history_all_devices", _history_oracle(O.TLONG_POINTS, None, 100))
def q_history_all_devices(spark, sf_dir):
    """All devices, one global newest-first limit."""
    return H.history(_tlong_points(spark, sf_dir), None, P.HISTORY_FROM, P.HISTORY_TO, 100)


@register(
    "history_envelope",
    f"""
WITH h AS ({_history_oracle(O.TLONG_POINTS, None, P.HISTORY_LIMIT, per_series=True).strip()})
SELECT device_id, count(*) AS count, max(timestamp) AS newest, min(timestamp) AS oldest
FROM h GROUP BY device_id
""",
)
def q_history_envelope(spark, sf_dir):
    hist = H.history(_tlong_points(spark, sf_dir), None, P.HISTORY_FROM, P.HISTORY_TO, P.HISTORY_LIMIT, per_series=True)
    env = H.envelope(hist)
    return env.select(
        "device_id", "count",
        F.element_at("points", 1)["timestamp"].alias("newest"),
        F.element_at("points", -1)["timestamp"].alias("oldest"),
    )


def _display_num(col: str, digits: int) -> str:
    return f"CASE WHEN {col} IS NULL THEN '—' ELSE printf('%.{digits}f', {col}) END"


@register(
    "history_display",
    f"""
WITH h AS ({_history_oracle(f"{O.CLASSIFIED}, {O.POINTS}", P.HISTORY_DEVICE, P.HISTORY_LIMIT).strip()})
SELECT device_id,
       strftime(CAST(timestamp AS TIMESTAMP) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') || ' CET' AS timestamp,
       {', '.join(f"{_display_num(f, 3 if f.startswith('accel') else 2)} AS {f}" for f in FIELDS)}
FROM h
""",
)
def q_history_display(spark, sf_dir):
    return D.history_display(q_history_device(spark, sf_dir))


# --------------------------------------------------------------------------- device state

_LATEST_OUT = ("device_id", "timestamp", *FIELDS, "arrival_seq", "last_seen")


def _latest_cte(order: str) -> str:
    return f"""
lr AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY {order}) AS rn
       FROM c WHERE status IN ('stored', 'latest')),
l AS (SELECT * FROM lr WHERE rn = 1)"""


def _latest_oracle(order: str) -> str:
    return f"""
WITH {O.CLASSIFIED}, {_latest_cte(order)}
SELECT device_id, timestamp, {_fields_out()}, arrival_seq, timestamp AS last_seen FROM l
"""


@register("latest_by_arrival", _latest_oracle("arrival_seq DESC"))
def q_latest_by_arrival(spark, sf_dir):
    return _ingested(spark, sf_dir).latest("arrival").select(*_LATEST_OUT)


@register("latest_by_event_time", _latest_oracle("event_time DESC NULLS LAST, arrival_seq DESC"))
def q_latest_by_event_time(spark, sf_dir):
    return _ingested(spark, sf_dir).latest("event_time").select(*_LATEST_OUT)


@register(
    "latest_stored",
    f"""
WITH {O.CLASSIFIED},
lr AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY arrival_seq DESC) AS rn
       FROM c WHERE status = 'stored'),
l AS (SELECT * FROM lr WHERE rn = 1)
SELECT device_id, timestamp, {_fields_out()}, arrival_seq, timestamp AS last_seen FROM l
""",
)
def q_latest_stored(spark, sf_dir):
    """Latest state consistent with the stored points: records the store refused do not count."""
    return _ingested(spark, sf_dir).latest("arrival", only_stored=True).select(*_LATEST_OUT)


@register(
    "device_info",
    f"""
WITH {O.CLASSIFIED}, {_latest_cte("arrival_seq DESC")}
SELECT device_id,
       CASE WHEN epoch_us(TIMESTAMP '{P.NOW[:10]} {P.NOW[11:19]}') - epoch_us({O.iso_ts('timestamp')}) < {P.ACTIVE_TIMEOUT_S * 1_000_000}
            THEN 'online' ELSE 'offline' END AS state,
       'unknown' AS firmware_version, timestamp AS last_seen
FROM l
""",
)
def q_device_info(spark, sf_dir):
    return S.device_info(_ingested(spark, sf_dir).latest(), now=P.NOW, timeout_s=P.ACTIVE_TIMEOUT_S)


@register(
    "device_firmware",
    f"""
WITH {O.CLASSIFIED}, {_latest_cte("arrival_seq DESC")}
SELECT device_id, 'online' AS state, coalesce(nullif(j ->> '$.firmware', ''), 'unknown') AS firmware_version,
       timestamp AS last_seen FROM l
""",
)
def q_device_firmware(spark, sf_dir):
    """Device view with the documented tags kept (``keep_tags=True``)."""
    return S.device_info(_ingested(spark, sf_dir, keep_tags=True).latest())


@register(
    "sole_device",
    f"""
WITH {O.CLASSIFIED}, {_latest_cte("arrival_seq DESC")}
SELECT device_id, timestamp FROM l WHERE (SELECT count(*) FROM l) = 1
""",
)
def q_sole_device(spark, sf_dir):
    return S.sole_device(_ingested(spark, sf_dir).latest().select("device_id", "timestamp"))


@register(
    "active_devices",
    f"""
WITH {O.CLASSIFIED}, {_latest_cte("arrival_seq DESC")}
SELECT device_id, timestamp AS last_seen FROM l
WHERE epoch_us(TIMESTAMP '{P.NOW[:10]} {P.NOW[11:19]}') - epoch_us({O.iso_ts('timestamp')}) < {P.ACTIVE_TIMEOUT_S * 1_000_000}
""",
)
def q_active_devices(spark, sf_dir):
    act = S.active_devices(_ingested(spark, sf_dir).latest(), P.NOW, P.ACTIVE_TIMEOUT_S)
    return act.select("device_id", "last_seen")


# --------------------------------------------------------------------------- legacy dialect


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.classify(TB.legacy_messages(spark, sf_dir))


def _legacy_parsed_oracle(kind: str) -> str:
    from buoyline.schemas import legacy_spec

    spec = legacy_spec(kind)
    keys = sorted(f.key for f in spec)
    by_key = {f.key: f for f in spec}
    typed = ", ".join(f"{O.cast(f.key, f.type)} AS {f.key}" for f in spec)
    raw_keys = ", ".join(
        f"CASE WHEN {O.jt(k)} IS NOT NULL AND {O.cast(k, by_key[k].type)} IS NULL THEN '{k}' END" for k in keys
    )
    known = ", ".join(f"'{k}'" for k in keys)
    ts = O.as_int("ts")
    return f"""
WITH {O.legacy_classified()}
SELECT arrival_seq, sensor_id, {typed},
       concat_ws(',', {raw_keys}) AS raw_keys,
       array_to_string(list_sort(list_filter(json_keys(j), lambda x: x NOT IN ({known}))), ',') AS extra_keys,
       {O.ts_out(f"CASE WHEN {ts} IS NOT NULL THEN epoch_ms({ts}) WHEN {O.jt('ts')} = 'NULL' THEN TIMESTAMP '2024-02-01 00:00:00' END")} AS time
FROM lc WHERE status = 'parsed' AND kind = '{kind}'
"""


def _legacy_parsed(spark, sf_dir, kind: str) -> DataFrame:
    from buoyline.schemas import legacy_spec

    parsed = L.parse(_legacy(spark, sf_dir), kind, P.INGEST_TIME)
    return parsed.select(
        "arrival_seq", "sensor_id", *[f.key for f in legacy_spec(kind)],
        F.concat_ws(",", F.sort_array(F.map_keys("raw_values"))).alias("raw_keys"),
        F.concat_ws(",", "extra_keys").alias("extra_keys"),
        to_iso_z("time").alias("time"),
    )


@register("legacy_decode", _legacy_parsed_oracle("measurement"))
def q_legacy_decode(spark, sf_dir):
    """Spec-driven decode of measurement payloads: casts, raw values kept, unknown keys passed."""
    return _legacy_parsed(spark, sf_dir, "measurement")


@register("legacy_diag", _legacy_parsed_oracle("diag"))
def q_legacy_diag(spark, sf_dir):
    """Spec-driven decode of diag payloads."""
    return _legacy_parsed(spark, sf_dir, "diag")


def _legacy_points_oracle() -> str:
    parts = []
    for kind, table in (("measurement", "sensor_measurement"), ("diag", "sensor_diag")):
        value, value_string, value_type = O.legacy_value_sql(kind)
        ts = O.as_int("ts")
        parts.append(f"""
  SELECT '{table}' AS measurement, sensor_id,
         {O.ts_out(f"CASE WHEN {ts} IS NOT NULL THEN epoch_ms({ts}) WHEN {O.jt('ts')} = 'NULL' THEN TIMESTAMP '2024-02-01 00:00:00' END")} AS time,
         key AS field, {value} AS value, {value_string} AS value_string, {value_type} AS value_type, arrival_seq
  FROM (SELECT lc.*, e.key AS key, e.value AS v FROM lc, json_each(lc.j) e
        WHERE lc.status = 'parsed' AND lc.kind = '{kind}') x
  WHERE key <> 'ts' AND ({O.jt('ts')} = 'NULL' OR {ts} IS NOT NULL)""")
    body = "\n  UNION ALL".join(parts)
    return f"""
WITH {O.legacy_classified()}, pts AS ({body})
SELECT * FROM pts WHERE value IS NOT NULL OR value_string IS NOT NULL
"""


@register("legacy_points", _legacy_points_oracle())
def q_legacy_points(spark, sf_dir):
    """Both point tables (measurements, diagnostics): every non-ts number or string is a field."""
    cls = _legacy(spark, sf_dir)
    pts = L.to_points(cls, None, P.INGEST_TIME)
    return pts.select(
        "measurement", "sensor_id", to_iso_z("time").alias("time"), "field", "value", "value_string", "value_type",
        "arrival_seq",
    )


@register(
    "legacy_sensors",
    f"""
WITH {O.legacy_classified()},
h AS (SELECT * FROM lc WHERE status IN ('registered', 'parsed')),
base AS (SELECT sensor_id, max(arrival_ts) AS last_seen, bool_or(kind = 'registerMe') AS registered
         FROM h GROUP BY sensor_id),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY arrival_seq DESC) AS rn
                     FROM h WHERE status = 'parsed' AND kind = 'measurement') WHERE rn = 1),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY arrival_seq DESC) AS rn
                     FROM h WHERE status = 'parsed' AND kind = 'diag') WHERE rn = 1)
SELECT base.sensor_id, {O.ts_out('base.last_seen')} AS last_seen, base.registered,
       m.arrival_seq AS measurement_seq, {O.as_float('t', 'm.j')} AS t, {O.as_float('h', 'm.j')} AS h,
       {O.as_int('p', 'm.j')} AS p,
       d.arrival_seq AS diag_seq, {O.as_float('V', 'd.j')} AS V, {O.as_int('rssi', 'd.j')} AS rssi,
       {O.as_str('fw', 'd.j')} AS fw
FROM base LEFT JOIN m ON m.sensor_id = base.sensor_id LEFT JOIN d ON d.sensor_id = base.sensor_id
""",
)
def q_legacy_sensors(spark, sf_dir):
    """Per-sensor state: last seen, registered, last measurement and last diag kept independently."""
    st = L.sensors(_legacy(spark, sf_dir))
    return st.select(
        "sensor_id", to_iso_z("last_seen").alias("last_seen"), "registered",
        F.col("last_measurement.seq").alias("measurement_seq"), F.col("last_measurement.t").alias("t"),
        F.col("last_measurement.h").alias("h"), F.col("last_measurement.p").alias("p"),
        F.col("last_diag.seq").alias("diag_seq"), F.col("last_diag.V").alias("V"),
        F.col("last_diag.rssi").alias("rssi"), F.col("last_diag.fw").alias("fw"),
    )


@register(
    "legacy_active",
    f"""
WITH {O.legacy_classified()},
h AS (SELECT * FROM lc WHERE status IN ('registered', 'parsed')),
base AS (SELECT sensor_id, max(arrival_ts) AS last_seen FROM h GROUP BY sensor_id)
SELECT sensor_id, {O.ts_out('last_seen')} AS last_seen FROM base
WHERE epoch_us(TIMESTAMP '{P.NOW[:10]} {P.NOW[11:19]}') - epoch_us(last_seen) < {P.ACTIVE_TIMEOUT_S * 1_000_000}
""",
)
def q_legacy_active(spark, sf_dir):
    """Sensors seen within the timeout (strict) before ``now``."""
    st = L.sensors(_legacy(spark, sf_dir))
    act = S.active_devices(st, P.NOW, P.ACTIVE_TIMEOUT_S)
    return act.select("sensor_id", to_iso_z("last_seen").alias("last_seen"))


@register(
    "legacy_dispatch",
    f"""
WITH {O.legacy_classified()}
SELECT coalesce(kind, '') AS kind, status,
       coalesce(CASE WHEN sensor_id IS NULL THEN 'unexpected_topic'
                     WHEN kind NOT IN ('registerMe', 'measurement', 'diag') THEN 'no_handler'
                     WHEN kind = 'registerMe' THEN NULL
                     WHEN NOT obj THEN 'not_an_object'
                     WHEN missing <> '' THEN 'missing_fields' END, '') AS reason,
       count(*) AS n
FROM lc GROUP BY ALL
""",
)
def q_legacy_dispatch(spark, sf_dir):
    """Routing by kind: handled, invalid and ignored counts per kind."""
    cls = _legacy(spark, sf_dir)
    return cls.groupBy(
        F.coalesce("kind", F.lit("")).alias("kind"), "status", F.coalesce("reason", F.lit("")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("n"))


@register(
    "legacy_remap",
    f"""
WITH {O.legacy_classified()}
SELECT arrival_seq, sensor_id AS sensor_id,
       strftime(epoch_ms({O.as_int('ts')}), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,
       {O.as_float('t')} AS temperature, {O.as_float('h')} AS humidity,
       CAST({O.as_int('p')} AS DOUBLE) / 100.0 AS pressure
FROM lc WHERE status = 'parsed' AND kind = 'measurement'
""",
)
def q_legacy_remap(spark, sf_dir):
    """Legacy names -> documented target names, pressure in hPa (extension)."""
    parsed = L.parse(_legacy(spark, sf_dir), "measurement", P.INGEST_TIME)
    out = L.remap(parsed.select("arrival_seq", "sensor_id", "ts", "t", "h", "p"), pressure_unit="hPa")
    return out


# --------------------------------------------------------------------------- extensions: rollups, smoothing, ranges

_RESOLVED_LONG = f"""
{O.CLASSIFIED}, {O.POINTS},
rl AS (SELECT measurement, device_id, firmware, location, time, field,
              arg_max(value, arrival_seq) AS value, max(arrival_seq) AS arrival_seq
       FROM points GROUP BY measurement, device_id, firmware, location, time, field)"""


@register(
    "rollup_daily",
    f"""
WITH {_RESOLVED_LONG}
SELECT device_id, field, {O.ts_out("date_trunc('day', time)")} AS bucket,
       round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(value) AS n
FROM rl GROUP BY device_id, field, date_trunc('day', time)
""",
)
def q_rollup_daily(spark, sf_dir):
    """Daily avg/min/max/count per device and field over resolved points (extension X7)."""
    r = R.rollup(_raw_points(spark, sf_dir), "1 day")
    return r.select(
        "device_id", "field", to_iso_z("bucket").alias("bucket"), F.round("avg_value", 6).alias("avg_value"),
        "min_value", "max_value", "n",
    )


@register(
    "smooth_weekly",
    f"""
WITH {_RESOLVED_LONG}
SELECT device_id, field, {O.ts_out("time_bucket(INTERVAL '7 days', time, TIMESTAMP '1970-01-01')")} AS bucket,
       round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, count(value) AS n
FROM rl GROUP BY device_id, field, time_bucket(INTERVAL '7 days', time, TIMESTAMP '1970-01-01')
""",
)
def q_smooth_weekly(spark, sf_dir):
    """Mean and median per 7-day bucket (extension X8)."""
    r = R.smooth(_raw_points(spark, sf_dir), "7 days")
    return r.select(
        "device_id", "field", to_iso_z("bucket").alias("bucket"), F.round("mean_value", 6).alias("mean_value"),
        F.round("median_value", 6).alias("median_value"), "n",
    )


@register(
    "range_flags",
    f"""
WITH {_RESOLVED_LONG}
SELECT device_id, {O.ts_out('time')} AS time, field, value,
       {O.RANGE_LOW} AS low, {O.RANGE_HIGH} AS high,
       value BETWEEN {O.RANGE_LOW} AND {O.RANGE_HIGH} AS in_range
FROM rl
""",
)
def q_range_flags(spark, sf_dir):
    """Quality flags from the documented sensor ranges (extension X9)."""
    r = R.range_flags(_raw_points(spark, sf_dir))
    return r.select("device_id", to_iso_z("time").alias("time"), "field", "value", "low", "high", "in_range")


@register(
    "retention_split",
    f"""
WITH {_RESOLVED_LONG}
SELECT CASE WHEN time >= TIMESTAMP '2024-01-24 00:00:00' THEN 'kept' ELSE 'expired' END AS part,
       count(*) AS n, count(DISTINCT device_id) AS devices
FROM rl GROUP BY 1
""",
)
def q_retention_split(spark, sf_dir):
    """Retention: points newer than 7 days before ``now`` are kept, the rest archived (extension X7)."""
    from buoyline.operators.points import resolve_long

    both = resolve_long(_raw_points(spark, sf_dir)).select(R.age_part(P.NOW, 7).alias("part"), "device_id")
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("device_id").alias("devices"))


@register(
    "out_of_range",
    f"""
WITH {_RESOLVED_LONG}
SELECT device_id, field, count(*) AS n, min(value) AS min_value, max(value) AS max_value FROM rl
WHERE NOT (value BETWEEN {O.RANGE_LOW} AND {O.RANGE_HIGH})
GROUP BY device_id, field
""",
)
def q_out_of_range(spark, sf_dir):
    """Out-of-range counts per device and field (threshold filter, extension X9)."""
    r = R.out_of_range(_raw_points(spark, sf_dir))
    return r.groupBy("device_id", "field").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )


# --------------------------------------------------------------------------- extensions: status and diagnostics streams


def _status_rows(spark, sf_dir, kind: str):
    from buoyline.operators import status as ST
    from buoyline.operators.decode import decode
    from buoyline.schemas import DIAGNOSTICS_SPEC, STATUS_SPEC

    spec = STATUS_SPEC if kind == "status" else DIAGNOSTICS_SPEC
    return ST.classify_kind(decode(TB.status_messages(spark, sf_dir)), kind, spec)


def _status_oracle_cte() -> str:
    return f"""
sraw AS ({P.STATUS_MESSAGES}),
sd AS (SELECT arrival_seq, arrival_ts, topic, payload,
              CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM sraw)"""


@register(
    "status_latest",
    f"""
WITH {_status_oracle_cte()},
s AS (SELECT arrival_seq, {O.jtext('device_id')} AS device_id, {O.jtext('timestamp')} AS timestamp,
             {O.jtext('state')} AS state, {O.jtext('firmware_version')} AS firmware_version,
             {O.as_int('uptime_s')} AS uptime_s, {O.iso_ts(O.jtext('timestamp'))} AS event_time
      FROM sd WHERE topic LIKE '%/status' AND j IS NOT NULL AND json_type(j) = 'OBJECT'
        AND {O.truthy('device_id')} AND {O.truthy('timestamp')} AND {O.truthy('state')}
        AND {O.jtext('state')} IN ('online', 'offline', 'booting', 'error')),
r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY arrival_seq DESC) AS rn FROM s WHERE event_time IS NOT NULL)
SELECT device_id, state, firmware_version, uptime_s, timestamp, arrival_seq,
       CASE WHEN state = 'offline' THEN 'offline'
            WHEN NOT (epoch_us(TIMESTAMP '{P.NOW[:10]} {P.NOW[11:19]}') - epoch_us(event_time) < {P.ACTIVE_TIMEOUT_S * 1_000_000}) THEN 'offline'
            ELSE state END AS effective_state
FROM r WHERE rn = 1
""",
)
def q_status_latest(spark, sf_dir):
    """Latest valid status per device with last-will/timeout state (extension X1, X3)."""
    from buoyline.operators import status as ST

    latest = ST.latest_status(_status_rows(spark, sf_dir, "status"), P.NOW, P.ACTIVE_TIMEOUT_S)
    return latest.select("device_id", "state", "firmware_version", "uptime_s", "timestamp", "arrival_seq",
                         "effective_state")


@register(
    "status_rejects",
    f"""
WITH {_status_oracle_cte()}
SELECT arrival_seq, split_part(topic, '/', 3) AS kind,
       CASE WHEN j IS NULL THEN 'invalid_json'
            WHEN json_type(j) <> 'OBJECT' THEN 'not_an_object'
            WHEN NOT ({O.truthy('device_id')} AND {O.truthy('timestamp')} AND
                      (split_part(topic, '/', 3) = 'diagnostics' OR {O.truthy('state')})) THEN 'missing_fields'
            WHEN split_part(topic, '/', 3) = 'status' AND {O.jtext('state')} NOT IN ('online', 'offline', 'booting', 'error') THEN 'invalid_state'
            ELSE 'invalid_timestamp' END AS reason
FROM sd
WHERE j IS NULL OR json_type(j) <> 'OBJECT' OR NOT {O.truthy('device_id')} OR NOT {O.truthy('timestamp')}
   OR (split_part(topic, '/', 3) = 'status' AND (NOT {O.truthy('state')} OR {O.jtext('state')} NOT IN ('online', 'offline', 'booting', 'error')))
   OR {O.iso_ts(O.jtext('timestamp'))} IS NULL
""",
)
def q_status_rejects(spark, sf_dir):
    """Rejected status and diagnostics messages with reasons (extension X1, X2)."""
    from buoyline.operators import status as ST
    from buoyline.operators.decode import decode
    from buoyline.schemas import DIAGNOSTICS_SPEC, STATUS_SPEC

    rows = ST.classify(decode(TB.status_messages(spark, sf_dir)), {"status": STATUS_SPEC, "diagnostics": DIAGNOSTICS_SPEC})
    return rows.where(F.col("status") == "rejected").select("arrival_seq", "kind", "reason")


@register(
    "diagnostics_points",
    f"""
WITH {_status_oracle_cte()},
s AS (SELECT arrival_seq, {O.jtext('device_id')} AS device_id, {O.iso_ts(O.jtext('timestamp'))} AS time, j
      FROM sd WHERE topic LIKE '%/diagnostics' AND j IS NOT NULL AND json_type(j) = 'OBJECT'
        AND {O.truthy('device_id')} AND {O.truthy('timestamp')}),
p AS (
  SELECT device_id, time, 'battery_v' AS field, {O.as_float('battery_v')} AS value, arrival_seq FROM s
  UNION ALL SELECT device_id, time, 'rssi_dbm', CAST({O.as_int('rssi_dbm')} AS DOUBLE), arrival_seq FROM s
  UNION ALL SELECT device_id, time, 'free_heap', CAST({O.as_int('free_heap')} AS DOUBLE), arrival_seq FROM s)
SELECT 'diagnostics' AS measurement, device_id, {O.ts_out('time')} AS time, field, value, arrival_seq
FROM p WHERE value IS NOT NULL AND time IS NOT NULL
""",
)
def q_diagnostics_points(spark, sf_dir):
    """Valid diagnostics as points in their own table (extension X2)."""
    from buoyline.operators import status as ST

    pts = ST.diagnostics_points(_status_rows(spark, sf_dir, "diagnostics"))
    return pts.select("measurement", "device_id", to_iso_z("time").alias("time"), "field", "value", "arrival_seq")


# --------------------------------------------------------------------------- free SQL over stored points


@register(
    "sql_over_points",
    f"""
WITH {O.CLASSIFIED}, {O.POINTS}, w AS ({O.wide_from()})
SELECT device_id, count(*) AS n_rows, max(temperature) AS max_temperature, min(humidity) AS min_humidity
FROM w GROUP BY device_id
""",
)
def q_sql_over_points(spark, sf_dir):
    """A free SQL query over the resolved ``telemetry`` view of the point store."""
    from buoyline.plans.views import query

    return query(
        spark,
        "SELECT device_id, count(*) AS n_rows, max(temperature) AS max_temperature, min(humidity) AS min_humidity "
        "FROM {telemetry} GROUP BY device_id",
        points=_raw_points(spark, sf_dir),
    )


# --------------------------------------------------------------------------- batch jobs over the stored tables


@register("store_history", ORACLES["history_device"])
def q_store_history(spark, sf_dir):
    """The flagship history read from the point store that the batch ingest job wrote."""
    from buoyline.plans.ingest import ingest_to
    from buoyline.session import scratch_path
    from buoyline.sources import store

    paths = ingest_to(TB.raw_messages(spark, sf_dir), scratch_path(spark, "ingest"), P.INGEST_TIME)
    pts = store.read_points(spark, paths["points"])
    return H.history(pts, P.HISTORY_DEVICE, P.HISTORY_FROM, P.HISTORY_TO, P.HISTORY_LIMIT)


def _two_slices(raw: DataFrame) -> list[tuple[str, DataFrame]]:
    """The messages in two runs that alternate by arrival, the first run once more at the end."""
    odd = F.col("arrival_seq") % 20 < 10
    first, second = ("first", raw.where(odd)), ("second", raw.where(~odd))
    return [first, second, first]


@register("store_latest", ORACLES["latest_by_arrival"])
def q_store_latest(spark, sf_dir):
    """Latest state after two batch runs into one folder, one of them repeated."""
    from buoyline.plans.ingest import ingest_to, read_latest
    from buoyline.session import scratch_path

    out = scratch_path(spark, "ingest-runs")
    for run, part in _two_slices(TB.raw_messages(spark, sf_dir)):
        ingest_to(part, out, P.INGEST_TIME, run=run)
    return read_latest(spark, out).select(*_LATEST_OUT)


@register("hub_sensors", ORACLES["legacy_sensors"])
def q_hub_sensors(spark, sf_dir):
    """Sensor state after two batch runs of the hub into one folder, one of them repeated."""
    from buoyline.plans.hub import hub_to, read_sensors
    from buoyline.session import scratch_path

    out = scratch_path(spark, "hub-runs")
    for run, part in _two_slices(TB.legacy_messages(spark, sf_dir)):
        hub_to(part, out, P.INGEST_TIME, run=run)
    return _sensor_columns(read_sensors(spark, out))


_STRICT = f"""
WITH {O.CLASSIFIED}
SELECT arrival_seq, split_part(topic, '/', 2) AS topic_device,
       CASE WHEN topic_device IS DISTINCT FROM device_id THEN 'device_mismatch' ELSE 'invalid_timestamp' END AS reason
FROM (SELECT *, string_split(topic, '/')[2] AS topic_device FROM c)
WHERE status IN ('stored', 'latest') AND (topic_device IS DISTINCT FROM device_id OR (NOT ts_defaulted AND event_time IS NULL))
"""


@register("strict_rejects", _STRICT)
def q_strict_rejects(spark, sf_dir):
    """What the documented checks refuse beyond the code's: another device's topic, an impossible time."""
    recs = _ingested(spark, sf_dir, strict_time=True, check_topic_device=True).records
    return recs.where((F.col("status") == "rejected") & F.col("reason").isin("device_mismatch", "invalid_timestamp")).select(
        "arrival_seq", TP.topic_device("topic").alias("topic_device"), "reason")


@register("device_lookup", f"SELECT * FROM ({ORACLES['latest_by_arrival']}) WHERE device_id = '{P.HISTORY_DEVICE}'")
def q_device_lookup(spark, sf_dir):
    """State of one device."""
    return S.device(_ingested(spark, sf_dir).latest(), P.HISTORY_DEVICE).select(*_LATEST_OUT)


@register("sole_device_found", ORACLES["device_lookup"])
def q_sole_device_found(spark, sf_dir):
    """No device named and exactly one known: its state (G4). Messages of one device only."""
    recs = _ingested(spark, sf_dir).records.where(F.col("device_id") == P.HISTORY_DEVICE)
    return S.sole_device(S.latest(recs)).select(*_LATEST_OUT)


@register(
    "legacy_points_resolved",
    f"""
WITH lp AS ({ORACLES['legacy_points']})
SELECT measurement, sensor_id, time, field, arg_max(value, arrival_seq) FILTER (WHERE newest) AS value,
       max(value_string) FILTER (WHERE newest) AS value_string, max(value_type) FILTER (WHERE newest) AS value_type,
       max(arrival_seq) AS arrival_seq
FROM (SELECT *, arrival_seq = max(arrival_seq) OVER (PARTITION BY measurement, sensor_id, time, field) AS newest FROM lp)
GROUP BY measurement, sensor_id, time, field
""",
)
def q_legacy_points_resolved(spark, sf_dir):
    """Legacy points, the last write of each (sensor, time, field) only (A6 on the tables of A4)."""
    pts = PT.resolve_legacy(L.to_points(_legacy(spark, sf_dir), None, P.INGEST_TIME))
    return pts.select("measurement", "sensor_id", to_iso_z("time").alias("time"), "field", "value", "value_string", "value_type", "arrival_seq")


@register(
    "sql_over_diagnostics",
    f"""
SELECT sensor_id, count(*) AS n, max(value) AS highest, count(DISTINCT value_string) AS texts
FROM ({ORACLES['legacy_points_resolved']}) WHERE measurement = 'sensor_diag' GROUP BY sensor_id
""",
)
def q_sql_over_diagnostics(spark, sf_dir):
    """A free SQL query over the hub's stored diagnostics."""
    from buoyline.plans.hub import hub_to
    from buoyline.plans.views import query
    from buoyline.session import scratch_path
    from buoyline.sources import store

    paths = hub_to(TB.legacy_messages(spark, sf_dir), scratch_path(spark, "hub"), P.INGEST_TIME)
    return query(spark, "SELECT sensor_id, count(*) AS n, max(value) AS highest, count(DISTINCT value_string) AS texts "
                 "FROM {diagnostics} GROUP BY sensor_id", diagnostics=store.read_points(spark, paths["diag"]))


@register(
    "legacy_register",
    f"""
WITH {O.legacy_classified()}
SELECT arrival_seq, sensor_id, payload AS text, j IS NOT NULL AS is_json FROM lc WHERE status = 'registered'
""",
)
def q_legacy_register(spark, sf_dir):
    """Registration messages with the lenient decode: stripped text, kept even when it is not JSON (B2)."""
    cls = _legacy(spark, sf_dir)
    return cls.where(F.col("status") == "registered").select(
        "arrival_seq", "sensor_id", F.col("payload").alias("text"), F.col("json").isNotNull().alias("is_json")
    )


# --------------------------------------------------------------------------- streaming


STREAM_FILE_ROWS = 2_000  # rows of one source file: what a broker bridge drops at a time
STREAM_FILES = 32  # files of one micro-batch
STREAM_BATCHES, STREAM_FILES_MOST = 16, 512  # a longer backlog takes larger micro-batches, up to so many files


def _drop_messages(messages: DataFrame, path: str) -> int:
    """Drop raw messages as files cut by arrival order; returns how many files a micro-batch reads.

    A micro-batch has a fixed cost (planning, four writes and their commits), so
    a backlog of more than STREAM_BATCHES micro-batches is read in larger ones.
    Their size is bounded, and so is what one of them keeps while it is written.
    """
    raw = messages.select("arrival_seq", F.col("arrival_ts").cast("timestamp").alias("arrival_ts"), "topic", "payload")
    raw.repartitionByRange("arrival_seq").write.option("maxRecordsPerFile", STREAM_FILE_ROWS).parquet(path)
    files = messages.sparkSession.read.schema(raw.schema).parquet(path).count() // STREAM_FILE_ROWS
    return min(max(STREAM_FILES, files // STREAM_BATCHES), STREAM_FILES_MOST)


def _stream_run(spark: SparkSession, sf_dir: str) -> str:
    """Drop the raw messages as files, run the ingest stream to completion, return its output folder.

    The files are cut by arrival order and read a bounded number per trigger;
    each run uses fresh folders below the checkpoint root.
    """
    from buoyline.session import scratch_path
    from buoyline.streaming import jobs

    base = scratch_path(spark, "stream")
    src, out, ckpt = f"{base}/source", f"{base}/out", f"{base}/checkpoint"
    files = _drop_messages(TB.raw_messages(spark, sf_dir), src)
    q = jobs.start_ingest(jobs.raw_stream(spark, src, max_files=files), out, ckpt, ingest_time=P.INGEST_TIME,
                          available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out


@register("stream_history", ORACLES["history_device"])
def q_stream_history(spark, sf_dir):
    """The flagship history, with the points written by the streaming ingest."""
    from buoyline.streaming import jobs

    out = _stream_run(spark, sf_dir)
    return H.history(jobs.read_points(spark, out), P.HISTORY_DEVICE, P.HISTORY_FROM, P.HISTORY_TO, P.HISTORY_LIMIT)


@register("stream_latest", ORACLES["latest_by_arrival"])
def q_stream_latest(spark, sf_dir):
    """Latest state per device from the streaming ingest's per-batch candidates."""
    from buoyline.streaming import jobs

    out = _stream_run(spark, sf_dir)
    return jobs.read_latest(spark, out).select(*_LATEST_OUT)


def _sensor_columns(st: DataFrame) -> DataFrame:
    return st.select(
        "sensor_id", to_iso_z("last_seen").alias("last_seen"), "registered",
        F.col("last_measurement.seq").alias("measurement_seq"), F.col("last_measurement.t").alias("t"),
        F.col("last_measurement.h").alias("h"), F.col("last_measurement.p").alias("p"),
        F.col("last_diag.seq").alias("diag_seq"), F.col("last_diag.V").alias("V"),
        F.col("last_diag.rssi").alias("rssi"), F.col("last_diag.fw").alias("fw"),
    )


@register("stream_legacy_sensors", ORACLES["legacy_sensors"])
def q_stream_legacy_sensors(spark, sf_dir):
    """Sensor state from the legacy hub run as a stream (per-batch candidates merged on read)."""
    from buoyline.session import scratch_path
    from buoyline.streaming import jobs

    base = scratch_path(spark, "hub-stream")
    src = f"{base}/source"
    files = _drop_messages(TB.legacy_messages(spark, sf_dir), src)
    q = jobs.start_hub(jobs.raw_stream(spark, src, max_files=files), f"{base}/out", f"{base}/checkpoint",
                       ingest_time=P.INGEST_TIME, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return _sensor_columns(jobs.read_sensors(spark, f"{base}/out"))


FEED_PARTS, FEED_FILES = 4, 3  # a feed's parts, one after the other in time, and the files of each: one micro-batch reads one part


def _feed(df: DataFrame, path: str) -> None:
    """Drop the messages as a bridge would: the files of a later stretch of time are written later."""
    df.write.parquet(f"{path}-all")
    every = df.sparkSession.read.parquet(f"{path}-all")
    t = F.unix_micros("arrival_ts")
    cuts = every.select(t.cast("double").alias("t")).approxQuantile("t", [k / FEED_PARTS for k in range(1, FEED_PARTS)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = every if low is None else every.where(t > low)
        part = part if high is None else part.where(t <= high)
        part.repartition(FEED_FILES).write.mode("append").parquet(path)


def _finished(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


@register(
    "stream_deduplicated",
    f"""
WITH {O.CLASSIFIED}
SELECT reason, count(*) AS n FROM c
WHERE reason IN ('invalid_json','not_an_object','missing_fields','device_mismatch','invalid_timestamp','uncastable_field')
GROUP BY reason
""",
)
def q_stream_deduplicated(spark, sf_dir):
    """Rejects of a stream that delivers every message twice, the copy 20 s later: each counts once (A1, A3)."""
    from buoyline.session import scratch_path
    from buoyline.streaming import jobs, presence

    base = scratch_path(spark, "twice")
    raw = TB.raw_messages(spark, sf_dir).select(
        "arrival_seq", F.col("arrival_ts").cast("timestamp").alias("arrival_ts"), "topic", "payload", F.col("arrival_seq").alias("message_id"))
    again = raw.withColumns({"arrival_seq": F.col("arrival_seq") + 3, "arrival_ts": F.col("arrival_ts") + F.expr("INTERVAL 20 SECONDS")})
    _feed(raw.unionByName(again), f"{base}/source")
    stream = jobs.raw_stream(spark, f"{base}/source", max_files=FEED_FILES, schema=raw.schema)
    once = presence.deduplicated(stream, ("topic", "message_id")).drop("message_id")
    _finished(jobs.start_ingest(once, f"{base}/out", f"{base}/checkpoint", ingest_time=P.INGEST_TIME, available_now=True))
    return jobs.read_rejects(spark, f"{base}/out").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_TRANSITIONS = f"""
s AS (SELECT device_id, arrival_ts AS t,
             lag(arrival_ts) OVER w AS before, lead(arrival_ts) OVER w AS after
      FROM c WHERE status IN ('stored', 'latest') WINDOW w AS (PARTITION BY device_id ORDER BY arrival_ts)),
e AS (
  SELECT device_id, 'online' AS event, t AS time FROM s
  WHERE before IS NULL OR t - before >= INTERVAL {P.ACTIVE_TIMEOUT_S} SECONDS
  UNION ALL
  SELECT device_id, 'offline', t + INTERVAL {P.ACTIVE_TIMEOUT_S} SECONDS FROM s
  WHERE CASE WHEN after IS NULL THEN t + INTERVAL {P.ACTIVE_TIMEOUT_S} SECONDS <= __UNTIL__
             ELSE after - t >= INTERVAL {P.ACTIVE_TIMEOUT_S} SECONDS END)
SELECT device_id, event, strftime(time, '%Y-%m-%dT%H:%M:%S.%f') AS time FROM e
"""


def _transition_columns(events: DataFrame) -> DataFrame:
    return events.select("device_id", "event", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"))


@register("transitions", f"WITH {O.CLASSIFIED}, " + _TRANSITIONS.replace("__UNTIL__", f"TIMESTAMP '{P.NOW[:10]} {P.NOW[11:19]}'"))
def q_transitions(spark, sf_dir):
    """Online/offline moments of every device from the times it was seen."""
    from buoyline.streaming import presence

    seen = _ingested(spark, sf_dir).accepted.select("device_id", "arrival_ts")
    return _transition_columns(presence.transitions(seen, P.ACTIVE_TIMEOUT_S, P.NOW))


@register("stream_transitions", f"WITH {O.CLASSIFIED}, " + _TRANSITIONS.replace(
    "__UNTIL__", "(SELECT date_trunc('millisecond', max(arrival_ts)) FROM c WHERE status IN ('stored', 'latest')) - INTERVAL 10 MINUTES"))
def q_stream_transitions(spark, sf_dir):
    """The same moments from a stream with timers: a last 'offline' once the watermark has passed it."""
    from buoyline.session import scratch_path
    from buoyline.streaming import jobs, presence

    base = scratch_path(spark, "presence")
    seen = _ingested(spark, sf_dir).accepted.select("device_id", F.col("arrival_ts").cast("timestamp").alias("arrival_ts"))
    _feed(seen, f"{base}/source")
    events = presence.transition_stream(jobs.raw_stream(spark, f"{base}/source", max_files=FEED_FILES, schema=seen.schema), P.ACTIVE_TIMEOUT_S)
    _finished(events.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out"))
    return _transition_columns(spark.read.schema("device_id string, event string, time timestamp").parquet(f"{base}/out"))


_RESOLVED_TLONG = f"""
{O.TLONG_POINTS},
rl AS (SELECT device_id, time, field, arg_max(value, arrival_seq) AS value FROM points GROUP BY device_id, time, field)"""


@register(
    "stream_rollup_tiers",
    f"""
WITH {_RESOLVED_TLONG}
SELECT device_id, field, {O.ts_out("time_bucket(INTERVAL '7 days', time, TIMESTAMP '1970-01-01')")} AS bucket,
       round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(value) AS n
FROM rl GROUP BY device_id, field, time_bucket(INTERVAL '7 days', time, TIMESTAMP '1970-01-01')
""",
)
def q_stream_rollup_tiers(spark, sf_dir):
    """A weekly tier folded from the daily one that a stream of rewritten points keeps exact."""
    from buoyline.session import scratch_path
    from buoyline.streaming import jobs, tiers

    base = scratch_path(spark, "tiers")
    points = _tlong_points(spark, sf_dir)
    points.repartition(FEED_PARTS * FEED_FILES).write.parquet(f"{base}/source")
    stream = jobs.raw_stream(spark, f"{base}/source", max_files=FEED_FILES, schema=points.schema)
    _finished(tiers.start_tier(stream, f"{base}/out", f"{base}/checkpoint", "1 day"))
    week = tiers.coarser(tiers.read_tier(spark, f"{base}/out"), "7 days")
    return week.select("device_id", "field", to_iso_z("bucket").alias("bucket"), F.round(F.col("sum_value") / F.col("n"), 6).alias("avg_value"),
                       "min_value", "max_value", "n")


@register(
    "smooth_samples",
    f"""
WITH {_RESOLVED_TLONG}
SELECT device_id, field, {O.ts_out('time')} AS time, value, round(avg(value) OVER w, 6) AS mean_value,
       round(median(value) OVER w, 6) AS median_value, CAST(count(*) OVER w AS INTEGER) AS n
FROM rl WINDOW w AS (PARTITION BY device_id, field ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""",
)
def q_smooth_samples(spark, sf_dir):
    """Moving mean and median over the last five samples of each series and field."""
    from buoyline.operators.moving import moving

    m = moving(_tlong_points(spark, sf_dir), 5)
    return m.select("device_id", "field", to_iso_z("time").alias("time"), "value", F.round("mean_value", 6).alias("mean_value"),
                    F.round("median_value", 6).alias("median_value"), "n")


@register(
    "subscription_deliveries",
    f"""
WITH m AS ({P.RAW_MESSAGES}), s AS ({P.SUBSCRIPTIONS}),
v AS (SELECT DISTINCT subscription_id, filter,
             CASE WHEN filter = '#' THEN '' WHEN ends_with(filter, '/#') THEN left(filter, length(filter) - 2) ELSE filter END AS head
      FROM s WHERE NOT regexp_matches(filter, '#.|[^/][+#]|[+#][^/]')),
r AS (SELECT subscription_id, filter, CASE WHEN filter = '#' THEN '.*' ELSE
             replace(replace(head, '$', '[$]'), '+', '[^/]*') || CASE WHEN ends_with(filter, '/#') THEN '(/.*)?' ELSE '' END END AS pattern FROM v),
t AS (SELECT DISTINCT topic, subscription_id FROM (SELECT DISTINCT topic FROM m) JOIN r
      ON regexp_full_match(topic, pattern) AND NOT (starts_with(topic, '$') AND left(filter, 1) IN ('+', '#')))
SELECT arrival_seq, subscription_id FROM m JOIN t USING (topic)
""",
)
def q_subscription_deliveries(spark, sf_dir):
    """Every message with each subscription that it is delivered to, from a table of filters (A2)."""
    from buoyline.operators.subscriptions import deliveries

    messages = TB.raw_messages(spark, sf_dir).select("arrival_seq", "topic")
    return deliveries(messages, TB.subscriptions(spark, sf_dir)).select("arrival_seq", "subscription_id")


def _mark_sql(levels: dict[str, tuple[float, float]]) -> str:
    cases = [f"WHEN '{f}' THEN CASE WHEN value {'>=' if up > down else '<='} {up} THEN 1 WHEN value {'<=' if up > down else '>='} {down} THEN 0 END"
             for f, (up, down) in levels.items()]
    return f"CASE field {' '.join(cases)} END"


_EVENT_POINTS = f"""
ev AS ({P.TELEMETRY_LONG}),
rl AS (SELECT device_id, event_ts AS time, field, arg_max(value, arrival_seq) AS value FROM ev GROUP BY device_id, event_ts, field)"""
_EXACT_TIME = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"


def _event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at the time of their event, not of its day."""
    return PT.from_long(TB.telemetry_long(spark, sf_dir).withColumn("time", F.col("event_ts")))


@register(
    "alarms",
    f"""
WITH {_EVENT_POINTS},
m AS (SELECT *, {_mark_sql(P.ALARM_LEVELS)} AS mark FROM rl WHERE field IN ({", ".join(f"'{f}'" for f in P.ALARM_LEVELS)})),
st AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY device_id, field ORDER BY time
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM m),
b AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY device_id, field ORDER BY time), 0) AS before FROM st),
n AS (SELECT *, sum(CASE WHEN state = 1 AND before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id, field ORDER BY time
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS number FROM b)
SELECT device_id, field, CAST(number AS BIGINT) AS number, {_EXACT_TIME.format("min(CASE WHEN state = 1 THEN time END)")} AS raised_at,
       {_EXACT_TIME.format("max(CASE WHEN state = 0 THEN time END)")} AS cleared_at,
       CASE WHEN field = 'humidity' THEN min(CASE WHEN state = 1 THEN value END) ELSE max(CASE WHEN state = 1 THEN value END) END AS peak,
       count(CASE WHEN state = 1 THEN 1 END) AS samples
FROM n WHERE state = 1 OR before = 1 GROUP BY device_id, field, number
""",
)
def q_alarms(spark, sf_dir):
    """Alarm intervals with raise and clear levels per field, over split series."""
    from buoyline.operators.alarms import alarms

    exact = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)
    found = alarms(_event_points(spark, sf_dir), P.ALARM_LEVELS)
    return found.select("device_id", "field", "number", exact("raised_at"), exact("cleared_at"), "peak", "samples")


@register(
    "rollup_quantiles",
    f"""
WITH {_EVENT_POINTS}
SELECT field, {O.ts_out("date_trunc('day', time)")} AS bucket, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
       min(value) AS min_value, max(value) AS max_value, count(*) AS n
FROM rl GROUP BY field, date_trunc('day', time)
""",
)
def q_rollup_quantiles(spark, sf_dir):
    """p50 and p95 by field and day, merged from the stored sketches of each device's hours."""
    from buoyline.operators import quantiles as Q
    from buoyline.session import scratch_path

    hours = f"{scratch_path(spark, 'sketches')}/hours"
    Q.tier(_event_points(spark, sf_dir), "1 hour").write.parquet(hours)
    days = Q.coarser(spark.read.parquet(hours), "1 day", ("field",))
    return Q.quantiles(days, {"p50": 0.5, "p95": 0.95}).withColumn("bucket", to_iso_z("bucket"))


@register("compacted_history", ORACLES["history_device"])
def q_compacted_history(spark, sf_dir):
    """The flagship history over a store compacted after its first run; the second run's points are resolved on read."""
    from buoyline.plans.ingest import ingest_to
    from buoyline.session import scratch_path
    from buoyline.sources import compaction

    out = scratch_path(spark, "compaction")
    (name, first), (after, second), _ = _two_slices(TB.raw_messages(spark, sf_dir))
    points = ingest_to(first, out, P.INGEST_TIME, run=name)["points"]
    compaction.compact(spark, points, f"{out}/compacted")
    ingest_to(second, out, P.INGEST_TIME, run=after)
    return compaction.history(spark, points, f"{out}/compacted", P.HISTORY_DEVICE, P.HISTORY_FROM, P.HISTORY_TO, P.HISTORY_LIMIT)


@register("compacted_points", f"""
WITH {O.CLASSIFIED}, {O.POINTS}, w AS ({O.wide_from()})
SELECT device_id, {O.ts_out('time')} AS time, {_fields_out()}, arrival_seq FROM w
""")
def q_compacted_points(spark, sf_dir):
    """Every resolved row after two runs, each followed by a compaction: the second folds into the first's days."""
    from buoyline.plans.ingest import ingest_to
    from buoyline.session import scratch_path
    from buoyline.sources import compaction

    out = scratch_path(spark, "compaction-twice")
    for run, part in _two_slices(TB.raw_messages(spark, sf_dir))[:2]:
        points = ingest_to(part, out, P.INGEST_TIME, run=run)["points"]
        compaction.compact(spark, points, f"{out}/compacted")
    rows = compaction.read_resolved(spark, points, f"{out}/compacted")
    return rows.select("device_id", to_iso_z("time").alias("time"), *FIELDS, "arrival_seq")


@register("sql_device_history", ORACLES["history_device"])
def q_sql_device_history(spark, sf_dir):
    """The flagship history as a SQL table function."""
    from buoyline.plans.functions import register_functions

    register_functions(spark, PT.resolve_wide(_raw_points(spark, sf_dir)))
    return spark.sql("SELECT * FROM device_history(:device, :start, :stop, n => :n)", {
        "device": P.HISTORY_DEVICE, "start": P.HISTORY_FROM, "stop": P.HISTORY_TO, "n": P.HISTORY_LIMIT})


@register("ingest_counts", ORACLES["reject_counts"])
def q_ingest_counts(spark, sf_dir):
    """Messages by status and reason, counted while the batch ingest writes its records."""
    from buoyline.plans.counters import read_counts
    from buoyline.plans.ingest import ingest_to
    from buoyline.session import scratch_path

    out = scratch_path(spark, "ingest-counts")
    for run, part in _two_slices(TB.raw_messages(spark, sf_dir)):
        ingest_to(part, out, P.INGEST_TIME, run=run)
    return read_counts(spark, out)


@register("stream_counts", ORACLES["reject_counts"])
def q_stream_counts(spark, sf_dir):
    """The same counts, summed over the micro-batches of the streaming ingest."""
    from buoyline.plans.counters import read_counts

    return read_counts(spark, _stream_run(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
