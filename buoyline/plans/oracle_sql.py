"""DuckDB SQL that states each registered query independently of Spark.

The oracle re-derives every rule with DuckDB's own JSON functions, so a
match means two engines agree on the same inputs. Shared pieces (the
message views, the classification of a message) are CTE text built here.
"""

from __future__ import annotations

from buoyline.schemas import LEGACY_SPECS, SENSOR_RANGES, TELEMETRY_FIELDS
from buoyline.sources import fixtures as P

ISO_Z = "'%Y-%m-%dT%H:%M:%SZ'"
ISO_RE = r"'^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|z|[+-]\d{2}(:?\d{2})?)?$'"
NUM_TYPES = "('BIGINT','UBIGINT','DOUBLE')"


def jt(key: str, j: str = "j") -> str:
    return f"json_type({j}, '$.{key}')"


def jtext(key: str, j: str = "j") -> str:
    return f"({j} ->> '$.{key}')"


def truthy(key: str, j: str = "j") -> str:
    t = jt(key, j)
    return (
        f"(CASE WHEN {t} IS NULL OR {t} = 'NULL' THEN false "
        f"WHEN {t} = 'VARCHAR' THEN {jtext(key, j)} <> '' "
        f"WHEN {t} = 'BOOLEAN' THEN {jtext(key, j)} = 'true' "
        f"WHEN {t} = 'ARRAY' THEN json_array_length({j}, '$.{key}') <> 0 "
        f"WHEN {t} = 'OBJECT' THEN CAST(({j} -> '$.{key}') AS VARCHAR) <> '{{}}' "
        f"ELSE TRY_CAST({jtext(key, j)} AS DOUBLE) <> 0 END)"
    )


def present(key: str, j: str = "j") -> str:
    t = jt(key, j)
    return f"({t} IS NOT NULL AND {t} <> 'NULL')"


def as_float(key: str, j: str = "j") -> str:
    t = jt(key, j)
    return (
        f"(CASE WHEN {t} IN {NUM_TYPES} THEN TRY_CAST({jtext(key, j)} AS DOUBLE) "
        f"WHEN {t} = 'VARCHAR' THEN TRY_CAST(trim({jtext(key, j)}) AS DOUBLE) "
        f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN {jtext(key, j)} = 'true' THEN 1.0 ELSE 0.0 END END)"
    )


def as_int(key: str, j: str = "j") -> str:
    t = jt(key, j)
    return (
        f"(CASE WHEN {t} IN ('BIGINT','UBIGINT') THEN TRY_CAST({jtext(key, j)} AS BIGINT) "
        f"WHEN {t} = 'DOUBLE' THEN CAST(trunc(TRY_CAST({jtext(key, j)} AS DOUBLE)) AS BIGINT) "
        f"WHEN {t} = 'VARCHAR' AND regexp_matches(trim({jtext(key, j)}), '^[+-]?[0-9]+$') "
        f"THEN TRY_CAST(trim({jtext(key, j)}) AS BIGINT) "
        f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN {jtext(key, j)} = 'true' THEN 1 ELSE 0 END END)"
    )


def as_str(key: str, j: str = "j") -> str:
    t = jt(key, j)
    return (
        f"(CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 'NULL' THEN 'None' "
        f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN {jtext(key, j)} = 'true' THEN 'True' ELSE 'False' END "
        f"ELSE {jtext(key, j)} END)"
    )


def cast(key: str, type_name: str, j: str = "j") -> str:
    return {"int": as_int, "float": as_float}.get(type_name, as_str)(key, j)


def iso_ts(expr: str) -> str:
    """ISO text -> TIMESTAMP (UTC), NULL if not ISO."""
    return (
        f"(CASE WHEN regexp_matches({expr}, {ISO_RE}) "
        f"THEN CAST(TRY_CAST(replace({expr}, ',', '.') AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) END)"
    )


def ts_out(expr: str) -> str:
    return f"strftime({expr}, {ISO_Z})"


FIELDS = TELEMETRY_FIELDS


def _fields_sel() -> str:
    return ",\n       ".join(f"{as_float(f)} AS {f}, {present(f)} AS p_{f}" for f in FIELDS)


# One row per raw message with its classification (mirrors normalize.classify).
CLASSIFIED = f"""
raw AS ({P.RAW_MESSAGES}),
d AS (
  SELECT arrival_seq, arrival_ts, topic, payload,
         CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j
  FROM raw),
c0 AS (
  SELECT arrival_seq, arrival_ts, topic, payload, j,
         j IS NOT NULL AS json_ok,
         topic LIKE '%/telemetry' AS tele,
         coalesce(json_type(j) = 'OBJECT', false) AS obj,
         {truthy('device_id')} AS has_dev,
         {truthy('timestamp')} AS has_ts,
         {jtext('device_id')} AS device_id,
       {_fields_sel()}
  FROM d),
c1 AS (
  SELECT *,
         CASE WHEN has_ts THEN {jtext('timestamp')} ELSE '{P.INGEST_TIME}' END AS timestamp,
         NOT has_ts AS ts_defaulted,
         concat_ws(', ', {', '.join(f"CASE WHEN p_{f} AND {f} IS NULL THEN '{f}' END" for f in FIELDS)}) AS failed,
         ({' + '.join(f'CAST(p_{f} AS INTEGER)' for f in FIELDS)}) AS n_fields
  FROM c0),
c2 AS (
  SELECT *, {iso_ts('timestamp')} AS event_time FROM c1),
c AS (
  SELECT *,
         CASE WHEN NOT json_ok THEN 'invalid_json'
              WHEN NOT tele THEN NULL
              WHEN NOT obj THEN 'not_an_object'
              WHEN NOT has_dev THEN 'missing_fields'
              WHEN failed <> '' THEN 'uncastable_field'
              WHEN n_fields = 0 THEN 'no_fields'
              WHEN event_time IS NULL THEN 'invalid_timestamp' END AS reason,
         CASE WHEN NOT json_ok OR (tele AND (NOT obj OR NOT has_dev)) THEN 'rejected'
              WHEN NOT tele THEN 'ignored'
              WHEN failed <> '' OR n_fields = 0 OR event_time IS NULL THEN 'latest'
              ELSE 'stored' END AS status
  FROM c2)
"""

# Stored records -> long points (mirrors points.to_points).
POINTS = "points AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT 'environment' AS measurement, device_id, CAST(NULL AS VARCHAR) AS firmware, "
    f"CAST(NULL AS VARCHAR) AS location, event_time AS time, '{f}' AS field, {f} AS value, arrival_seq "
    f"FROM c WHERE status = 'stored' AND {f} IS NOT NULL"
    for f in FIELDS
) + ")"

TLONG_POINTS = f"""
tl AS ({P.TELEMETRY_LONG}),
points AS (
  SELECT 'environment' AS measurement, device_id, CAST(NULL AS VARCHAR) AS firmware,
         CAST(NULL AS VARCHAR) AS location, time, field, value, arrival_seq FROM tl)
"""


def wide_from(points: str = "points", where: str = "true") -> str:
    aggs = ",\n         ".join(f"arg_max(value, arrival_seq) FILTER (WHERE field = '{f}') AS {f}" for f in FIELDS)
    return f"""
  SELECT measurement, device_id, firmware, location, time,
         {aggs},
         max(arrival_seq) AS arrival_seq
  FROM {points} WHERE ({where}) AND field IN ({', '.join(f"'{f}'" for f in FIELDS)})
  GROUP BY measurement, device_id, firmware, location, time"""


def legacy_classified() -> str:
    """One row per legacy message (mirrors legacy.classify)."""
    req = {k: [key for key, _t, _u, r in spec if r] for k, spec in LEGACY_SPECS.items()}
    miss_cases = " ".join(
        f"WHEN kind = '{k}' THEN concat_ws(', ', {', '.join(f'CASE WHEN {jt(r)} IS NULL THEN {chr(39)}{r}{chr(39)} END' for r in keys)})"
        for k, keys in req.items()
    )
    return f"""
lraw AS ({P.LEGACY_MESSAGES}),
l0 AS (
  SELECT arrival_seq, arrival_ts, topic,
         string_split(topic, '/') AS parts,
         trim(payload) AS text
  FROM lraw),
l1 AS (
  SELECT arrival_seq, arrival_ts, topic, text AS payload,
         CASE WHEN len(parts) >= 4 AND parts[1] = 'ws' THEN parts[3] END AS sensor_id,
         CASE WHEN len(parts) >= 4 AND parts[1] = 'ws' THEN array_to_string(parts[4:], '/') END AS kind,
         CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j
  FROM l0),
l2 AS (
  SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS obj,
         CASE {miss_cases} ELSE '' END AS missing
  FROM l1),
lc AS (
  SELECT *,
         CASE WHEN sensor_id IS NULL OR kind NOT IN ('registerMe', 'measurement', 'diag') THEN 'ignored'
              WHEN kind = 'registerMe' THEN 'registered'
              WHEN NOT obj OR missing <> '' THEN 'invalid'
              ELSE 'parsed' END AS status
  FROM l2)
"""


def legacy_value_sql(kind: str) -> tuple[str, str, str]:
    """(value, value_string, value_type) for an unnested (key, v JSON) row (mirrors legacy._value_columns)."""
    spec = {key: t for key, t, _u, _r in LEGACY_SPECS[kind]}
    t = "json_type(v)"
    txt = "(v ->> '$')"
    spec_type = "CASE key " + " ".join(f"WHEN '{k}' THEN '{ty}'" for k, ty in spec.items()) + " END"
    as_i = (
        f"(CASE WHEN {t} IN ('BIGINT','UBIGINT') THEN TRY_CAST({txt} AS BIGINT) "
        f"WHEN {t} = 'DOUBLE' THEN CAST(trunc(TRY_CAST({txt} AS DOUBLE)) AS BIGINT) "
        f"WHEN {t} = 'VARCHAR' AND regexp_matches(trim({txt}), '^[+-]?[0-9]+$') THEN TRY_CAST(trim({txt}) AS BIGINT) "
        f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN {txt} = 'true' THEN 1 ELSE 0 END END)"
    )
    as_f = (
        f"(CASE WHEN {t} IN {NUM_TYPES} THEN TRY_CAST({txt} AS DOUBLE) "
        f"WHEN {t} = 'VARCHAR' THEN TRY_CAST(trim({txt}) AS DOUBLE) "
        f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN {txt} = 'true' THEN 1.0 ELSE 0.0 END END)"
    )
    as_s = (
        f"(CASE WHEN {t} = 'NULL' THEN 'None' WHEN {t} = 'BOOLEAN' THEN CASE WHEN {txt} = 'true' THEN 'True' ELSE 'False' END "
        f"ELSE {txt} END)"
    )
    st = f"({spec_type})"
    ok = f"(CASE WHEN {st} = 'int' THEN {as_i} IS NOT NULL WHEN {st} = 'float' THEN {as_f} IS NOT NULL WHEN {st} = 'str' THEN true ELSE false END)"
    raw_num = f"(CASE WHEN {t} IN {NUM_TYPES} THEN TRY_CAST({txt} AS DOUBLE) WHEN {t} = 'BOOLEAN' THEN CASE WHEN {txt} = 'true' THEN 1.0 ELSE 0.0 END END)"
    raw_type = f"(CASE WHEN {t} IN ('BIGINT','UBIGINT') THEN 'int' WHEN {t} = 'DOUBLE' THEN 'float' WHEN {t} = 'BOOLEAN' THEN 'bool' WHEN {t} = 'VARCHAR' THEN 'str' END)"
    value = f"(CASE WHEN {ok} AND {st} = 'int' THEN CAST({as_i} AS DOUBLE) WHEN {ok} AND {st} = 'float' THEN {as_f} WHEN NOT {ok} THEN {raw_num} END)"
    value_string = f"(CASE WHEN {ok} AND {st} = 'str' THEN {as_s} WHEN NOT {ok} AND {t} = 'VARCHAR' THEN {txt} END)"
    value_type = f"(CASE WHEN {ok} THEN {st} ELSE {raw_type} END)"
    return value, value_string, value_type


RANGE_LOW = "CASE field " + " ".join(f"WHEN '{f}' THEN {float(lo)}" for f, (lo, _hi) in SENSOR_RANGES.items()) + " END"
RANGE_HIGH = "CASE field " + " ".join(f"WHEN '{f}' THEN {float(hi)}" for f, (_lo, hi) in SENSOR_RANGES.items()) + " END"
