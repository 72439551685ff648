"""Message and point schemas, field specs and the fixed values of the contract.

Everything a Spark job needs to know about the message dialects lives here as
data; the operators generate their column expressions from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference contract for identical results.
# ---------------------------------------------------------------------------
TELEMETRY_REQUIRED = ("device_id",)
TELEMETRY_FIELDS = (
    "temperature",
    "humidity",
    "pressure",
    "gas_resistance",
    "accel_x",
    "accel_y",
    "accel_z",
)
TOPIC_KINDS = ("status", "telemetry", "diagnostics")
TOPIC_ROOT = "sensors"  # default root; every topic function takes another
MEASUREMENT = "environment"
HISTORY_DEFAULT_LIMIT = 500
HISTORY_MAX_LIMIT = 5000
UI_HISTORY_MAX_HOURS = 168
DEVICE_STATE = "online"
UNKNOWN_FIRMWARE = "unknown"
DISPLAY_ZONE = "Europe/Warsaw"
EMPTY_DISPLAY = "—"
ACCEL_FIELDS = ("accel_x", "accel_y", "accel_z")

LEGACY_DOMAIN = "ws"
LEGACY_BROADCAST_TARGET = "all"
LEGACY_REGISTER_CALL = "registerCall"
LEGACY_REGISTER = "registerMe"
LEGACY_MEASUREMENT = "measurement"
LEGACY_DIAG = "diag"
LEGACY_TIME_KEY = "ts"
LEGACY_TABLES = {"measurement": "sensor_measurement", "diag": "sensor_diag"}
LEGACY_BUCKETS = {"measurement": "measurements", "diag": "diagnostics"}
SENSOR_TIMEOUT_S = 120

# Legacy payload specs: key, type, unit, required.
LEGACY_SPECS = {
    "measurement": (
        ("ts", "int", "ms", True),
        ("t", "float", "°C", False),
        ("h", "float", "%", False),
        ("p", "int", "Pa", False),
        ("acmm", "int", "-", False),
        ("imp", "int", "-", False),
        ("impi", "int", "-", False),
        ("impc", "int", "-", False),
        ("ph", "int", "-", False),
        ("phf", "int", "Hz", False),
    ),
    "diag": (
        ("ts", "int", "ms", True),
        ("V", "float", "V", False),
        ("rssi", "int", "dBm", False),
        ("fw", "str", "-", False),
        ("lm", "str", "-", False),
    ),
}

# Documented extension contracts (status and diagnostics streams), not in
# the reference code: key, type, required.
STATUS_STATES = ("online", "offline", "booting", "error")
STATUS_SPEC = (
    ("device_id", "str", True),
    ("timestamp", "str", True),
    ("state", "str", True),
    ("firmware_version", "str", False),
    ("ip", "str", False),
    ("uptime_s", "int", False),
)
DIAGNOSTICS_SPEC = (
    ("device_id", "str", True),
    ("timestamp", "str", True),
    ("battery_v", "float", False),
    ("rssi_dbm", "int", False),
    ("last_error", "str", False),
    ("free_heap", "int", False),
)
# Documented legacy -> target renames (extension X6).
LEGACY_RENAMES = {
    "ts": "timestamp",
    "t": "temperature",
    "h": "humidity",
    "p": "pressure",
    "V": "battery_v",
    "rssi": "rssi_dbm",
    "fw": "firmware_version",
}
# Documented sensor ranges (extension X9): field -> (low, high), inclusive.
SENSOR_RANGES = {
    "temperature": (-40.0, 85.0),
    "humidity": (0.0, 100.0),
    "pressure": (300.0, 1100.0),
}
# ---------------------------------------------------------------------------

SPARK_TYPES = {
    "int": T.LongType(),  # Python ints do not overflow; bigint is the closest
    "float": T.DoubleType(),
    "str": T.StringType(),
    "bool": T.BooleanType(),
}

# Raw message as it arrives from a broker bridge or a file drop.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("arrival_seq", T.LongType(), False),
        T.StructField("arrival_ts", T.TimestampType(), True),
        T.StructField("topic", T.StringType(), False),
        T.StructField("payload", T.StringType(), True),
    ]
)

SERIES_KEYS = ("measurement", "device_id", "firmware", "location")


@dataclass(frozen=True)
class FieldSpec:
    key: str
    type: str
    required: bool = False

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES.get(self.type, T.StringType())


def legacy_spec(kind: str) -> tuple[FieldSpec, ...]:
    return tuple(FieldSpec(k, t, r) for k, t, _unit, r in LEGACY_SPECS.get(kind, ()))
