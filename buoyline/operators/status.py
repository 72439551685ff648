"""Documented extensions X1/X2 (not in the reference code): status and diagnostics streams.

Both follow the telemetry rules: a required field must be truthy, optional
fields are cast by their declared type (NULL when absent or uncastable).
A status must name one of the documented states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buoyline.functions import json as J
from buoyline.functions.columns import evaluate_once
from buoyline.functions.timefmt import parse_iso
from buoyline.schemas import DIAGNOSTICS_SPEC, STATUS_SPEC, STATUS_STATES
from buoyline.operators.state import is_active

DIAGNOSTICS_MEASUREMENT = "diagnostics"


def classify(decoded: DataFrame, specs: dict[str, tuple]) -> DataFrame:
    """Messages on ``…/<kind>`` topics of all given kinds -> typed rows with ``status`` ok/rejected and a reason.

    Every payload is parsed once and its members are extracted once, for all
    kinds together. The fields are the union of the specs (a name has one type
    in all of them); a field that a row's kind lacks is NULL.
    """
    j = F.col("json")
    types = {k: t for spec in specs.values() for k, t, _r in spec}
    named = F.lit(None).cast("string")
    for kind in specs:
        named = F.when(F.col("topic").endswith("/" + kind), F.lit(kind)).otherwise(named)
    step1 = decoded.select("*", named.alias("kind")).where(F.col("kind").isNotNull()).select(
        "arrival_seq", "arrival_ts", "topic", "kind", "text", j.isNotNull().alias("_json_ok"),
        J.members(j, list(types)).alias("_m"),
    )

    def m(k: str):
        return F.col("_m")[k]

    def having(k: str, needed: bool = False):
        """Rows of the kinds whose spec has the field (as a required one)."""
        return F.col("kind").isin(*[kind for kind, spec in specs.items() if any(x == k and (r or not needed) for x, _t, r in spec)])

    required = [k for k in types if any(x == k and r for spec in specs.values() for x, _t, r in spec)]
    missing = F.concat_ws(", ", *[F.when(having(k, True) & ~J.v_truthy(m(k)), F.lit(k)) for k in required])
    x = evaluate_once(
        step1,
        F.col("arrival_seq"),
        F.col("arrival_ts"),
        F.col("topic"),
        F.col("kind"),
        F.col("text").alias("payload"),
        F.col("_json_ok"),
        F.col("_m").isNotNull().alias("_object"),
        missing.alias("_missing"),
        *[F.when(having(k), J.v_text(m(k)) if t == "str" else J.v_cast(m(k), t)).alias(k) for k, t in types.items()],
    )
    reason = (
        F.when(~F.col("_json_ok"), F.lit("invalid_json"))
        .when(~F.col("_object"), F.lit("not_an_object"))
        .when(F.col("_missing") != "", F.lit("missing_fields"))
    )
    detail = F.when(reason == "missing_fields", F.col("_missing"))
    if "state" in types:
        reason = reason.when(~F.col("state").isin(*STATUS_STATES), F.lit("invalid_state"))
        detail = detail.when(reason == "invalid_state", F.col("state"))
    reason = reason.when(parse_iso(F.col("timestamp")).isNull(), F.lit("invalid_timestamp"))
    return x.select(
        "arrival_seq", "arrival_ts", "topic", "kind", "payload", *types,
        parse_iso(F.col("timestamp")).alias("event_time"),
        F.when(reason.isNull(), F.lit("ok")).otherwise(F.lit("rejected")).alias("status"),
        reason.alias("reason"), detail.alias("detail"),
    )


def classify_kind(decoded: DataFrame, kind: str, spec=STATUS_SPEC) -> DataFrame:
    """The typed rows of one kind (see ``classify``)."""
    return classify(decoded, {kind: spec}).drop("kind")


def latest_status(status_rows: DataFrame, now: str | None = None, timeout_s: float | None = None) -> DataFrame:
    """Latest valid status per device (last arrival wins), with an effective state.

    With ``now``/``timeout_s`` a device whose last status is older than the
    timeout counts as ``offline`` (documented last-will semantics).
    """
    ok = status_rows.where(F.col("status") == "ok")
    cols = [c for c in ok.columns if c not in ("status", "reason", "detail")]
    latest = ok.groupBy("device_id").agg(
        F.max_by(F.struct(*[F.col(c) for c in cols if c != "device_id"]), F.col("arrival_seq")).alias("r")
    ).select("device_id", "r.*")
    eff = F.col("state")
    if now is not None and timeout_s is not None:
        eff = F.when(F.col("state") == "offline", F.lit("offline")).when(
            ~is_active(F.col("event_time"), now, timeout_s), F.lit("offline")
        ).otherwise(F.col("state"))
    return latest.withColumn("effective_state", eff)


def diagnostics_points(diag_rows: DataFrame, spec=DIAGNOSTICS_SPEC) -> DataFrame:
    """Valid diagnostics -> long points in their own table (numeric fields)."""
    numeric = [k for k, t, _r in spec if t in ("int", "float")]
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("double").alias("value")) for k in numeric])
    return (
        diag_rows.where(F.col("status") == "ok")
        .select(
            F.lit(DIAGNOSTICS_MEASUREMENT).alias("measurement"), "device_id",
            F.lit(None).cast("string").alias("firmware"), F.lit(None).cast("string").alias("location"),
            F.col("event_time").alias("time"), F.inline(pairs), "arrival_seq",
        )
        .where(F.col("value").isNotNull())
    )
