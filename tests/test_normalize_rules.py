"""Telemetry classification against a plain-Python statement of the rules, on random payloads."""

import json
import random

from buoyline.plans.ingest import ingest
from buoyline.schemas import TELEMETRY_FIELDS

NOW = "2024-02-01T00:00:00Z"
TOPIC = "sensors/X/telemetry"


def _expected(payload):
    """(status, reason, device_id, timestamp, {field: float}) by the contract's rules."""
    if not isinstance(payload, dict):
        return "rejected", "not_an_object", None, None, {}
    if not payload.get("device_id"):
        return "rejected", "missing_fields", None, None, {}
    ts = payload.get("timestamp") or NOW
    kept = {f: payload[f] for f in TELEMETRY_FIELDS if f in payload and payload[f] is not None}
    values, failed = {}, []
    for f, v in kept.items():
        try:
            values[f] = float(v)
        except (TypeError, ValueError):
            failed.append(f)
    if failed:
        return "latest", "uncastable_field", payload["device_id"], ts, values
    if not kept:
        return "latest", "no_fields", payload["device_id"], ts, values
    return "stored", None, payload["device_id"], ts, values


def _val(rnd):
    return rnd.choice([1.5, 0, -2, "3.25", "abc", "", True, False, None, [1], {}, 1e3])


def test_classify_matches_rules(spark, raw_df):
    rnd = random.Random(3)
    payloads = []
    for _ in range(400):
        p = {}
        if rnd.random() < 0.8:
            p["device_id"] = rnd.choice(["D1", "D2", "", 0, None, "0"])
        if rnd.random() < 0.7:
            p["timestamp"] = rnd.choice(["2024-01-05T10:00:00Z", "", None, 0, "2024-01-06T11:30:00Z"])
        for f in rnd.sample(TELEMETRY_FIELDS, rnd.randrange(0, 4)):
            p[f] = _val(rnd)
        if rnd.random() < 0.2:
            p["firmware"] = "1.0.0"
        payloads.append(p)
    payloads += [[1, 2], 5, "text"]
    recs = ingest(raw_df([(i, TOPIC, json.dumps(p)) for i, p in enumerate(payloads)]), NOW).records
    got = {r["arrival_seq"]: r for r in recs.collect()}
    for i, p in enumerate(payloads):
        status, reason, dev, ts, values = _expected(p)
        r = got[i]
        assert (r["status"], r["reason"]) == (status, reason), (p, r["status"], r["reason"])
        if status == "rejected":
            continue
        assert r["device_id"] == str(dev) and r["timestamp"] == ts, (p, r["device_id"], r["timestamp"])
        for f in TELEMETRY_FIELDS:
            assert r[f] == values.get(f), (p, f, r[f])
