"""The spec-driven legacy parser against a plain-Python statement of its rules, on random payloads."""

import json
import random

from buoyline.operators import legacy as L
from buoyline.schemas import legacy_spec

CASTS = {"int": int, "float": float, "str": str}


def _expected(payload, spec):
    """Rules: required key absent -> dropped; cast by type, failure keeps the raw value; unknown keys pass."""
    if not isinstance(payload, dict):
        return None
    out, raw = {}, set()
    for f in spec:
        if f.key not in payload:
            if f.required:
                return None
            continue
        try:
            out[f.key] = CASTS[f.type](payload[f.key])
        except (TypeError, ValueError):
            out[f.key] = None
            raw.add(f.key)
    extra = sorted(k for k in payload if k not in {f.key for f in spec})
    return out, raw, extra


def _val(rnd):
    return rnd.choice([0, 7, -3, 2.5, 3.7, "3.7", "5", " 8 ", "abc", "", True, False, None, [1], {"a": 1}])


def test_measurement_parse_matches_rules(spark, raw_df):
    rnd = random.Random(11)
    spec = legacy_spec("measurement")
    keys = [f.key for f in spec] + ["voc", "x"]
    payloads = []
    for _ in range(300):
        p = {k: _val(rnd) for k in rnd.sample(keys, rnd.randrange(1, 6))}
        if rnd.random() < 0.7:
            p["ts"] = rnd.choice([1704067200000, "1704067200000", None, 1.7e12])
        payloads.append(p)
    payloads += [[1, 2], "plain"]
    rows = [(i, "ws/hub1/S1/measurement", json.dumps(p)) for i, p in enumerate(payloads)]
    cls = L.classify(raw_df(rows))
    got = {r["arrival_seq"]: r for r in L.parse(cls, "measurement", "2024-02-01T00:00:00Z").collect()}
    for i, p in enumerate(payloads):
        exp = _expected(p, spec)
        if exp is None:
            assert i not in got, p
            continue
        values, raw, extra = exp
        r = got[i]
        for f in spec:
            if f.key in values and f.key not in raw:
                assert r[f.key] == values[f.key], (p, f.key, r[f.key])
            else:
                assert r[f.key] is None, (p, f.key)
        assert set(r["raw_values"]) == raw, (p, r["raw_values"])
        assert r["extra_keys"] == extra, p
