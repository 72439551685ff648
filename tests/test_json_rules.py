"""The JSON rules (truthiness, float()/int()/str() casts) against Python itself on random values."""

import json
import math
import random

from pyspark.sql import functions as F

from buoyline.functions import json as J

TEXTS = ["", " ", "0", "0.0", "1", "-2", "22.4", " 22.4 ", "3.7", "1e3", "-0", "abc", "true", "false", "null",
         "NaN", "nan", "inf", "-Infinity", "1_000", "0x10", "5 ", "+7", "1.", ".5", "١٢"]


def _value(rnd):
    kind = rnd.randrange(8)
    if kind == 0:
        return rnd.randrange(-5, 5)
    if kind == 1:
        return rnd.choice([0.0, -0.0, 0.5, 3.7, -2.25, 1e20, 22.4])
    if kind == 2:
        return rnd.choice(TEXTS)
    if kind == 3:
        return rnd.choice([True, False])
    if kind == 4:
        return None
    if kind == 5:
        return rnd.choice([[], [1], [0]])
    if kind == 6:
        return rnd.choice([{}, {"a": 1}])
    return rnd.randrange(-10**15, 10**15)


def _py_float(v):
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _py_int(v):
    try:
        return int(v)
    except (TypeError, ValueError, OverflowError):
        return None


def _py_str(v):
    return str(v)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    return a == b


# Documented differences (README): Python accepts digit-group underscores and
# non-ASCII decimal digits in numeric text.
KNOWN = {"1_000", "١٢"}


def test_rules_match_python(spark):
    rnd = random.Random(7)
    values = [_value(rnd) for _ in range(400)] + TEXTS
    payloads = [json.dumps({"k": v}) for v in values]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    m = F.try_variant_get(F.try_parse_json("p"), "$.k", "variant")
    rows = df.select("i", J.v_truthy(m).alias("t"), J.v_float(m).alias("f"), J.v_int(m).alias("n"),
                     J.v_str(m).alias("s")).collect()
    bad = []
    for r in rows:
        v = values[r["i"]]
        if isinstance(v, str) and v in KNOWN:
            continue
        if r["t"] != bool(v):
            bad.append(("truthy", v, r["t"]))
        if not _same(r["f"], _py_float(v)):
            bad.append(("float", v, r["f"]))
        py_n = _py_int(v)
        if py_n is not None and not -2**63 <= py_n < 2**63:
            py_n = None  # bigint range: Python ints do not overflow (documented)
        if r["n"] != py_n:
            bad.append(("int", v, r["n"]))
        if isinstance(v, (str, bool)) or v is None:
            if r["s"] != _py_str(v):
                bad.append(("str", v, r["s"]))
    assert not bad, bad[:20]


def test_only_decimal_spellings_cast(raw_df):
    import json

    from buoyline.plans.ingest import ingest

    texts = {"22.4d": None, "22.4f": None, "0x1p3": None, "1e3": 1000.0, " 7. ": 7.0, ".5": 0.5, "+3": 3.0, "1e": None, "": None}
    rows = [(i, "sensors/A/telemetry", json.dumps({"device_id": "A", "timestamp": "2024-01-01T00:00:00Z", "temperature": t}))
            for i, t in enumerate(texts)]
    got = {r["arrival_seq"]: (r["temperature"], r["status"]) for r in ingest(raw_df(rows), "2024-01-01T00:00:00Z").records.collect()}
    for i, v in enumerate(texts.values()):
        assert got[i] == (v, "latest" if v is None else "stored"), list(texts)[i]
