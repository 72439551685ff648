"""history() against a brute-force pandas implementation on random colliding writes."""

import datetime as dt
import random

import pandas as pd
import pytest

from buoyline.operators import history as H
from buoyline.operators import points as PT

FIELDS = ("temperature", "humidity", "pressure")


def _brute(rows, device, limit, per_series):
    df = pd.DataFrame(rows, columns=["device_id", "time", "field", "value", "arrival_seq"])
    if device is not None:
        df = df[df.device_id == device]
    last = df.sort_values("arrival_seq").groupby(["device_id", "time", "field"]).tail(1)
    wide = last.pivot_table(index=["device_id", "time"], columns="field", values="value", aggfunc="first")
    seq = df.groupby(["device_id", "time"]).arrival_seq.max()
    wide = wide.join(seq).reset_index().sort_values(["time", "arrival_seq"], ascending=False)
    if per_series:
        wide = wide.groupby("device_id").head(limit)
    else:
        wide = wide.head(limit)
    out = set()
    for _, r in wide.iterrows():
        vals = tuple(None if f not in r or pd.isna(r[f]) else float(r[f]) for f in FIELDS)
        out.add((r.device_id, r.time.strftime("%Y-%m-%dT%H:%M:%SZ"), *vals))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_history_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for seq in range(600):
        rows.append((rnd.choice("ABC"), base + dt.timedelta(hours=rnd.randrange(240)), rnd.choice(FIELDS),
                     float(rnd.randrange(1000)) / 10, seq * 7 + rnd.randrange(5)))
    pts = PT.from_long(spark.createDataFrame(
        rows, "device_id string, time timestamp, field string, value double, arrival_seq long"))
    for device, limit, per_series in [("A", 5, False), (None, 7, False), (None, 4, True), ("B", 1000, False)]:
        got = H.history(pts, device, None, None, limit, per_series=per_series, fields=FIELDS).collect()
        got = {(r["device_id"], r["timestamp"], *[r[f] for f in FIELDS]) for r in got}
        assert got == _brute(rows, device, limit, per_series), (device, limit, per_series)
