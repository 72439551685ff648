"""Mixing against a plain Python version, and the curriculum's integrals."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from buoyline.llm import mixing


def targets(sizes, epochs=3):
    """Reshare by weight until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: epochs * sizes[s] for s in over}


def n_words(t):
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])


ROWS = [(i, "w " * (i % 17), None, f"s{i % 4}") for i in range(400)] + [
    (1000, "big " * 3000, None, "s0"), (1001, None, None, "s1"), (1002, "a b", None, None), (1003, "c", None, None),
    (None, "no id", None, "s2"), (5, "w " * 5, None, "s1"), (5, "w " * 5, None, "s1"), (1004, "", None, "empty"), (1005, " x y", None, "é"),
]


def test_sizes_targets_and_taken_words(docs):
    got = mixing.mix(docs(ROWS)).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for _, t, _, s in ROWS:
        sizes[s] = sizes.get(s, 0) + n_words(t)
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r.mix_size == n_words(r.text) and r.mix_source_size == sizes[r.source]
        assert math.isclose(r.mix_target, want[r.source], abs_tol=1e-6)
        assert r.mix_taken == r.mix_size * len(r.mix_positions) <= 3 * r.mix_size
        assert r.key == "x" and r.fp == 1  # clashing extra columns pass
        assert all(0 <= p <= 1 for p in r.mix_positions) and list(r.mix_positions) == sorted(r.mix_positions)
        taken[r.source] = taken.get(r.source, 0) + r.mix_taken
    largest = {s: max(n_words(t) for _, t, _, x in ROWS if x == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_reruns_agree_whatever_the_partitions(docs):
    key = lambda rows: sorted([(r.doc_id, r.source, r.mix_size, r.mix_taken, tuple(r.mix_positions)) for r in rows], key=str)
    assert key(mixing.mix(docs(ROWS)).collect()) == key(mixing.mix(docs(ROWS[::-1]).repartition(7)).collect())


def test_positions_follow_the_running_sum(docs):
    rows = [(i, "w " * (1 + i % 5), None, "only") for i in range(50)]
    got = {r.doc_id: r for r in mixing.mix(docs(rows)).collect()}
    order = sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), str(r[0])))
    run, total = 0, sum(1 + i % 5 for i in range(50))
    for d, t, _, _ in order:  # weight 1, slope -0.5: the integral of 1.5 - t is 1.5 t - t^2/2
        size = n_words(t)
        demand = (run + size / 2) / total
        assert math.isclose(got[d].mix_positions[0], 1.5 - math.sqrt(2.25 - 2 * demand), abs_tol=1e-9)
        run += size


def test_training_order_is_sorted_and_whole(docs):
    mixed = mixing.mix(docs(ROWS))
    out = mixing.training_order(mixed, ["doc_id", "text", "key"]).collect()
    assert len(out) == sum(len(r.mix_positions) for r in mixed.collect())
    assert [r.mix_position for r in out] == sorted(r.mix_position for r in out)


def test_empty_and_all_blank_tables(docs):
    assert mixing.mix(docs([])).collect() == []
    got = mixing.mix(docs([(1, None, None, "a"), (2, "", None, None)])).collect()
    assert {(r.mix_size, r.mix_target, r.mix_taken) for r in got} == {(0, 0.0, 0)}


def test_native_plan(docs):
    plan = mixing.training_order(mixing.mix(docs(ROWS)), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("knots", [[(0.0, 1.0), (1.0, 3.0)], [(0.0, 2.0), (0.25, 0.0), (0.5, 0.0), (1.0, 4.0)], [(0.0, 1.0), (1.0, 1.0)]])
def test_inversion_of_a_schedule(sc, knots):
    t = np.linspace(0, 1, 2001)
    w = np.interp(t, *zip(*knots))
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))])
    schedule = F.array(*[F.struct(F.lit(a).alias("t"), F.lit(b).alias("w")) for a, b in knots])
    asked = [float(x) for x in np.linspace(0.01, 0.99, 25) * area[-1]]
    df = sc.createDataFrame([(x,) for x in asked], "d double").select("d", mixing.integral(schedule).alias("whole"), mixing.invert(mixing.pieces(schedule), F.col("d")).alias("t"))
    for r in df.collect():
        assert math.isclose(r.whole, area[-1], abs_tol=1e-6)
        assert math.isclose(np.interp(r.t, t, area), r.d, abs_tol=1e-4)
