"""Forest search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from buoyline.llm import rpforest

SCHEMA = "vec_id long, embedding array<float>, query_id int, vector string"


def table(sc, rows):
    return sc.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA)


def brute(rows, k=20, every=20):
    ok = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q, x in ok.items():
        if q % every == 0:
            out[q] = sorted(((-(x * v).sum(), i) for i, v in ok.items() if i != q))[:k]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def vectors(n, dim=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_recall_and_exact_scores(sc):
    rows = vectors(2000)
    got, want = result(rpforest.search(table(sc, rows), F.col("vec_id") % 20 == 0)), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    x = dict(rows)
    for q, found in got.items():
        for s, i in found:
            assert np.isclose(-s, np.dot(x[q], x[i]), atol=1e-12)
        assert found == sorted(found)


def test_few_rows_all_come_back(sc):
    for n in (1, 5, 21, 45):
        rows = vectors(n, 8, seed=n)
        got, want = result(rpforest.search(table(sc, rows * 3), F.col("vec_id") % 20 == 0)), brute(rows)
        assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items() if v}


def test_few_rows_bad_vectors_and_repeats(sc):
    rows = vectors(15, 4) + [(20, None), (21, [0.0] * 4), (22, [1.0, None, 0.0, 0.0]), (23, [float("nan"), 1.0, 0.0, 0.0]), (24, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0] * 4), (25, []), (26, [1.0, 2.0])]
    got = result(rpforest.search(table(sc, rows + [rows[3]]), F.col("vec_id") % 20 == 0, share=9.0))
    want = brute([r for r in rows if r[0] not in (25, 26)])
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert len(got[0]) == 14


def test_common_vector_is_dealt_out_and_ties_go_to_smaller_ids(sc, monkeypatch):
    monkeypatch.setattr(rpforest, "BLOCK_ROWS", 64)
    monkeypatch.setattr(rpforest, "BLOCK_QUERIES", 8)
    rows = vectors(300, 8, 3)
    common = rows[7][1]
    rows = [(i, common if i % 3 == 0 else v) for i, v in rows]
    got, want = result(rpforest.search(table(sc, rows), F.col("vec_id") % 20 == 0, share=9.0)), brute(rows)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_no_usable_rows(sc):
    empty = rpforest.search(table(sc, []), F.col("vec_id") % 20 == 0)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert rpforest.search(table(sc, [(0, None), (20, [0.0, 0.0])]), F.col("vec_id") % 20 == 0).collect() == []
    assert rpforest.search(table(sc, [(0, [1.0, 0.0])]), F.col("vec_id") % 20 == 0).collect() == []
    assert rpforest.search(table(sc, vectors(9)[1:]), F.col("vec_id") % 20 == 0).collect() == []


def test_queue_opens_leaves_in_order_until_the_budget(sc):
    x = np.random.default_rng(1).normal(size=(400, 6))
    f = rpforest.fit(x, trees=3, depth=4)
    leaves = f.leaves(x)
    sizes = np.array([np.bincount(leaves[:, t], minlength=16) for t in range(3)])
    assert (sizes.sum(1) == 400).all()
    opened = f.search(f.sides(x[:1])[0], sizes, 150)
    assert {(t, int(leaves[0, t])) for t in range(3)} <= set(opened) and len(set(opened)) == len(opened)
    held = [sizes[t, leaf] for t, leaf in opened]
    assert sum(held) >= 150 > sum(held[:-1])
