"""The recurrent network against finite differences and a plain loop; scores on made and given tables."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buoyline.llm import common, toxicity as T


def test_gradients_equal_finite_differences():
    net, rng = T.fresh(3, np.float64), np.random.default_rng(0)
    x = T.inputs(pa.array(["ab", "cde", "xyzzy", "q", "hello"], pa.large_string()))
    at = rng.integers(0, 5, (6, T.WINDOW))
    at[0, 5:] = at[1, 1:] = -1
    y = np.array([1, 0, 1, 0, 1, 0.0])
    _, g = T.gradients(net, x, at, y)
    for p, own in g.items():
        flat = getattr(net, p).ravel()
        for i in np.argsort(-abs(own.ravel()))[:3]:
            old, loss = flat[i], []
            for e in (1e-5, -1e-5):
                flat[i] = old + e
                loss.append(T.gradients(net, x, at, y)[0])
            flat[i] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - own.ravel()[i]) < 1e-6, p


def plain_probability(net, vecs):
    """One window, word by word."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    h = T.HIDDEN

    def read(words, w, b, u):
        state, out = np.zeros(h), []
        for v in words:
            x, own = v @ w + b, state @ u
            z, r = sig(x[:h] + own[:h]), sig(x[h:2 * h] + own[h:2 * h])
            state = z * state + (1 - z) * np.tanh(x[2 * h:] + r * own[2 * h:])
            out.append(state)
        return out

    forth = read(vecs, net.forth, net.forth_bias, net.forth_state)
    back = read(vecs[::-1], net.back, net.back_bias, net.back_state)[::-1]
    both = [np.concatenate(p) for p in zip(forth, back)]
    look = np.array([np.tanh(s @ net.look + net.look_bias) @ net.focus for s in both])
    weight = np.exp(look - look.max()) / np.exp(look - look.max()).sum()
    return sig(sum(w * s for w, s in zip(weight, both)) @ net.out + net.out_bias[0])


def plain_windows(n):
    if n <= T.WINDOW:
        return [(0, n)] if n else []
    return [(s, min(s + T.WINDOW, n)) for s in range(0, T.STRIDE * (math.ceil((n - T.WINDOW) / T.STRIDE)) + 1, T.STRIDE)]


def test_windows_cover_every_run_and_equal_a_plain_cut():
    for sizes in ([0, 1, 32, 33, 56, 57, 200], [5], []):
        row = np.repeat(np.arange(len(sizes)), sizes)
        at, of = T.windows(row)
        start = np.concatenate(([0], np.cumsum(sizes))).astype(int)
        want = [(i, list(range(start[i] + a, start[i] + b))) for i, n in enumerate(sizes) for a, b in plain_windows(n)]
        assert [(int(o), [int(p) for p in w if p >= 0]) for o, w in zip(of, at)] == want


def test_scores_equal_a_plain_loop(docs):
    net, rng = T.fresh(5), random.Random(1)
    words = ["ab", "Cde", "idiot", "ünïcode", "x1", "q"]
    rows = [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate((1, 7, 32, 33, 90))]
    rows += [(5, None), (6, ""), (7, " .!? "), (1, rows[1][1]), (None, "ab q")]
    got = sorted(((r.doc_id, r.score) for r in T.score(docs(rows), net).collect()), key=str)

    def plain(text):
        names = [w.lower().replace("Ü", "ü") for w in (text or "").split() if w[0].isalnum()]
        if not names:
            return 0.0
        vecs = T.vectors(net, T.inputs(pa.array(names, pa.large_string())))
        return max(float(plain_probability(net, vecs[a:b])) for a, b in plain_windows(len(names)))

    want = sorted(((i, plain(t)) for i, t in rows), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-4 for (_, a), (_, b) in zip(got, want))


def test_a_long_text_is_scored_to_its_end(docs):
    net = T.fresh(5)
    text = "the word and " * 400_000  # over five megabytes: several blocks
    (whole, marked) = (r.score for r in T.score(docs([(1, text), (2, text + "zzz qqq xxx")]), net).orderBy("doc_id").collect())
    assert 0 < whole <= 1 and 0 < marked <= 1
    assert T.score(docs([(1, text)]), None).first().score == 0.0
    assert T.score(docs([]), net).collect() == []


@pytest.fixture(scope="module")
def learnt(spark):
    sc = common.prepare(spark)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(600)]
    bad = ["vilest", "rotten", "hateful", "nasty"]

    def text(toxic):
        w = rng.choices(words, k=rng.randint(20, 150))
        for _ in range(2 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        return " ".join(w)

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(900)]
    docs = sc.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = sc.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    return docs, labels, T.fit(docs, labels, per_class=(500, 300))


def test_held_out_accuracy(learnt):
    docs, labels, net = learnt
    got = T.score(docs, net).join(labels, "doc_id").where(T.held_out(F.col("doc_id"))).where("toxic is not null").collect()
    assert len(got) > 100 and sum((r.score >= 0.5) == (r.toxic == 1) for r in got) >= 0.95 * len(got)


def test_fit_is_bounded_deterministic_and_needs_both_classes(learnt):
    docs, labels, net = learnt
    again = T.fit(docs.unionByName(docs), labels.unionByName(labels), per_class=(500, 300))
    assert (again.out == net.out).all() and (again.words == net.words).all()
    assert T.fit(docs, labels.where("toxic = 1")) is None and T.fit(docs.limit(0), labels) is None
    # Labels of held-out keys and keys labelled both ways take no part.
    wrong = labels.where(T.held_out(F.col("doc_id"))).withColumn("toxic", 1 - F.col("toxic"))
    assert (T.fit(docs, labels.where(~T.held_out(F.col("doc_id"))).unionByName(wrong), per_class=(500, 300)).out == net.out).all()
