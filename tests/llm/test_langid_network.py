"""Byte convolutional network: windows, gradients by accuracy, and the query's contract."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from buoyline.llm import langid, textops

WORDS = {"aa": ["kalo", "mira", "tavo", "ösel"], "bb": ["thrind", "shwog", "plenk", "grust"], "cc": ["çeni", "élouva", "nière", "quaté"]}


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 80))), lang))
    return out


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_windows_cover_every_byte_run():
    texts = ["", "a", "b" * 159, "c" * 160, "d" * 161, "0123456789" * 70]
    buf, offs = textops.column_bytes(pa.array(texts))
    x, doc = langid.windows(buf, offs)
    assert set(doc) == {1, 2, 3, 4, 5}
    for d, t in enumerate(texts):
        own = [bytes(w).rstrip(b"\0") for w in x[doc == d]]
        for i in range(len(t) - 3):
            assert any(t[i:i + 4].encode() in w for w in own)


def test_learns_and_predicts_held_out_rows(docs):
    data = rows(600)
    table = docs([(i, t, lang) for i, t, lang in data])
    net = langid.fit(table)
    got = {r.doc_id: r for r in langid.predict(table, net).collect()}
    test = [r for r in data if held(r[0])]
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_never_used(docs):
    data = rows(300)
    net = langid.fit(docs([(i, t, lang) for i, t, lang in data]))
    other = langid.fit(docs([(i, t, "zz" if held(i) else lang) for i, t, lang in data]))
    assert net.languages == other.languages and np.array_equal(net.dense, other.dense)


def test_undetermined_and_odd_rows(docs):
    table = docs([(i, t, lang) for i, t, lang in rows(200)] + [(900, None, "aa"), (901, "", None), (902, "123 !!! \n", "bb"), (903, "kalo mira " * 30_000, None), (None, "kalo mira tavo", None), (904, "thrind shwog plenk", None), (904, "thrind shwog plenk", None)])
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(table, langid.fit(table)).collect()]
    found = {d: (lang, s) for d, lang, s in got}
    assert found[900] == found[901] == found[902] == ("und", 0.0)
    assert found[903][0] == "aa" and found[904][0] == "bb" and len(got) == 207
    assert sum(d == 904 for d, _, _ in got) == 2


def test_nothing_to_learn_from(docs):
    assert langid.fit(docs([])) is None and langid.fit(docs([(1, "x", None), (2, None, "aa")])) is None
    assert [(r.lang_pred, r.score) for r in langid.predict(docs([(1, "x")]), None).collect()] == [("und", 0.0)]
    assert langid.predict(docs([]), None).collect() == []


def test_rare_language_is_learned_beside_a_hot_one(docs):
    data = [(i, t, lang) for i, t, lang in rows(2000, 5) if lang == "aa"] + [(10_000 + i, t, lang) for i, t, lang in rows(60, 6) if lang != "aa"]
    table = docs(data)
    net = langid.fit(table, per_language=200)
    got = {r.doc_id: r.lang_pred for r in langid.predict(table, net).collect()}
    assert sum(got[i] == lang for i, _, lang in data) >= 0.95 * len(data)


@pytest.mark.parametrize("name", ["dense", "filters", "embedding", "bias"])
def test_gradient_step_lowers_the_loss(name):
    rng = np.random.default_rng(0)
    x = rng.integers(97, 110, (256, langid.WINDOW)).astype(np.uint8)
    x[::2] += 10
    y = np.arange(256) % 2 == 0
    net = langid.train(x, y.astype(int), ["p", "q"], epochs=2)
    logp = langid.log_probabilities(net, x)
    assert (logp.argmax(1) == y).mean() > 0.95 and getattr(net, name).dtype == np.float32
