"""Base rules against the plain patterns, and what the semi-Markov CRF adds."""

import hashlib
import random
import re

import numpy as np
import pytest

from buoyline.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return [(list(RULES)[k], a, b) for a, k, b in sorted(out)]


@pytest.fixture(scope="module")
def model():
    return pii.fit(None)


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choices("aZ0123459@@..+- (%)xé", k=rng.randint(0, 45)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_base_rules_are_linear_on_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 150_000):
        pii.base_spans(text)


@pytest.mark.parametrize("text,added", [
    ("please call 663-555-0199 now", "phone:12:24"), ("ann (at) example (dot) org", "email:0:26"),
    ("card 4111.1111.1111.1111", "card:5:24"), ("visa 4111 1111 1111 1112", ""), ("look at home. That is it", ""),
    ("date 2024-01-10 12:00", ""), ("order 663-555-0199 x", ""), ("no number here", ""),
])
def test_model_adds_other_spellings_and_leaves_clean_text_alone(model, text, added):
    assert pii.spell(pii.find(model, text)[1]) == added


def test_base_spans_stay_and_added_ones_touch_none(model):
    rng = random.Random(3)
    for text, _, _ in pii.made_examples(300, seed=9):
        text += rng.choice([" 4111 1111 1111 1111", " a@b.org", " +1 (663) 555-0199 4465758382889437", ""])
        base, added = pii.find(model, text)
        assert base == brute(text)
        assert not any(a < y and x < b for _, a, b in added for _, x, y in base)


def test_forward_backward_equals_enumeration():
    segs = [(0, 2, 0, 2), (1, 3, 1, 3), (2, 3, 2, 3)]
    scores = np.random.default_rng(0).normal(size=(3, len(pii.KINDS)))
    marginal, log_z = pii._forward_backward(3, segs, scores)
    sets = [(), (0,), (1,), (2,), (0, 2)]  # segments that do not overlap
    weights = {s: np.prod([np.exp(scores[i]).sum() for i in s]) for s in sets}
    z = sum(weights.values())
    assert np.isclose(log_z, np.log(z))
    assert np.isclose(marginal[0].sum(), (weights[(0,)] + weights[(0, 2)]) / z)


def test_held_out_examples_are_found(model):
    hits = total = false = 0
    for text, island, gold in pii.made_examples(400, seed=77):
        got = {(k, a, b) for k, a, b, p in pii.decode(model, text, island) if p >= pii.CONFIDENT}
        hits, total, false = hits + len(got & set(gold)), total + len(gold), false + len(got - set(gold))
    assert hits >= 0.85 * total and false <= 0.05 * total


def test_scan_of_a_table(docs, model):
    rows = [(1, "mail a@b.org or +1 (663) 555-0199"), (1, "mail a@b.org or +1 (663) 555-0199"), (2, None), (None, ""), (3, "é 10.0.0.1 " * 5000)]
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.scan(docs(rows), model).collect()}
    want = set()
    for d, t in rows:
        spans = brute(t or "")
        n = [sum(k == kind for k, _, _ in spans) for kind in RULES]
        want.add((d, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert got == want
    assert pii.scan(docs([]), model).collect() == []


def test_fit_on_a_table_keeps_the_rules(docs):
    rows = [(i, f"text {i} 4465758382889437 and +1 (663) 555-01{i:02d} a{i}@b.org") for i in range(64)]
    m = pii.fit(docs(rows))
    assert pii.find(m, "x 4465758382889437 y")[1] == []


def test_addresses_with_parts_of_many_digits():
    zeros = "0" * 6000
    assert pii.base_spans(f"{zeros}1.2.3.{zeros}255 x") == [("ip", 0, 6001 + 5 + 6003)]
    assert pii.base_spans(f"1.2.3.{'9' * 6000} x") == []


def test_long_runs_of_numbers_are_searched_whole(model):
    numbers = [f"663-555-01{i:02d}" for i in range(40)]
    for gap in (" / ", " "):
        text = "phones: call " + gap.join(numbers) + " end"
        assert [(k, text[a:b]) for k, a, b in pii.find(model, text)[1]] == [("phone", n) for n in numbers]
    assert pii.find(model, "order " + " / ".join(numbers))[1] == []


def test_defanged_addresses_of_few_digits(model):
    text = "ping host 10[.]0[.]0[.]1 and server 8[.]8[.]4[.]4 now"
    assert [(k, text[a:b]) for k, a, b in pii.find(model, text)[1]] == [("ip", "10[.]0[.]0[.]1"), ("ip", "8[.]8[.]4[.]4")]


def test_long_runs_cost_linear_time(model):
    for text in ("1" * 300_000, "1 " * 3_000, "663-555-0100 / " * 500):
        pii.find(model, text)


def test_fit_on_a_table_full_of_other_spellings_still_adds_them(docs):
    rows = [(i, f"please call 663-555-{i:04d} or write to ann{i} (at) example (dot) org, host 10[.]0[.]{i % 256}[.]1 on 2024-01-10") for i in range(1600)]
    m = pii.fit(docs(rows))
    for text, added in [("please call 663-555-0199 now", "phone:12:24"), ("ann (at) example (dot) org", "email:0:26"), ("ping host 10[.]0[.]0[.]1 now", "ip:10:24"), ("date 2024-01-10 12:00", "")]:
        assert pii.spell(pii.find(m, text)[1]) == added
