"""Phrase mining against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from buoyline.llm import phrases


def plain_counts(rows, least):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, " ".join(w[i:i + k])] += 1
    return {p: a for p, a in f.items() if a >= least}, n


def plain_collocations(rows, least, top):
    f, n = plain_counts(rows, least)
    out = []
    for lang in n:
        scored = []
        for (own, p), a in f.items():
            w = p.split(" ")
            if own != lang or len(w) < 2 or any(o == lang and b >= a and len(q) > len(p) and f" {p} " in f" {q} " for (o, q), b in f.items()):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.append((-score, -a, p.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "Red", "fox", "été", "of", "zebra", "x", "y"]
    line = "one Two three four five six"
    rows = []
    for i in range(n):
        parts = [line if rng.random() < 0.3 else " ".join(rng.choices(words, weights=[8, 6, 5, 4, 3, 2, 1, 1], k=rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(p + rng.choice([". ", "\n", "  ", "\t", "! ", ",", " ", "\x85"]) for p in parts), rng.choice(["en", "fr", None, "und"])))
    return rows + [(None, line, "en"), (3, None, "en"), (4, "", "de"), (5, "hey " * 40, "fr"), (5, "hey " * 40, "fr")]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_a_plain_count(docs, seed):
    rows = made(seed)
    got = phrases.mine(docs(rows), least=8, top=12, bits=16).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 8, 12)


@pytest.mark.parametrize("share,bits", [(0.0, 14), (0.02, 20), (1.0, 10)])
def test_any_sample_and_any_bitmap_give_the_same_counts(docs, share, bits):
    """Nothing proposed (all by the border and one expansion), little, or all with many shared bits."""
    rows = made(5)
    want, n = plain_counts(rows, 8)
    got = phrases.frequent(docs(rows), least=8, share=share, bits=bits).collect()
    assert {(r.lang, r.phrase): r.n for r in got if r["size"]} == want and len(got) == len(want) + len([r for r in got if not r["size"]])
    assert {r.lang: r.n for r in got if not r["size"]} == {k: v for k, v in n.items()}


def test_phrases_across_the_blocks_of_a_long_text(docs):
    text = "alpha beta gamma delta " * 150_000  # more than a block, one piece
    want, _ = plain_counts([(1, text, "en")], 1000)
    got = phrases.frequent(docs([(1, text, "en")]), least=1000, bits=16).where("size > 0").collect()
    assert {(r.lang, r.phrase): r.n for r in got} == want


def test_scores_beyond_64_bits_are_exact(sc):
    big = 10**15
    rows = [("en", None, 0, 4 * big), ("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big + 1), ("en", "a b", 2, 2 * big)]
    (got,) = phrases.collocations(sc.createDataFrame(rows, "lang string, phrase string, size int, n long")).collect()
    assert got.score == 1000 * (2 * big) * (4 * big) // ((3 * big) * (2 * big + 1))


def test_empty_table(docs):
    assert phrases.mine(docs([]), bits=12).collect() == []
    assert phrases.mine(docs([(1, None, None), (2, " .,", "en")]), bits=12).collect() == []


def test_tallies_hold_every_phrase_that_reaches_the_threshold_and_no_other(docs, monkeypatch):
    """Put together in small portions, over several tasks, with a count beyond a byte."""
    monkeypatch.setattr(phrases, "HELD", 40)
    rows = made(7) + [(9, "many " * 700, "en")]
    table = phrases.prepared(docs(rows).repartition(5))
    every = phrases.Proposed([~m for m in phrases._empty(20).maps])
    for least in (8, 300):
        want, _ = plain_counts(rows, least)
        got = phrases.tallied(table, {1, 2, 5}, every, least, 20)
        bits = [int(np.unpackbits(m).sum()) for m in got.maps]
        assert bits == [sum(len(p.split(" ")) == k for _, p in want) if k in (1, 2, 5) else 0 for k in range(1, 6)]


def test_the_full_pass_passes_on_little_for_a_rare_phrase(docs):
    """A phrase that stays below the threshold costs a bucket's few bytes, its words do not travel."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"word{rng.randrange(400)}" for _ in range(300)), "en") for i in range(200)]
    table = phrases.prepared(docs(rows).repartition(4))
    every = phrases.Proposed([~m for m in phrases._empty(20).maps])
    reach = phrases.tallied(table, {1, 2, 3, 4, 5}, every, 100, 21)
    counted = phrases.count(table, every, every, reach).where("size > 0").collect()
    want, _ = plain_counts(rows, 100)
    assert {(r.lang, r.phrase): r.n for r in counted if r.n >= 100} == want
    assert len(counted) < len(want) + 100  # some 220,000 phrases are candidates
