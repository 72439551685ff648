"""Ranked search against plain Python; the graph of shared sums against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from buoyline.llm import ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, top):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, words = len(counts), sum(s for _, _, s in counts)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for key, c, size in counts:
            m = 50 + (50 * size * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in d for _, d, _ in counts) + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -s) for rank, (s, _, _, key) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def made(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "été", "ß", "日本"]
    text = lambda k: "".join(rng.choice(words[: rng.choice([5, 20, 64])]) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(k))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n)] + [(None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2"), (8, None), (9, ""), (10, "w3 " * 5000)]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(None, "w1 w2 w3"), (3, "w50 w51"), (90, None), (91, "--"), (92, "unknownterm"), (93, "w1 w1 W1")]
    return docs, items


@pytest.mark.parametrize("seed,at_once", [(1, 2048), (2, 7)])
def test_search_equals_plain_python(sc, docs, seed, at_once):
    rows, items = made(seed)
    got = ranking.search(docs(rows), sc.createDataFrame(items, "item_id long, text string"), top=8, items_at_once=at_once)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows, items, 8)


def test_more_documents_than_a_block_and_ties(sc, docs):
    rows = [(5000 - i, "same words here") for i in range(3000)] + [(10_000 + i, "others") for i in range(4000)]
    items = sc.createDataFrame([(1, "same here"), (2, "words")], "item_id long, text string")
    got = ranking.search(docs(rows), items, top=5).collect()
    assert sorted((r.item_id, r.rank, r.doc_id) for r in got) == [(i, k, 2000 + k) for i in (1, 2) for k in range(1, 6)]


def test_graph_sums_equal_plain_sums_and_share_work():
    rng = random.Random(3)
    common = [sorted(rng.sample(range(80), 12)) for _ in range(4)]
    sets = [sorted(set(rng.choice(common) + rng.choice(common) + rng.sample(range(80), 5))) for _ in range(60)]
    g = ranking.shared_graph(sets, 80)
    part = np.random.default_rng(0).integers(0, 1000, (80, 9))
    term, doc = (v.ravel() for v in np.meshgrid(range(80), range(9), indexing="ij"))
    got = ranking.accumulators(g, doc, term, part[term, doc], 9)
    assert (got == np.array([part[s].sum(0) for s in sets])).all()
    assert g.shared > 20 and len(g.left) < 0.6 * sum(len(s) - 1 for s in sets)  # additions spared
    assert [a for a, _ in g.levels] == [80] + [b for _, b in g.levels][:-1]


def test_graph_of_single_terms_and_equal_items():
    g = ranking.shared_graph([[0], [0, 1, 2], [2, 1, 0]], 3)
    assert g.roots[0] == 0 and g.roots[1] == g.roots[2]


def test_empty_tables(sc, docs):
    items = sc.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.search(docs([]), items).collect() == []
    assert ranking.search(docs([(1, "a")]), items.limit(0)).collect() == []
    assert ranking.search(docs([(1, None), (2, "!")]), items).collect() == []
