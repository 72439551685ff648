"""SimHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from buoyline.llm import connected, simhash


def brute_fp(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    runs = [words[i:i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words]
    hs = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    """{doc_id: smallest reachable}; rows: (doc_id, text)."""
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.f, r.component_id) for r in df.withColumn("f", simhash.fingerprint_hex("fp")).collect()), key=str)


def test_components_equal_brute_force(docs):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ß", "UPPER"]
    rows = []
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 400))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (503, "one"), (504, "one two"), (None, "one two"), (505, "ONE  two")]
    rows.append((506, "long " * 50_000))
    assert got(simhash.components(docs(rows))) == brute_components(rows)


def test_empty_table_and_only_null_keys(docs):
    assert simhash.components(docs([])).collect() == []
    rows = [(None, "a b c d"), (None, "a b c d")]
    assert got(simhash.components(docs(rows))) == brute_components(rows)


@pytest.mark.parametrize("block", [1024, 4])
def test_links_connect_what_brute_force_links_in_blocks_of_any_size(sc, block):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {0}
    for c in centres:
        for _ in range(40):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = sc.createDataFrame([(f,) for f in signed], "fp long")
    stars = {r.node: r.root for r in connected.components(simhash.links(df, 3, block=block)).collect()}
    root = {f: f for f in signed}
    changed = True
    while changed:
        changed = False
        for a, x in zip(fps, signed):
            for b, y in zip(fps, signed):
                if (a ^ b).bit_count() <= 3 and root[x] != root[y]:
                    root[x] = root[y] = min(root[x], root[y])
                    changed = True
    want = {}
    for f in signed:
        want.setdefault(root[f], set()).add(f)
    have = {}
    for f in signed:
        have.setdefault(stars.get(f, f), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_long_chain_is_one_component(sc):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)]
    df = sc.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in connected.components(df).collect()}
    assert all(roots[i] == 0 for i in range(301)) and roots[1001] == 1000 and len(roots) == 303


def plan_after_run(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_of_few_fingerprints_broadcast_none_of_their_variants(sc):
    rng = np.random.default_rng(2)
    fps = rng.integers(-(1 << 62), 1 << 62, 3000)
    df = sc.createDataFrame([(int(f) ^ b,) for f in fps for b in (0, 1)], "fp long").repartition("fp").distinct()
    plan = plan_after_run(simhash.links(df, 3))  # 6,000 fingerprints are sized as far below the broadcast limit
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_joins_of_edges_and_groups_broadcast_nothing(sc, docs):
    edges = sc.createDataFrame([(i + 1, i) for i in range(100)], "hi long, lo long").repartition("hi")
    found = simhash.components(docs([(i, f"a text of {i % 7} words") for i in range(50)]))
    for df in (connected._large_star(edges, few=False), connected._small_star(edges, few=False), found):
        plan = plan_after_run(df)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("few", [0, 5, 100_000])
def test_components_are_the_same_with_and_without_broadcasts(sc, monkeypatch, few):
    monkeypatch.setattr(connected, "FEW", few)
    df = sc.createDataFrame([(i, i + 2) for i in range(40)], "a long, b long")
    assert {(r.node, r.root) for r in connected.components(df).collect()} == {(i, i % 2) for i in range(42)}


def test_distance_beyond_the_method_is_refused(sc):
    with pytest.raises(ValueError):
        simhash.links(sc.createDataFrame([(1,)], "fp long"), 4)
