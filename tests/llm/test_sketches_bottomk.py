"""Bottom-k sketches against exact shingle sets."""

import hashlib

import numpy as np
import pyarrow as pa

from buoyline.llm import sketches, textops


def exact(text, k=5):
    w = text.encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def column(*texts):
    return sketches.sketch_column(*textops.column_bytes(pa.array(texts, pa.string())))


def test_word_hashes_do_not_depend_on_the_neighbours():
    a, = column("the quick brown fox jumps over")
    _, b, _ = column("x" * 70, "The  quick\tbrown fox\njumps over", "tail")
    assert a.tolist() == b.tolist() and len(a) == 2
    assert len(column("")[0]) == len(column(" \n\t")[0]) == 0 and len(column("one two")[0]) == 1
    long_words = column("a" * 200 + "b", "b" + "a" * 200, "a" * 64 + "b" + "a" * 136)
    assert len({x[0] for x in long_words}) == 3


def test_slices_and_blocks_give_the_same_sketches():
    texts = [f"word{i} and {i} other words go here {i % 3}" * (i % 7) for i in range(50)]
    whole = column(*texts)
    arr = pa.array(["skipped", *texts], pa.string()).slice(1)
    buf, offs = textops.column_bytes(arr)
    assert [x.tolist() for x in sketches.sketch_column(buf, offs)] == [x.tolist() for x in whole]
    parts = list(textops.blocks(offs, 100))
    assert parts[0][0] == 0 and parts[-1][1] == 50 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_estimates_are_near_exact_sets():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(4000)]
    a = " ".join(rng.choice(words, 6000))
    b = " ".join([a[: len(a) // 2], *rng.choice(words, 3000)])
    x, y = column(a, b)
    ea, eb = exact(a), exact(b)
    assert abs(sketches.resemblance(x, y) - len(ea & eb) / len(ea | eb)) < 0.12
    assert abs(sketches.containment(x, y) - len(ea & eb) / len(ea)) < 0.15
    assert abs(sketches.distinct(x) / len(ea) - 1) < 0.2
    small = column("a b c d e f g", "a b c d e f z")
    assert sketches.resemblance(*small) == 2 / 4 and sketches.containment(*small) == 2 / 3 and sketches.distinct(small[0]) == 3


def test_text_form_round_trips():
    for s in column("", "a b", "a b c d e f g h i j"):
        assert sketches.decode(sketches.encode(s)).tolist() == s.tolist()


def test_merge_equals_the_sketch_of_the_union(sc):
    texts = [(i % 3 if i % 7 else None, " ".join(f"t{(i * j) % 97}" for j in range(1, 120))) for i in range(40)]
    df = sc.createDataFrame(texts, "g int, text string").repartition(5)
    parts = df.select("g", sketches.sketch(df["text"]).alias("fingerprint"))
    got = {r.g: (r.sketch, r.distinct) for r in sketches.merge(parts, "g", salts=3).collect()}
    for g in {t[0] for t in texts}:
        union = np.unique(np.concatenate([s for s in column(*[t for k, t in texts if k == g])]))[:sketches.K]
        assert got[g] == (sketches.encode(union), sketches.distinct(union))
    assert len(got) == 4
    assert sketches.merge(parts.where("g = 99"), "g").collect() == []


def test_compare_columns(sc):
    df = sc.createDataFrame([("a b c d e f g", "a b c d e f z"), ("", ""), (None, "a b c d e")], "a string, b string")
    rows = df.select(sketches.compare(sketches.sketch(df["a"]), sketches.sketch(df["b"])).alias("c")).select("c.*").collect()
    assert sorted(r.resemblance for r in rows) == [0.0, 0.5, 1.0]


def check_neighbours(got, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        e = sketches.edited(t or "", order[(i + 1) % len(order)][1] or "")
        a, b, c = column(t or "", e, order[(i + 1) % len(order)][1] or "")
        want.append((d, len(t or ""), hashlib.sha256(e.encode()).hexdigest(), sketches.encode(a), sketches.resemblance(a, b), sketches.resemblance(a, c)))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_neighbours_and_edited_texts(docs):
    rows = [(i * 5 % 211, f"wörd{i} two three four five six seven eight {i} " * (i % 5 + 1)) for i in range(211)]
    rows += [(3, "dup"), (3, "dup"), (17, None), (None, "no id here"), (-9, ""), (400, "tail " * 4000)]
    for parts in (1, 7, 64):
        df = docs(rows).repartition(3)
        df.sparkSession.conf.set("spark.sql.shuffle.partitions", str(max(1, parts // 4)))
        got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in sketches.fingerprint_neighbours(df).collect()]
        check_neighbours(got, rows)
    df.sparkSession.conf.set("spark.sql.shuffle.partitions", "8")


def test_one_row_no_rows_and_only_null_keys(docs):
    assert sketches.fingerprint_neighbours(docs([])).collect() == []
    for rows in ([(5, "alone with itself here now and then")], [(None, "a b"), (None, "c d e")], [(1, None)]):
        got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in sketches.fingerprint_neighbours(docs(rows)).collect()]
        check_neighbours(got, rows)
