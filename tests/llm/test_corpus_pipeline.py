"""The pipeline's stages against plain Python, and its contract."""

import os
import random
import re
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from buoyline.llm import bpe
from buoyline.llm.queries import vocabulary
from tests.llm.test_langid_network import WORDS
from tests.llm.test_simhash_components import brute_components, plan_after_run

HEX = "11acdfb36bb72224148e6160f674b4be45601bff"


def table():
    rng = random.Random(2)
    rows = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefgh") for _ in range(rng.randint(30, 60))), lang, f"s{i % 3}"))
    rows += [(500, rows[3][1], rows[3][2], "s0"), (501, rows[3][1], rows[3][2], "s0"), (502, None, None, "s1"), (503, "123 ###", None, "s1"),
             (504, rows[9][1] + f' token = "{HEX}" kalo', "aa", None), (505, rows[11][1] + f" commit {HEX} kalo", "aa", "s2"), (3, rows[3][1], rows[3][2], "s0"), (None, rows[3][1], rows[3][2], "s0")]
    return rows


def test_stages(sc, docs):
    rows = table()
    frame = docs(rows)
    one = corpus_pipeline.language_id(sc, frame, "")
    kept = one.select("doc_id", "text").collect()
    assert one.columns == frame.columns and len(kept) == len(rows) - 2 and not {502, 503} & {r.doc_id for r in kept}
    two = corpus_pipeline.near_dedup(sc, one, "")
    groups = brute_components([(r.doc_id, r.text) for r in kept])
    assert two.columns == frame.columns
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, _, c in groups})
    three = corpus_pipeline.secrets(sc, two, "")
    assert three.schema == frame.schema or three.columns == frame.columns
    texts = {r.doc_id: r for r in three.collect()}
    before = {r.doc_id: r.text for r in two.collect()}
    assert texts.keys() == before.keys()
    for d, r in texts.items():
        want = before[d].replace(HEX, corpus_pipeline.REDACTED) if d == 504 else before[d]
        assert r.text == want and r.n_chars == len(want)
    four = corpus_pipeline.mix(sc, three, "")
    assert four.columns == frame.columns
    counts = {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert set(counts) <= set(before) and max(counts.values()) <= 3
    five = {(r.doc_id, r.n_tokens) for r in corpus_pipeline.encode(sc, four, "").collect()}
    tok = bpe.tokenizer(vocabulary())
    assert five == {(d, len(tok.encode(texts[d].text, add_special_tokens=False).ids)) for d in counts}


def test_empty_table_through_all_stages(sc, docs):
    frame = docs([])
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(sc, frame, "")
        assert frame.collect() == [], name


def test_null_keys_of_different_texts_all_stay(sc, docs):
    frame = docs([(None, "a b c d e f g", "aa"), (None, "h i j k l m n", "aa"), (None, "h i j k l m n", "aa")])
    assert sorted(r.text[0] for r in corpus_pipeline.near_dedup(sc, frame, "").collect()) == ["a", "h"]


def test_near_dedup_broadcasts_no_groups_or_ids(sc, docs):
    frame = docs([(i, f"a text of {i % 7} words", "aa") for i in range(50)])
    plan = plan_after_run(corpus_pipeline.near_dedup(sc, frame, ""))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_secret_inside_another_leaves_no_rest(sc, docs):
    text = f'token = "{HEX[:32]}" and secret = "{HEX}" then'
    (row,) = corpus_pipeline.secrets(sc, docs([(1, text, "aa", "s0")]), "").collect()
    assert row.text == 'token = "[secret]" and secret = "[secret]" then' and row.n_chars == len(row.text)


def test_redaction_takes_short_values_alone_and_any_characters(sc):
    rows = [("password: hunter then xhunters hunter. (hunter)", ["hunter"], "password: [secret] then xhunters [secret]. ([secret])"),
            (r"token = a\Eb$1(c x", [r"a\Eb$1(c"], "token = [secret] x"),
            ("x" + HEX + "y", [HEX], "x[secret]y"),
            ("pass#1! é pass#1!\npass#1!2", ["pass#1!"], "[secret] é [secret]\npass#1!2"),
            (" ".join(f"k{i:015d}z" for i in range(3000)), [f"k{i:015d}z" for i in range(3000)], " ".join(["[secret]"] * 3000))]
    frame = sc.createDataFrame([(t, s) for t, s, _ in rows], "text string, secrets array<string>")
    assert [r[0] for r in frame.select(corpus_pipeline.redacted(F.col("text"), F.col("secrets"))).collect()] == [w for _, _, w in rows]


def test_run_writes_between_stages_and_returns_the_last(sc, tmp_path, docs):
    docs(table()).drop("key", "fp").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(sc, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_nothing_else_imports_the_operators():
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, names in os.walk(os.path.join(top, "buoyline")):
        if not folder.endswith("llm"):
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, n)).read()), n
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "bpe"] and F and sys


def test_clean_texts_in_several_languages_stay(sc, docs):
    rng = random.Random(4)
    rows = table()
    part = lambda lang: " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefgh") for _ in range(400))
    rows.append((900, " ".join(part(lang) for lang in WORDS), None, "s0"))
    assert len(WORDS) >= 3 and 900 in {r.doc_id for r in corpus_pipeline.language_id(sc, docs(rows), "").collect()}


def test_documents_stay_without_a_label(sc, docs):
    rows = [(i, text, None, "s0") for i, text in enumerate(["some words", "andere Worte", "123 ###", None])]
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(sc, docs(rows), "").collect()) == [0, 1]
