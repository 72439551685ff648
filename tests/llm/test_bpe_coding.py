"""Tree concatenation and the remembered chunks against the tokenizers library itself."""

import hashlib
import json
import random

import pyarrow.parquet as pq
import pytest

from buoyline.llm import bpe
from buoyline.llm.queries import vocabulary

PARTS = ["a", "b", "e", "th", "ing", "'", "'s", "'ll", "''", "!", "!!!", "1", "23", " ", "  ", "\n", "́", "é", "é", "ß", "İ", "한", "ᄒ", "ᅡ",
         "😀", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "क", "ि", "ﬁ", " ", "​", "A", "Z", "\x1c", "\x85", "中文", "Σ", "ς", "\x00", "\x0b"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(rng.sample(PARTS, rng.randint(1, 8)), k=rng.randint(0, 150))) for _ in range(n)]


def library(path, s):
    tok = bpe.tokenizer(path)
    ids = tok.encode(s, add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [3, 8, 64])
def test_tree_concatenation_equals_the_library(leaf):
    path = vocabulary()
    sample = texts(800, leaf)
    for s, ids in zip(sample, bpe.encode(path, sample, leaf)):
        assert ids.tolist() == library(path, s)[0], repr(s)


@pytest.mark.parametrize("text", ["a" * 20_000, "ththeing" * 4_000, "!" * 9_000, "中" * 5_000, "é" * 9_000, "x'll" * 3_000])
def test_long_unsplit_text(text):
    path = vocabulary()
    assert bpe.encode(path, [text])[0].tolist() == library(path, text)[0]


def test_whole_texts_through_the_coder():
    path = vocabulary()
    sample = texts(2000, 99) + ["", " ", "Hello, WORLD it's 42!", "x" * 3000 + " end"]
    for s, got in zip(sample, bpe.Coder(path, 16).texts(sample)):
        ids, plain = library(path, s)
        assert got == (len(ids), " ".join(map(str, ids)), plain), repr(s)


@pytest.mark.parametrize("part", [3, 10, 40, 200])
def test_whole_texts_through_the_tree(part):
    path = vocabulary()
    long = ["a b " * 300, "word" * 300 + " x", " " * 900, "x " + "y" * 700 + " z", "\n".join("one two, three's" for _ in range(90)), "中文 " * 200 + "é" * 300]
    sample = texts(400, part) + long + ["".join(random.Random(part).choices("ab '\t\x0b1é", k=1500))]
    coder = bpe.Coder(path, 16, part)
    for s, got in zip(sample, coder.texts(sample)):
        ids, plain = library(path, s)
        assert got == (len(ids), " ".join(map(str, ids)), plain), repr(s)
    assert coder.trees == sum(len(s) > part for s in sample)


def test_every_long_document_passes_the_tree():
    path = vocabulary()
    docs = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    coder = bpe.Coder(path)
    for s, got in zip(docs, coder.texts(docs)):
        ids, plain = library(path, s)
        assert got == (len(ids), " ".join(map(str, ids)), plain)
    assert coder.trees == sum(len(s) > bpe.PART for s in docs) > 0


def test_a_huge_text_without_a_blank():
    path = vocabulary()
    text = "".join(random.Random(1).choices(["the", "in", "g", "é", "1", "!", "中"], k=300_000))
    ids, _ = library(path, text)
    assert bpe.Coder(path).texts([text])[0][1] == " ".join(map(str, ids))


def test_other_rules_are_refused(tmp_path):
    rules = json.loads(open(vocabulary(), encoding="utf-8").read())
    rules["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules), encoding="utf-8")
    with pytest.raises(ValueError, match="rules"):
        bpe.Coder(str(path))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    path = vocabulary()
    coder = bpe.Coder(path)
    for s in texts(60, 5):
        assert coder.texts([s])[0][1] == " ".join(map(str, library(path, s)[0]))


def test_digests_of_a_table(docs):
    path = vocabulary()
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (None, ""), (3, "word " * 20_000), (4, "z" * 5000)]
    got = sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, len(r.ids)) for r in bpe.digests(docs(rows), path, with_ids=True).collect()], key=str)
    want = []
    for d, t in rows:
        ids, plain = library(path, t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest(), len(ids)))
    assert got == sorted(want, key=str)
    assert bpe.digests(docs([]), path).collect() == []
