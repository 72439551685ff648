"""BPE encoding of whole texts by tree concatenation.

A text of more than PART characters is halved, and halved again, wherever that
cuts, until its parts are short; the parts of all texts of a batch are encoded
independently. Neighbours are then joined level by level: a window of the raw
text around the join is encoded again and grown until it agrees with the left
side before the join and with the right side after it. What lies between the
two agreements comes from the window.

Within a part, the tokenizer's own rules never let a token span ASCII white
space (`check_rules` refuses a file with other rules), so the tokens between
two blanks, a chunk, are encoded together and agree together. The chunks repeat
a lot: each task remembers their encodings (a bounded memory that only saves
time).

A chunk longer than LEAF characters is long unsplit text, and goes through a
tree of its own, token by token: its pieces are encoded in one call and joined
level by level: a window around the join, taken from the raw text at token borders, is
encoded again and grown until it agrees with the left side in a token before
the join and with the right side in a token after it. What lies between the
two agreeing tokens comes from the window.

Why that is exact: BPE tokens of one word are right if and only if every two
adjacent ones are what BPE makes of their own text, and the window shares a
whole token with each side, so every adjacent pair stands unchanged in one of
three right encodings. Tokens next to an artificial cut are never used for
agreement, since a cut looks like the end of a word there.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from buoyline.llm import common

PART = 4096  # characters of a whole text's part that is encoded by itself
REACH_CHUNKS = 2  # chunks on each side of a join that the first window takes in, beside its own ends
LEAF = 256  # characters of a piece of unsplit text that is encoded at once
REMEMBERED = 1 << 18  # chunk encodings, and word encodings, that a worker keeps
CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
REACH = 16  # tokens on each side of a join that the first window takes in
_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker; truncation and padding off."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
    return _LOADED[path]


class Piece:
    """Tokens of text[start:stop]: ids and character spans within the whole text."""

    __slots__ = ("start", "stop", "ids", "lo", "hi")

    def __init__(self, start: int, stop: int, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.start, self.stop, self.ids, self.lo, self.hi = start, stop, ids, lo, hi


def _pieces(tok, texts: list[str], spans: list[tuple[int, int, int]]) -> list[Piece]:
    """Encode text[n][a:b] for every (n, a, b) in one call."""
    done = tok.encode_batch([texts[n][a:b] for n, a, b in spans], add_special_tokens=False)
    out = []
    for (_, a, b), enc in zip(spans, done):
        at = np.array(enc.offsets, np.int64).reshape(-1, 2) + a
        out.append(Piece(a, b, np.array(enc.ids, np.int64), at[:, 0], at[:, 1]))
    return out


def _agree(side: Piece, window: Piece, fake_end: int | None, last: bool) -> tuple[int, int] | None:
    """Indices (side, window) of a token both have, with equal id and span, away from artificial cuts.

    The first such token from the window's left, or the last one from its
    right; `fake_end` is the position of a cut that must not touch it.
    """
    a, b = np.searchsorted(side.lo, (window.start, window.stop))
    keys = {(i, lo, hi): k for k, (i, lo, hi) in enumerate(zip(side.ids[a:b].tolist(), side.lo[a:b].tolist(), side.hi[a:b].tolist()), int(a))}
    order = range(len(window.ids) - 2, 0, -1) if last else range(1, len(window.ids) - 1)
    for w in order:  # never the window's first or last token
        key = (int(window.ids[w]), int(window.lo[w]), int(window.hi[w]))
        k = keys.get(key)
        if k is not None and (fake_end is None or key[2] < fake_end):
            if window.lo[w] >= window.hi[w - 1] and window.hi[w] <= window.lo[w + 1]:  # no character shared with a neighbour
                return k, w
    return None


def _joined(left: Piece, right: Piece, window: Piece, whole: tuple[int, int]) -> Piece | None:
    """Left and right made one through the window, or None if the window must grow."""
    if window.start <= left.start:
        u = (0, 0)  # the window starts where the left side does: nothing of it is kept
    else:
        u = _agree(left, window, left.stop, last=False)
    if window.stop >= right.stop:
        t = (len(right.ids), len(window.ids))
    else:
        t = _agree(right, window, None, last=True)
        if t is not None and t[1] < len(window.ids) and window.hi[t[1]] >= window.stop:
            t = None
        if t is not None and right.lo[t[0]] <= right.start and right.start > whole[0]:
            t = None  # it begins at the artificial cut itself
    if u is None or t is None or u[1] > t[1]:
        return None
    parts = [(left, 0, u[0]), (window, u[1], t[1]), (right, t[0], len(right.ids))]
    return Piece(left.start, right.stop, *[np.concatenate([getattr(p, f)[a:b] for p, a, b in parts]) for f in ("ids", "lo", "hi")])


def _window(left: Piece, right: Piece, reach: int) -> tuple[int, int]:
    """Character span of the window that takes in `reach` tokens on either side of the join."""
    i = len(left.lo) - reach
    a = int(left.lo[i]) if i > 0 else left.start
    b = int(right.hi[reach - 1]) if reach <= len(right.hi) else right.stop
    return max(a, left.start), min(b, right.stop)


def encode(path: str, texts: list[str], leaf: int = LEAF) -> list[np.ndarray]:
    """Token ids of each whole text, exactly as the library encodes it in one go."""
    tok = tokenizer(path)
    out: list = [None] * len(texts)
    short = [n for n, t in enumerate(texts) if len(t) <= leaf]
    for n, enc in zip(short, tok.encode_batch([texts[n] for n in short], add_special_tokens=False)):
        out[n] = np.array(enc.ids, np.int64)
    trees = {}
    for n, t in enumerate(texts):
        if len(t) > leaf:
            parts = 1 << (-(-len(t) // leaf) - 1).bit_length()
            cuts = [len(t) * i // parts for i in range(parts + 1)]
            trees[n] = list(zip(cuts, cuts[1:]))
    spans = [(n, a, b) for n, cuts in trees.items() for a, b in cuts]
    made = iter(_pieces(tok, texts, spans))
    rows = {n: [next(made) for _ in cuts] for n, cuts in trees.items()}
    while any(len(r) > 1 for r in rows.values()):
        rows = _level(tok, texts, rows)
    for n, r in rows.items():
        out[n] = r[0].ids
    return out


def _level(tok, texts: list[str], rows: dict[int, list[Piece]]) -> dict[int, list[Piece]]:
    """Join neighbours two by two in all texts; windows of all open joins are encoded in one call."""
    todo = {(n, i): REACH for n, r in rows.items() if len(r) > 1 for i in range(0, len(r), 2)}
    done = {}
    while todo:
        spans = [(n, *_window(rows[n][i], rows[n][i + 1], reach)) for (n, i), reach in todo.items()]
        again = {}
        for ((n, i), reach), window in zip(todo.items(), _pieces(tok, texts, spans)):
            whole = _joined(rows[n][i], rows[n][i + 1], window, (0, len(texts[n])))
            if whole is None:
                again[n, i] = reach * 4
            else:
                done[n, i] = whole
        todo = again
    return {n: [done[n, i] for i in range(0, len(r), 2)] if len(r) > 1 else r for n, r in rows.items()}


# Chunks whose normal form and words follow from these letters alone: no combining marks, no special tokens.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


# The rules of a tokenizer file that cutting at white space, PLAIN and WORD follow.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
    "decoder": None,
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
              "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


def check_rules(path: str) -> None:
    """Refuse a tokenizer file whose rules are not those that cutting at white space and `WORD` rely on."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    own = {k: rules.get(k) for k in RULES}
    own["model"] = {k: rules["model"].get(k) for k in RULES["model"]}
    marked = [t["content"] for t in rules["added_tokens"] if not t["content"].startswith("<|") or re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"]]
    if own != RULES or marked:
        raise ValueError(f"{path}: rules other than those this coder is written for: {own}")


@dataclass
class Part:
    """Chunk encodings of text[start:stop] and where each chunk starts; None stands for a torn end that is not encoded."""

    start: int
    stop: int
    at: list[int]
    units: list


def halved(size: int, part: int) -> list[tuple[int, int]]:
    """Spans of a text halved until none is over `part` characters, wherever that cuts."""
    n = 1 << (max(1, -(-size // part)) - 1).bit_length()
    cuts = [size * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def around(left: Part, right: Part, reach: int) -> tuple[int, int]:
    """Span of the window that takes in `reach` + 1 chunks on either side of the join."""
    i, j = len(left.at) - 1 - reach, reach + 1
    return left.at[i] if i > 0 else left.start, right.at[j] if j < len(right.at) else right.stop


def concatenated(left: Part, right: Part, window: Part) -> Part | None:
    """Both sides made one through the window, or None if it does not agree with both and must grow.

    A side and the window agree in a chunk of equal place and tokens that
    neither of them may have torn: not at the join, not at the window's ends.
    """
    inner = range(1, len(window.at) - 1)

    def met(side: Part, k: int, fit: range) -> int | None:
        x = bisect_left(side.at, window.at[k])
        same = x in fit and side.at[x] == window.at[k] and side.units[x] is not None and side.units[x] == window.units[k]
        return x if same else None

    u = (0, 0) if window.start <= left.start else next(
        ((x, k) for k in inner if (x := met(left, k, range(len(left.at) - 1))) is not None), None)
    t = (len(right.at), len(window.at)) if window.stop >= right.stop else next(
        ((x, k) for k in reversed(inner) if (x := met(right, k, range(1, len(right.at)))) is not None), None)
    if u is None or t is None or u[1] > t[1]:
        return None
    return Part(left.start, right.stop, left.at[:u[0]] + window.at[u[1]:t[1]] + right.at[t[0]:],
                left.units[:u[0]] + window.units[u[1]:t[1]] + right.units[t[0]:])


class Coder:
    """Encodes whole texts, remembering chunks: chunk -> (number of ids, ids as text, decoded text)."""

    def __init__(self, path: str, leaf: int = LEAF, part: int = PART):
        check_rules(path)
        self.path, self.leaf, self.part, self.known, self.words = path, leaf, part, {}, {}
        self.trees = 0  # texts that went through the tree
        self.model = tokenizer(path).model
        vocab = tokenizer(path).get_vocab(with_added_tokens=False)
        self.values = [""] * (max(vocab.values(), default=-1) + 1)
        for value, number in vocab.items():
            self.values[number] = value

    def word(self, word: str) -> tuple[int, str, str]:
        text = word if word.isascii() else "".join([LETTERS[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(text)]
        got = len(ids), " ".join(map(str, ids)), " ".join([self.values[i] for i in ids])
        if len(self.words) >= REMEMBERED:
            self.words = {}
        self.words[word] = got
        return got

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(chunks)
        hard, known, word, leaf, plain = [], self.known, self.word, self.leaf, PLAIN.fullmatch
        for c in new:
            got = self.words.get(c)  # most chunks are one lower-case word, often met before
            if got is not None:
                known[c] = got
            elif len(c) <= leaf and plain(c) and "<|" not in c:
                cut = WORD.findall(c.lower())
                if len(cut) == 1:
                    known[c] = self.words.get(cut[0]) or word(cut[0])
                else:
                    n, ids, values = zip(*[self.words.get(w) or word(w) for w in cut])
                    known[c] = sum(n), " ".join(ids), " ".join(values)
            else:
                hard.append(c)
        for i in range(0, len(hard), 4096):
            part = hard[i:i + 4096]
            ids = [x.tolist() for x in encode(self.path, part, self.leaf)]
            plain = tokenizer(self.path).decode_batch(ids, skip_special_tokens=False)
            self.known.update((c, (len(x), " ".join(map(str, x)), p)) for c, x, p in zip(part, ids, plain))

    def parts(self, texts: list[str], spans: list[tuple[int, int, int]], alone: bool = False) -> list[Part]:
        """Encode text[n][a:b] for every (n, a, b), each by itself; `alone`: a whole text meets no other part, so needs no places."""
        cut = [CHUNK.findall(texts[n], a, b) for n, a, b in spans]
        at = [[m.start() for m in CHUNK.finditer(texts[n], a, b)] if not alone or b - a < len(texts[n]) else [] for n, a, b in spans]
        for chunks, places, (n, a, b) in zip(cut, at, spans):
            # What a cut tore off an unsplit stretch is encoded again in any case: a long end waits until it is whole.
            if chunks and a > 0 and places[0] == a and len(chunks[0]) > self.leaf:
                chunks[0] = ""
            if chunks and b < len(texts[n]) and len(chunks[-1]) > self.leaf and places[-1] + len(chunks[-1]) == b:
                chunks[-1] = ""
        self.learn(set().union(*cut) - {""})
        known = self.known
        return [Part(a, b, places, [known[c] if c else None for c in chunks] if "" in (chunks[:1] + chunks[-1:]) else list(map(known.__getitem__, chunks)))
                for chunks, places, (_, a, b) in zip(cut, at, spans)]

    def tree(self, texts: list[str]) -> list[list]:
        """The chunk encodings of each whole text; texts over `part` characters are halved, and joined level by level."""
        halves = [halved(len(t), self.part) for t in texts]
        made = iter(self.parts(texts, [(n, a, b) for n, cuts in enumerate(halves) for a, b in cuts], alone=True))
        rows = [[next(made) for _ in cuts] for cuts in halves]
        self.trees += sum(len(r) > 1 for r in rows)
        while any(len(r) > 1 for r in rows):
            todo = {(n, i): REACH_CHUNKS for n, r in enumerate(rows) for i in range(0, len(r) - 1, 2)}
            done = {}
            while todo:
                spans = [(n, *around(rows[n][i], rows[n][i + 1], reach)) for (n, i), reach in todo.items()]
                again = {}
                for ((n, i), reach), window in zip(todo.items(), self.parts(texts, spans)):
                    whole = concatenated(rows[n][i], rows[n][i + 1], window)
                    if whole is None:
                        again[n, i] = reach * 4
                    else:
                        done[n, i] = whole
                todo = again
            rows = [[done[n, i] for i in range(0, len(r), 2)] if len(r) > 1 else r for n, r in enumerate(rows)]
        return [r[0].units for r in rows]

    def texts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by spaces, decoded text) of each text.

        Without a decoder of its own the tokenizer joins decoded tokens by a
        space, so the chunks' decoded texts joined by spaces are the whole's.
        """
        out = []
        for units in self.tree(texts):
            n, ids, plain = zip(*units) if units else ((), (), ())
            if 0 in n:  # a chunk of nothing but other white space has no tokens
                n, ids, plain = zip(*[e for e in units if e[0]], (0, "", ""))
                n, ids, plain = n[:-1], ids[:-1], plain[:-1]
            out.append((sum(n), " ".join(ids), " ".join(plain)))
        return out


def coder(path: str) -> Coder:
    """The worker's coder for a tokenizer file, kept between batches and tasks."""
    if ("coder", path) not in _LOADED:
        _LOADED["coder", path] = Coder(path)
    return _LOADED["coder", path]


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text; null counts as empty.

    ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over
    the decoded text's UTF-8. An empty text has no tokens. Extra columns are
    left out; repeated rows are encoded each. `path` must exist on every executor
    and hold the rules of `check_rules`, else the job fails.
    """
    rows = docs.select(common.column(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = rows.select("key").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    out = out.add("ids", ArrayType(IntegerType())) if with_ids else out

    def run(batches):
        for batch in batches:
            done = coder(path).texts(batch.column("text").to_pylist())
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            cols = [batch.column("key"), pa.array([n for n, _, _ in done], pa.int64()),
                    pa.array([sha(ids) for _, ids, _ in done], pa.string()), pa.array([sha(p) for _, _, p in done], pa.string())]
            if with_ids:
                cols.append(pa.array([[int(x) for x in ids.split()] for _, ids, _ in done], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, out.fieldNames())

    return rows.mapInArrow(run, out).withColumnRenamed("key", common.name(key))
