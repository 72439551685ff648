"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A text's words are cut into windows of WINDOW words that overlap by WINDOW -
STRIDE. A word enters as two vectors: one of the word itself (hashed), and the
mean of those of its characters' trigrams (hashed), so that unseen spellings
share what their parts have learnt. A gated recurrent network reads a window in
both directions, attention weighs its positions, and a logistic layer gives the
window's probability. A text's score is its highest window's.

The network is trained with numpy on the driver, on a bounded sample of
labelled texts. Labels mark whole texts, so training needs a window of each: at
first the one with the word or trigram most typical of toxic texts in the
sample (which also gives the vectors' first component its start), then the one
that scores highest, which decides the text's score. As many other windows of
clean texts come along.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from buoyline.llm import common, textops, wordarrays

WINDOW = 32  # words
STRIDE = 24
HIDDEN = 12  # per direction
ATTENTION = 8
WIDTH = 8  # of a word's vector, and of a trigram's
WORD_ROWS = 1 << 16
CHAR_ROWS = 1 << 12
PER_CLASS = (4000, 1500)  # clean and toxic labelled texts in the training sample
MAX_CHARS = 4000  # texts longer than that do not train (all are scored whole)
BLOCK = 1 << 21  # bytes of text looked at in one go
CHUNK = 1024  # windows in one forward pass


@dataclass
class Network:
    words: np.ndarray  # WORD_ROWS x WIDTH
    chars: np.ndarray  # CHAR_ROWS x WIDTH
    forth: np.ndarray  # 2 WIDTH x 3 HIDDEN: update, reset, candidate
    forth_bias: np.ndarray
    forth_state: np.ndarray  # HIDDEN x 3 HIDDEN
    back: np.ndarray
    back_bias: np.ndarray
    back_state: np.ndarray
    look: np.ndarray  # 2 HIDDEN x ATTENTION
    look_bias: np.ndarray
    focus: np.ndarray  # ATTENTION
    out: np.ndarray  # 2 HIDDEN
    out_bias: np.ndarray


def fresh(seed: int = 11, dtype=np.float32) -> Network:
    rng = np.random.default_rng(seed)
    make = lambda scale, *shape: rng.normal(0, scale, shape).astype(dtype)
    h, w = HIDDEN, 2 * WIDTH
    return Network(
        make(0.1, WORD_ROWS, WIDTH), make(0.1, CHAR_ROWS, WIDTH), make(0.25, w, 3 * h), np.zeros(3 * h, dtype), make(0.25, h, 3 * h), make(0.25, w, 3 * h),
        np.zeros(3 * h, dtype), make(0.25, h, 3 * h), make(0.2, 2 * h, ATTENTION), np.zeros(ATTENTION, dtype), make(0.2, ATTENTION), make(0.2, 2 * h), np.zeros(1, dtype))


# --------------------------------------------------------------------------- words as inputs


@dataclass
class Inputs:
    """Distinct words: each one's row in `words`, and its trigrams' rows in `chars` (flat, with offsets)."""

    word: np.ndarray
    char: np.ndarray
    offs: np.ndarray


def inputs(names: pa.Array) -> Inputs:
    """Hashed words, and hashed trigrams of the words' bytes between two marks."""
    buf, offs = textops.column_bytes(names)
    marks, _, _ = textops.words(buf, offs, np.ones(256, bool), np.arange(256, dtype=np.uint8))
    n, count = len(names), np.diff(offs)
    # Each word's bytes with a 1 before and a 2 behind; as many trigrams as it has bytes.
    padded = np.empty(len(buf) + 2 * n, np.int64)
    at = np.arange(len(buf)) + 2 * np.repeat(np.arange(n), count) + 1
    padded[at] = buf
    padded[offs[:-1] + 2 * np.arange(n)] = 1
    padded[offs[1:] + 2 * np.arange(n) + 1] = 2
    tri = (padded[at - 1] * 7919 + padded[at] * 104729 + padded[at + 1] * 1299709).astype(np.uint64)
    return Inputs((marks >> np.uint64(20)).astype(np.int64) % WORD_ROWS, (textops.mix(tri) >> np.uint64(20)).astype(np.int64) % CHAR_ROWS, offs)


def vectors(net: Network, x: Inputs) -> np.ndarray:
    """Distinct words x 2 WIDTH."""
    if not len(x.word):
        return np.zeros((0, 2 * WIDTH), net.words.dtype)
    mean = np.add.reduceat(net.chars[x.char], x.offs[:-1]) / np.diff(x.offs)[:, None].astype(net.chars.dtype)
    return np.concatenate((net.words[x.word], mean), axis=1)


def windows(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, row) of the windows over words whose rows are given (ascending): each WINDOW places, -1 beyond the row's last word."""
    if not len(row):
        return np.zeros((0, WINDOW), np.int64), np.zeros(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(row[1:] != row[:-1]) + 1))
    n = np.diff(np.append(first, len(row)))
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    of = np.repeat(np.arange(len(first)), count)
    start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < n[of][:, None], first[of][:, None] + at, -1), row[first[of]]


# --------------------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(x: np.ndarray, mask: np.ndarray, state: np.ndarray, reverse: bool, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, windows, HIDDEN) of one direction; x: (time, windows, 3 HIDDEN) inputs."""
    steps, n, h = x.shape[0], x.shape[1], HIDDEN
    out = np.zeros((steps, n, h), x.dtype)
    now = np.zeros((n, h), x.dtype)
    for t in range(steps)[::-1] if reverse else range(steps):
        own = now @ state
        gates = _sigmoid(x[t, :, :2 * h] + own[:, :2 * h])
        z, r = gates[:, :h], gates[:, h:]
        c = np.tanh(x[t, :, 2 * h:] + r * own[:, 2 * h:])
        m = mask[t][:, None]
        new = now + m * (1 - z) * (c - now)
        if keep is not None:
            keep.append((t, now, own, z, r, c, m))
        out[t] = now = new
    return out


def _unread(grad: np.ndarray, kept: list, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of _read by its inputs and its state matrix."""
    h = HIDDEN
    dx = np.zeros((grad.shape[0], grad.shape[1], 3 * h), grad.dtype)
    dstate, carry = np.zeros_like(state), np.zeros(grad.shape[1:], grad.dtype)
    for t, now, own, z, r, c, m in reversed(kept):
        d = grad[t] + carry
        dc = d * m * (1 - z) * (1 - c * c)
        dz = d * m * (now - c) * z * (1 - z)
        dr = dc * own[:, 2 * h:] * r * (1 - r)
        dx[t] = np.concatenate((dz, dr, dc), axis=1)
        down = np.concatenate((dz, dr, dc * r), axis=1)
        dstate += now.T @ down
        carry = d * (1 - m * (1 - z)) + down @ state.T
    return dx, dstate


def forward(net: Network, vecs: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Probabilities of windows `at` (windows x WINDOW places among words given by vecs; -1: none)."""
    places, mask = np.maximum(at, 0).T, (at >= 0).T.astype(vecs.dtype)
    kept = ([], []) if keep is not None else (None, None)
    fx, bx = (np.concatenate((vecs @ w + b, np.zeros((0, w.shape[1]), vecs.dtype))) for w, b in ((net.forth, net.forth_bias), (net.back, net.back_bias)))
    states = np.concatenate((_read(fx[places], mask, net.forth_state, False, kept[0]), _read(bx[places], mask, net.back_state, True, kept[1])), axis=2)
    seen = np.tanh(states @ net.look + net.look_bias)
    weight = seen @ net.focus
    weight = np.where(mask > 0, weight, -1e30)
    weight = np.exp(weight - weight.max(0)) * mask
    weight /= np.maximum(weight.sum(0), 1e-30)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    p = _sigmoid(pooled @ net.out + net.out_bias[0])
    if keep is not None:
        keep.update(places=places, mask=mask, kept=kept, states=states, seen=seen, weight=weight, pooled=pooled, p=p, vecs=vecs)
    return p


def gradients(net: Network, x: Inputs, at: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of windows with labels y, and its gradients."""
    vecs, k = vectors(net, x), {}
    p = forward(net, vecs, at, k)
    loss = float(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
    d = ((p - y) / len(y)).astype(vecs.dtype)
    g = {"out": k["pooled"].T @ d, "out_bias": np.array([d.sum()], vecs.dtype)}
    dpool = d[:, None] * net.out
    dstates = k["weight"][:, :, None] * dpool
    dweight = np.einsum("tnh,nh->tn", k["states"], dpool)
    dscore = k["weight"] * (dweight - (k["weight"] * dweight).sum(0))
    g["focus"] = np.einsum("tna,tn->a", k["seen"], dscore)
    dseen = dscore[:, :, None] * net.focus * (1 - k["seen"] ** 2)
    g["look"], g["look_bias"] = np.einsum("tnh,tna->ha", k["states"], dseen), dseen.sum((0, 1))
    dstates = dstates + dseen @ net.look.T
    dvecs = np.zeros_like(vecs)
    for name, own, part in (("forth", k["kept"][0], dstates[:, :, :HIDDEN]), ("back", k["kept"][1], dstates[:, :, HIDDEN:])):
        dx, g[f"{name}_state"] = _unread(part, own, getattr(net, f"{name}_state"))
        dx *= k["mask"][:, :, None]
        per_word = np.zeros((len(vecs), dx.shape[2]), vecs.dtype)
        np.add.at(per_word, k["places"].ravel(), dx.reshape(-1, dx.shape[2]))
        g[name], g[f"{name}_bias"] = vecs.T @ per_word, per_word.sum(0)
        dvecs += per_word @ getattr(net, name).T
    g["words"], g["chars"] = np.zeros_like(net.words), np.zeros_like(net.chars)
    np.add.at(g["words"], x.word, dvecs[:, :WIDTH])
    count = np.diff(x.offs)
    np.add.at(g["chars"], x.char, np.repeat(dvecs[:, WIDTH:] / count[:, None].astype(vecs.dtype), count, axis=0))
    return loss, g


def some(x: Inputs, at: np.ndarray) -> tuple[Inputs, np.ndarray]:
    """Only the words that windows `at` hold."""
    used, place = np.unique(at, return_inverse=True)
    place = place.reshape(at.shape) - int(used[0] == -1)
    used = used[used >= 0]
    n = x.offs[used + 1] - x.offs[used]
    offs = np.concatenate(([0], np.cumsum(n)))
    take = np.arange(offs[-1]) + np.repeat(x.offs[used] - offs[:-1], n)
    return Inputs(x.word[used], x.char[take], offs), place


def _typical(text: np.ndarray, row: np.ndarray, labels: np.ndarray, rows: int) -> np.ndarray:
    """How typical each row is of toxic texts: the difference of its shares of texts in standard errors, a fourth of it, at most 3."""
    text, row = np.unique(np.stack((text, row)), axis=1)
    n = np.bincount(labels, minlength=2)
    seen = [np.bincount(row[labels[text] == c], minlength=rows) / max(n[c], 1) for c in (0, 1)]
    both = (seen[0] * n[0] + seen[1] * n[1]) / max(n.sum(), 1)
    error = np.sqrt(both * (1 - both) * (1 / max(n[0], 1) + 1 / max(n[1], 1)))
    return np.clip((seen[1] - seen[0]) / np.maximum(error, 1e-9) / 4, -3, 3).astype(np.float32)


def train(texts: pa.Array, labels: np.ndarray, epochs: int = 5, decay: float = 1e-3, seed: int = 11, rate: float = 0.01) -> Network:
    """Adam over the highest window of each text and as many clean ones. Deterministic for equal input."""
    buf, offs = textops.column_bytes(texts)
    parts = list(wordarrays.blocks(buf, offs, textops.alphanumeric(), textops.lower_ascii(), limit=1 << 62))
    codes, names = wordarrays.codes(parts[0].words)
    at, of = windows(parts[0].row)
    at = np.where(at >= 0, codes[np.maximum(at, 0)], -1)
    x, y, net, rng = inputs(names), labels[of].astype(np.float32), fresh(seed), np.random.default_rng(seed)
    params = [f.name for f in fields(net)]
    m, v = ({p: np.zeros_like(getattr(net, p)) for p in params} for _ in range(2))
    step = 0

    def epoch(chosen: np.ndarray) -> None:
        nonlocal step
        chosen = rng.permutation(chosen)
        for i in range(0, len(chosen), 128):
            idx = chosen[i:i + 128]
            own, places = some(x, at[idx])
            _, g = gradients(net, own, places, y[idx])
            step += 1
            for p in params:  # of the tables only the rows in use
                rows = np.unique({"words": own.word, "chars": own.char}[p]) if p in ("words", "chars") else slice(None)
                value, gp = getattr(net, p), g[p][rows]
                m[p][rows] += 0.1 * (gp - m[p][rows])
                v[p][rows] += 0.001 * (gp ** 2 - v[p][rows])
                value[rows] -= rate * ((m[p][rows] / (1 - 0.9**step)) / (np.sqrt(v[p][rows] / (1 - 0.999**step)) + 1e-8) + decay * value[rows])

    highest_by = lambda p: (lambda order: order[np.append(True, of[order][1:] != of[order][:-1])])(np.lexsort((-p, of)))
    pairs = np.unique(np.stack((np.repeat(of, (at >= 0).sum(1)), at[at >= 0])), axis=1)  # each text's distinct words
    count = x.offs[pairs[1] + 1] - x.offs[pairs[1]]
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - x.offs[pairs[1]], count)
    net.words[:, 0] += _typical(pairs[0], x.word[pairs[1]], labels, WORD_ROWS)
    net.chars[:, 0] += _typical(np.repeat(pairs[0], count), x.char[place], labels, CHAR_ROWS)
    clean = np.flatnonzero(y == 0)
    first = np.append(net.words[x.word, 0], -np.inf)[at].max(1)
    for k in range(epochs):
        highest = highest_by(first if k < 2 else _probabilities(net, vectors(net, x), at))
        epoch(np.concatenate((highest, rng.permutation(clean)[:len(highest)])))
    return net


def _probabilities(net: Network, vecs: np.ndarray, at: np.ndarray) -> np.ndarray:
    # The inputs' products are made once for all windows that hold a word.
    fx, bx = vecs @ net.forth + net.forth_bias, vecs @ net.back + net.back_bias
    return np.concatenate([_chunk(net, fx, bx, at[i:i + CHUNK]) for i in range(0, len(at), CHUNK)] or [np.zeros(0, vecs.dtype)])


def _chunk(net: Network, fx: np.ndarray, bx: np.ndarray, at: np.ndarray) -> np.ndarray:
    places, mask = np.maximum(at, 0).T, (at >= 0).T.astype(fx.dtype)
    states = np.concatenate((_read(fx[places], mask, net.forth_state, False), _read(bx[places], mask, net.back_state, True)), axis=2)
    weight = np.where(mask > 0, np.tanh(states @ net.look + net.look_bias) @ net.focus, -1e30)
    weight = np.exp(weight - weight.max(0)) * mask
    pooled = np.einsum("tn,tnh->nh", weight / weight.sum(0), states)
    return _sigmoid(pooled @ net.out + net.out_bias[0])


# --------------------------------------------------------------------------- on tables


def held_out(key: Column) -> Column:
    """Rows whose labels are not learnt: crc32 of the key as text divides by 5 (a null key counts as '')."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: tuple[int, int] = PER_CLASS,
        max_chars: int = MAX_CHARS) -> Network | None:
    """Train on labelled texts that are not held out; None if a class has none.

    The sample is bounded: of each class the first `per_class` keys by hash, one
    text of at most `max_chars` characters each. Keys that are null or labelled
    both ways take no part.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(
        F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    place = F.xxhash64("key")
    sample = [marked.where(F.col("label") == c).select("key", "label").orderBy(place, "key").limit(per_class[c]) for c in (0, 1)]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.length("text").between(1, max_chars)).join(F.broadcast(sample[0].unionByName(sample[1])), "key")  # at most sum(per_class) keys
    got = rows.groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy(place, "key").toArrow()
    y = got.column("label").to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return train(got.column("text").combine_chunks(), y)


def score(docs: DataFrame, net: Network | None, key: str | Column = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row: the highest probability of its text's windows.

    A null text or one without a word (letters, digits) scores 0, and every text
    does if there is no network. Repeated rows score alike. Extra columns are left out.
    """
    rows = docs.select(common.column(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = rows.select("key").schema.add("score", "double")
    is_word, fold = textops.alphanumeric(), textops.lower_ascii()

    def run(batches):
        for batch in batches:
            best = np.zeros(batch.num_rows)
            if net:
                buf, offs = textops.column_bytes(batch.column("text"))
                for block in wordarrays.blocks(buf, offs, is_word, fold, back=WINDOW - STRIDE, limit=BLOCK):
                    codes, names = wordarrays.codes(block.words)
                    at, row = windows(block.row)
                    at = np.where(at >= 0, codes[np.maximum(at, 0)], -1) if len(at) else at
                    np.maximum.at(best, row, _probabilities(net, vectors(net, inputs(names)), at))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.round(best, 6))], ["key", "score"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", common.name(key))
