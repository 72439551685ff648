"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of WINDOW bytes that together cover
all of it. Each byte is embedded; filters of several widths slide over the
window, their outputs are max-pooled over positions, and a softmax layer gives
the language. A text's prediction sums the windows' log-probabilities, weighted
by the letters in each. The network is trained with numpy on the driver, on a
bounded sample of labelled rows, and applied to batches of windows in the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from buoyline.llm import common, textops

WINDOW = 160
WIDTHS = (2, 3, 4)
FILTERS = 10  # per width
EMBED = 6
PER_LANGUAGE = 1500  # labelled rows in the training sample, per language
MAX_LANGUAGES = 200  # bound on learned languages (the most frequent ones)
SNIPPETS = 3  # windows per sampled row
UNDETERMINED = "und"
CHUNK = 64  # windows in one forward pass, so that it stays in a core's cache


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # max(WIDTHS)*EMBED x len(WIDTHS)*FILTERS, narrower widths zero-padded
    bias: np.ndarray
    dense: np.ndarray  # len(WIDTHS)*FILTERS x languages
    offset: np.ndarray


def windows(buf: np.ndarray, offs: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows, document of each): every text cut into size-byte pieces, the last one padded with 0.

    Pieces overlap by the widest filter less one byte, so that every run of
    bytes a filter can see lies whole in some piece.
    """
    step = size - max(WIDTHS) + 1
    n = np.diff(offs)
    count = np.where(n > 0, np.maximum(1, -(-(n - size) // step) + 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offs[doc] + first * step
    at = start[:, None] + np.arange(size)
    out = buf[np.minimum(at, max(len(buf) - 1, 0))] if len(buf) else np.zeros((0, size), np.uint8)
    out[at >= offs[doc + 1][:, None]] = 0
    return out, doc


def _columns(net: Network, x: np.ndarray) -> np.ndarray:
    """im2col of embedded windows: for each position, the embeddings of it and the bytes that follow."""
    e = net.embedding[x]
    wide = max(WIDTHS)
    padded = np.concatenate((e, np.zeros((len(x), wide - 1, EMBED), np.float32)), axis=1)
    return np.concatenate([padded[:, i:i + x.shape[1]] for i in range(wide)], axis=2)


def forward(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probabilities, pooled activations, and the position of each maximum."""
    z = _columns(net, x).reshape(-1, net.filters.shape[0]) @ net.filters
    z = z.reshape(len(x), x.shape[1], -1)
    top = z.argmax(1)
    pooled = np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0] + net.bias, 0)
    scores = pooled @ net.dense + net.offset
    scores -= scores.max(1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(1, keepdims=True)), pooled, top


def log_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    z = _columns(net, x).reshape(-1, net.filters.shape[0]) @ net.filters
    pooled = np.maximum(z.reshape(len(x), x.shape[1], -1).max(1) + net.bias, 0)
    scores = pooled @ net.dense + net.offset
    scores -= scores.max(1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 4, seed: int = 7, rate: float = 0.01) -> Network:
    """Adam on the cross-entropy; deterministic for equal input."""
    rng = np.random.default_rng(seed)
    wide, maps = max(WIDTHS), len(WIDTHS) * FILTERS
    mask = np.concatenate([np.repeat((np.arange(wide * EMBED) < w * EMBED)[:, None], FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)
    net = Network(
        list(languages), rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        rng.normal(0, 0.2, (wide * EMBED, maps)).astype(np.float32) * mask, np.zeros(maps, np.float32),
        rng.normal(0, 0.2, (maps, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    net.embedding[0] = 0
    params = ["embedding", "filters", "bias", "dense", "offset"]
    m = {p: np.zeros_like(getattr(net, p)) for p in params}
    v = {p: np.zeros_like(getattr(net, p)) for p in params}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 128):
            idx = order[at:at + 128]
            xb, yb = x[idx], y[idx]
            logp, pooled, top = forward(net, xb)
            d = np.exp(logp)
            d[np.arange(len(idx)), yb] -= 1
            d = (d / len(idx)).astype(np.float32)
            g = {"dense": pooled.T @ d, "offset": d.sum(0)}
            dp = (d @ net.dense.T) * (pooled > 0)
            g["bias"] = dp.sum(0)
            # Only the position of each maximum takes part: gather its embedded bytes.
            pos = top[:, :, None] + np.arange(wide)
            inside = pos < xb.shape[1]
            seen = np.where(inside, xb[np.arange(len(idx))[:, None, None], np.minimum(pos, xb.shape[1] - 1)], 0)
            emb = net.embedding[seen] * inside[..., None]
            g["filters"] = np.einsum("nf,nfk->kf", dp, emb.reshape(len(idx), maps, -1)) * mask
            de = (dp[:, :, None] * net.filters.T[None]).reshape(len(idx), maps, wide, EMBED) * inside[..., None]
            ge = np.zeros_like(net.embedding)
            np.add.at(ge, seen.ravel(), de.reshape(-1, EMBED))
            ge[0] = 0
            g["embedding"] = ge
            step += 1
            for p in params:
                m[p] = 0.9 * m[p] + 0.1 * g[p]
                v[p] = 0.999 * v[p] + 0.001 * g[p] ** 2
                setattr(net, p, getattr(net, p) - rate * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.999**step)) + 1e-8))
    for p in params:
        setattr(net, p, getattr(net, p).astype(np.float32))
    return net


def held_out(key: Column) -> Column:
    """Rows kept from training: crc32 of the key as text leaves 2 modulo 4 (a null key counts as '')."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Network | None:
    """Train on rows that are not held out and have a label and a letter; None if there are none.

    The sample is bounded: of each language about `per_language` rows, chosen
    by a hash of the key and text, and SNIPPETS windows of each from hashed
    places. At most per_language * MAX_LANGUAGES rows reach the driver.
    """
    rows = docs.select(common.column(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    rows = rows.where(~held_out(F.col("key")) & F.col("label").isNotNull())
    counts = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_LANGUAGES).collect()
    if not counts:
        return None
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col("label") == row["label"], F.lit(min(1.0, per_language / row["count"]))).otherwise(share)
    at = lambda i: 1 + F.pmod(F.xxhash64("key", F.lit(i)), F.greatest(F.length("text") - WINDOW, F.lit(1)))
    dice = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    snippets = F.array(*[F.substring(F.col("text"), at(i).cast("int"), F.lit(WINDOW)) for i in range(SNIPPETS)])
    sample = rows.where((dice < share) & F.col("text").rlike(r"\p{L}")).select("label", F.xxhash64("key", "text").alias("place"), snippets.alias("snippets"))
    got = sorted(map(tuple, sample.limit(per_language * len(counts) + 4000).collect()), key=lambda r: (r[1], r[0], r[2]))
    languages = sorted({r[0] for r in got})
    if not got:
        return None
    number = {name: i for i, name in enumerate(languages)}
    parts = [(s.encode()[:WINDOW], number[r[0]]) for r in got for s in dict.fromkeys(r[2]) if any(c.isalpha() for c in s)]
    x = np.zeros((len(parts), WINDOW), np.uint8)
    for i, (s, _) in enumerate(parts):
        x[i, :len(s)] = np.frombuffer(s, np.uint8)
    return train(x, np.array([n for _, n in parts]), languages)


_LETTER = np.zeros(256, np.float32)  # what a byte counts: ASCII letters, and half of each byte of other characters
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:] = 0.5


def predict(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text", sure: bool = False) -> DataFrame:
    """(key, lang_pred, score) for every row, and with `sure` the mean of each window's highest probability, whatever its language.

    A null text, one without a letter, and every text if there is no network,
    are 'und' with score 0. The score is the predicted language's probability
    averaged over the windows, weighted by letters. Extra columns are left out.
    """
    rows = docs.select(common.column(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.select("key").schema.add("lang_pred", "string").add("score", "double")
    out = out.add("sure", "double") if sure else out

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            total = np.zeros((n, len(net.languages) if net else 1))
            chance, weight, top = total.copy(), np.zeros(n), np.zeros(n)
            if net:
                buf, offs = textops.column_bytes(batch.column("text"))
                for i, j in textops.blocks(offs):
                    x, doc = windows(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                    for k in range(0, len(x), CHUNK):
                        logp = log_probabilities(net, x[k:k + CHUNK])
                        letters = _LETTER[x[k:k + CHUNK]].sum(1)[:, None] + 1e-3
                        np.add.at(total, i + doc[k:k + CHUNK], logp * letters)
                        np.add.at(chance, i + doc[k:k + CHUNK], np.exp(logp) * letters)
                        np.add.at(top, i + doc[k:k + CHUNK], np.exp(logp).max(1) * letters[:, 0])
                        np.add.at(weight, i + doc[k:k + CHUNK], letters[:, 0])
            best = total.argmax(1)
            known = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            known = known & (weight > 0)
            lang = [net.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
            score = np.where(known, chance[np.arange(n), best] / np.maximum(weight, 1e-9), 0.0)
            cols = [batch.column("key"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))]
            if sure:
                cols.append(pa.array(np.clip(np.where(known, top / np.maximum(weight, 1e-9), 0.0), 0, 1)))
            yield pa.RecordBatch.from_arrays(cols, out.fieldNames())

    return rows.mapInArrow(run, out).withColumnRenamed("key", common.name(key))
