"""Vectorised word and shingle hashing over the texts of an Arrow column.

A column's UTF-8 bytes lie in one buffer, so words and shingles of many
documents are hashed at once with numpy, without a Python object per word.
Hashes are 64 bits wide and depend on the bytes alone (fixed seed).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TEXT_BLOCK = 1 << 22  # bytes of text expanded at a time; one longer document is a block of its own

SPACE = bytes([0x20, *range(0x09, 0x0E)])
_RNG = np.random.default_rng(20240101)
_TABLE = _RNG.integers(0, 1 << 63, 64 * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lower_ascii() -> np.ndarray:
    """Byte table that lower-cases A-Z and keeps every other byte."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def non_space() -> np.ndarray:
    """Byte table: True for bytes of words that ASCII white space separates."""
    t = np.ones(256, bool)
    t[list(SPACE)] = False
    return t


def alphanumeric() -> np.ndarray:
    """Byte table: True for ASCII letters and digits and for every non-ASCII byte."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        col, kind = col.fill_null("" if pa.types.is_string(col.type) else b""), np.int32
    else:
        col, kind = col.cast(pa.large_string()).fill_null(""), np.int64
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], kind, n + 1 + col.offset)[col.offset:].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8, offs[-1])[offs[0]:] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def blocks(offs: np.ndarray, limit: int = TEXT_BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most `limit` bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a sum of table entries over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, each document's word offsets, and each word's first byte."""
    inside = is_word[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offs[:-1][offs[:-1] < len(buf)]
    first[cuts] = inside[cuts]
    at = np.flatnonzero(inside)
    begin = np.flatnonzero(first[at])
    starts = at[begin]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), starts
    depth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    h = _TABLE[((depth & 63) << 8) | fold[buf[at]]]
    if depth.max() >= 64:
        h = h * (2 * (depth >> 6) + 1).astype(np.uint64)
    return mix(np.add.reduceat(h, begin)), np.searchsorted(starts, offs), starts


def shingles(wh: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run of k words, the documents' offsets, and each run's first word.

    A document of fewer than k words (but at least one) has one shingle: all its words.
    """
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    soff = np.concatenate(([0], np.cumsum(count)))
    first = np.arange(soff[-1]) - np.repeat(soff[:-1] - woff[:-1], count)
    acc = np.zeros(len(wh) + k, np.uint64)
    wide = np.concatenate((wh, np.zeros(k, np.uint64)))
    for j in range(k):
        acc[:len(wh)] += wide[j:j + len(wh)] * _MULT[j]
    h = acc[first]
    for d in np.flatnonzero((n < k) & (n > 0)):
        part = wh[woff[d]:woff[d + 1]]
        h[soff[d]] = np.sum(np.append(part, _MULT[-1]) * _MULT[[*range(len(part)), -len(part) - 1]], dtype=np.uint64)
    return mix(h), soff, first
