"""Words of an Arrow text column as exact Arrow strings, in blocks of bounded bytes.

The bytes of many texts are looked at together with numpy; words come out as
one Arrow string array (no Python object per word, no hash in place of a word).
A text longer than a block is cut between words, so no text is expanded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD_BLOCK = 1 << 21  # bytes of text looked at in one go


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int = WORD_BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches put together to about `limit` bytes of text each."""
    held, size = [], 0
    for batch in batches:
        own = batch.column(text).nbytes
        if held and size + own > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.concat_batches(held)


@dataclass
class Block:
    """Rows first..last-1 (or a part of one row): the words of bytes a..b."""

    first: int
    last: int
    words: pa.StringArray  # folded
    row: np.ndarray  # each word's row
    start: np.ndarray  # each word's first byte in the column's buffer
    carried: int  # so many words were in the block before already
    ends: bool  # the last row ends here


def _word_end(buf: np.ndarray, at: int, stop: int, is_word: np.ndarray) -> int:
    """The first byte from `at` on, before `stop`, that is of no word (or `stop`)."""
    step = 4096
    while at < stop:
        outside = np.flatnonzero(~is_word[buf[at:min(at + step, stop)]])
        if len(outside):
            return at + int(outside[0])
        at, step = at + step, step * 2
    return stop


def _spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes and lengths of the words (none spans two rows), and the mask of word bytes."""
    inside = is_word[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offs[:-1][offs[:-1] < len(buf)]
    first[cuts] = inside[cuts]
    at = np.flatnonzero(inside)
    begin = np.flatnonzero(first[at])
    return at[begin], np.diff(np.append(begin, len(at))), inside


def blocks(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray, fold: np.ndarray, back: int = 0, limit: int = WORD_BLOCK) -> Iterator[Block]:
    """The words of rows buf[offs[i]:offs[i+1]], in blocks of about `limit` bytes.

    A longer row comes in several blocks, each of which begins with the last
    `back` words of the one before (`carried` tells how many).
    """
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        if j > i + 1 or offs[j] - offs[i] <= limit:
            yield _block(buf, offs, i, j, offs[i], offs[j], 0, True, is_word, fold)
        else:
            a, carried = int(offs[i]), 0
            while True:
                b = min(a + limit, int(offs[j]))
                if carried:
                    b = min(max(b, fresh + 1), int(offs[j]))
                b = _word_end(buf, b, int(offs[j]), is_word) if b < offs[j] else b
                out = _block(buf, offs, i, j, a, b, carried, b >= offs[j], is_word, fold)
                yield out
                if out.ends:
                    break
                carried = min(back, len(out.start))
                a, fresh = (int(out.start[-carried]) if carried else b), b
        i = j


def _block(buf, offs, i, j, a, b, carried, ends, is_word, fold) -> Block:
    part = buf[a:b]
    own = np.clip(offs[i:j + 1], a, b) - a
    start, length, inside = _spans(part, own, is_word)
    packed = fold[part[inside]]
    ends_at = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=ends_at[1:])
    words = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(ends_at), pa.py_buffer(packed))
    row = i + np.searchsorted(own[1:], start, "right")
    return Block(i, j, words, row, start + a, carried, ends)


def codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the distinct words by number."""
    got = words.dictionary_encode()
    return got.indices.to_numpy(zero_copy_only=False).astype(np.int64), got.dictionary


def renumbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers as numbers 0.. by first appearance: (number of each, place of each number's first one, counts)."""
    got = pa.array(keys).dictionary_encode()
    number = got.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(got.dictionary)
    first = np.zeros(size, np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return number, first, np.bincount(number, minlength=size)
