"""Phrase collocation mining by Toivonen's sampling method, per language.

A sample of stretches of all documents proposes phrases: those whose count in it
reaches a lowered threshold. One full pass then tallies these and their negative border,
the phrases that were not proposed though all their contiguous parts were, by
buckets (direct hashing and pruning): a phrase whose bucket of 2**32 stays below the
threshold is not frequent. A second pass counts the others by their words. If
border phrases may be frequent, longer phrases built on them were never
candidates: the same pass counts what they open, and all longer phrases
on top of that as though the opened ones were frequent, so it leaves none open.
Every count is exact, and no frequent phrase is missed whatever the sample held.

What decides in the tasks whether a phrase was proposed, or may be frequent, is a bitmap of
fixed size per phrase length (`bits`), so what is sent to the tasks does not grow with the corpus.
Two phrases may share a bit or a bucket: that makes more candidates, never fewer, and
their counts are exact too, by the words themselves. Tallies travel as sorted buckets,
each task's put together, a few bytes for a phrase. Scores are decimals of 38 digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from buoyline.llm import textops, wordarrays
from buoyline.session import scratch_path

LONGEST = 5  # words of a phrase
LEAST = 100  # occurrences of a candidate
TOP = 2000  # phrases of a language in the report
SAMPLE = 1 / 4  # of the stretches of text, by a hash of the document's key and text and the stretch's place
STRETCH = 128  # bytes of a stretch, so that a text full of one phrase is sampled in proportion, too
LOWERED = 0.3  # the sample's threshold, as a part of what a phrase of `least` occurrences leads one to expect there
BITS = 24  # each bitmap has 2**BITS bits, that of phrases to count twice as many
BUCKET = 32  # bits of a phrase's mark that it is tallied by
PART = 22  # bits of a bucket that one array of counters covers, 16 MB
HELD = 1 << 21  # buckets that a task puts together before it hands them on
_COUNT = 29  # bits of a count while buckets are put together; a task hands on before one could fill them
UNKNOWN = "und"
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_SPACE = b" \t"
_STEP = np.random.default_rng(20240612).integers(0, 1 << 63, LONGEST + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    is_word, is_cut = np.ones(256, bool), np.zeros(256, bool)
    is_word[list(_SPACE + SEPARATORS)] = False
    is_cut[list(SEPARATORS)] = True
    return is_word, is_cut


def prepared(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, text) and a hash of key and text to sample by; a null language is 'und'."""
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(key, text).alias("mark"))


@dataclass
class Proposed:
    """Bitmaps of phrases of 1, 2, ... words, packed."""

    maps: list[np.ndarray]

    def has(self, size: int, marks: np.ndarray) -> np.ndarray:
        bit = marks >> np.uint64(64 - self.bits)
        return (self.maps[size - 1][(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @property
    def bits(self) -> int:
        return (len(self.maps[0]) * 8 - 1).bit_length()

    def joined(self, other: Proposed) -> Proposed:
        return Proposed([a | b for a, b in zip(self.maps, other.maps)])

    def halved(self) -> Proposed:
        """The same phrases in bitmaps of half the size."""
        return Proposed([np.packbits(np.unpackbits(m, bitorder="little").reshape(-1, 2).any(1), bitorder="little") for m in self.maps])


def _empty(bits: int) -> Proposed:
    return Proposed([np.zeros(1 << (bits - 3), np.uint8) for _ in range(LONGEST)])


def _word_marks(words: pa.Array) -> np.ndarray:
    """64-bit marks of distinct words."""
    buf, offs = textops.column_bytes(words)
    every = np.ones(256, bool)
    marks = np.zeros(len(words), np.uint64)
    found, woff, _ = textops.words(buf, offs, every, np.arange(256, dtype=np.uint8))
    marks[np.diff(woff) > 0] = found
    return marks


def _phrase_marks(lang_marks: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Marks of phrases from their language's mark and their words' marks, in order."""
    total = lang_marks * _STEP[0]
    for i, w in enumerate(words):
        total = total + w * _STEP[i + 1]
    return textops.mix(total)


def _candidates(block, buf, langs, lang_marks, most, new, old, is_cut):
    """(size, first words, marks, counts, whether it was one under `old`) of the distinct candidates of a block, by size up to `most`.

    Of one word all words are; of k + 1 words those whose first k and last k
    were proposed in `new` (and so on down). Where `old` is given, a candidate that it
    did not have counts as proposed.
    """
    code, names = wordarrays.codes(block.words)
    if not len(code):
        return
    word_marks, lang = _word_marks(names), langs[block.row]
    a = int(block.start[0])
    piece = np.cumsum(is_cut[buf[a:int(block.start[-1]) + 1]])[block.start - a].astype(np.int64) + block.row
    at, number = np.arange(len(code)), lang * len(names) + code
    was = np.ones(len(code), bool)  # a candidate of the passes before
    for size in range(1, most + 1):
        number, first, _ = wordarrays.renumbered(number)
        spots, was = at[first], was[first]
        own = _phrase_marks(lang_marks[lang[spots]], [word_marks[code[spots + i]] for i in range(size)])
        n = np.bincount(number[at + size > block.carried], minlength=len(first))  # the others ended in the block before
        yield size, spots, own, n, was
        if size == most:
            return
        in_new = new.has(size, own)
        in_old = was
        if old is not None:
            in_new |= ~was
            in_old = was & old.has(size, own)
        in_new, in_old = in_new[number], in_old[number]
        # The next size: this phrase and the one a word on are both proposed, in one piece.
        place = np.full(len(code), -1)
        place[at[in_new]] = np.flatnonzero(in_new)
        follow = np.full(len(at), -1)
        follow[at + 1 < len(code)] = place[at[at + 1 < len(code)] + 1]
        keep = in_new & (follow >= 0) & (at + size < len(code))
        keep[keep] &= piece[at[keep]] == piece[at[keep] + size]
        left = np.flatnonzero(keep)
        if not len(left):
            return
        was = in_old[left] & in_old[follow[left]]
        at, number = at[left], number[left] * len(names) + code[at[left] + size]


def _blocks(batches):
    """(the bytes, each row's language, the languages, their marks, the blocks) of batches (lang, text)."""
    is_word, _ = _tables()
    fold = textops.lower_ascii()
    for batch in wordarrays.gathered(batches, "text"):
        buf, offs = textops.column_bytes(batch.column("text"))
        coded = batch.column("lang").dictionary_encode()
        langs, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        yield buf, langs, names, _word_marks(names), wordarrays.blocks(buf, offs, is_word, fold, back=LONGEST - 1)


def _put_together(held: list[np.ndarray]) -> np.ndarray:
    """Sorted (size, bucket, count) in one integer each, every bucket once."""
    every = np.sort(np.concatenate(held))
    key = every >> np.uint64(_COUNT)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return (key[first] << np.uint64(_COUNT)) + np.add.reduceat(every & np.uint64((1 << _COUNT) - 1), first)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: all lowest bytes, then all next ones, which compresses."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: memoryview | bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _handed_on(entries: np.ndarray) -> pa.RecordBatch:
    """(part, at, n): the buckets of each size and range of 2**PART buckets, as bytes."""
    bucket, n = entries >> np.uint64(_COUNT), entries & np.uint64((1 << _COUNT) - 1)
    part, low = bucket >> np.uint64(PART), bucket & np.uint64((1 << PART) - 1)
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    spans = list(zip(cuts[:-1], cuts[1:]))
    return pa.RecordBatch.from_arrays([
        pa.array(part[cuts[:-1]].astype(np.int32)), pa.array([_planes(low[i:j]) for i, j in spans], pa.binary()), pa.array([_planes(n[i:j]) for i, j in spans], pa.binary()),
    ], ["part", "at", "n"])


def _words_found(found: list) -> pa.RecordBatch:
    size, first, words = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(first, pa.int64()), pa.array(words, pa.binary())], ["size", "first", "words"])


def tallied(rows: DataFrame, sizes: set[int], new: Proposed, least: int, bits: int) -> Proposed:
    """Bitmaps of 2**bits bits of the candidate phrases of `sizes` words whose bucket holds `least` or more in all rows (lang, text)."""
    _, is_cut = _tables()
    sent = rows.sparkSession.sparkContext.broadcast(new)

    def tally(batches):
        new, held, size_of, seen = sent.value, [], 0, 0
        for buf, langs, _, lang_marks, blocks in _blocks(batches):
            for block in blocks:
                for size, _, own, n, _ in _candidates(block, buf, langs, lang_marks, max(sizes), new, None, is_cut):
                    if size in sizes:
                        some = n > 0
                        key = np.uint64(size << BUCKET) + (own[some] >> np.uint64(64 - BUCKET))
                        held.append((key << np.uint64(_COUNT)) + n[some].astype(np.uint64))
                        size_of, seen = size_of + len(key), seen + int(n.sum())
                full = seen >> (_COUNT - 1)
                if size_of > HELD or full:
                    held = [_put_together(held)]
                    size_of = len(held[0])
                    if size_of > HELD // 2 or full:
                        yield _handed_on(held[0])
                        held, size_of, seen = [], 0, 0
        if size_of:
            yield _handed_on(_put_together(held))

    def reached(spots, part):
        """(size, place of the first, words): the 64-bit words of the size's bitmap that hold these buckets of a part."""
        low = (part & ((1 << (BUCKET - PART)) - 1)) << PART
        bit = (np.sort(np.concatenate(spots)).astype(np.int64) + low) >> (BUCKET - bits)
        first = int(bit[0]) >> 6
        words = np.zeros((int(bit[-1]) >> 6) - first + 1, np.uint64)
        np.bitwise_or.at(words, (bit >> 6) - first, np.uint64(1) << (bit & 63).astype(np.uint64))
        return part >> (BUCKET - PART), first, words.tobytes()

    def add(batches):
        counts = np.zeros(1 << PART, np.min_scalar_type(least))  # each up to `least`
        own, spots = None, []
        for batch in batches:
            found = []
            for part, at, n in zip(batch.column("part").to_pylist(), batch.column("at"), batch.column("n")):
                if part != own:
                    if spots:
                        found.append(reached(spots, own))
                    counts[:] = 0
                    own, spots = part, []
                at = _numbers(at.as_buffer())
                before = counts[at]
                now = np.minimum(np.minimum(_numbers(n.as_buffer()), least).astype(np.uint64) + before, least)
                counts[at] = now
                new = at[(now == least) & (before < least)]
                if len(new):
                    spots.append(new)
            yield _words_found(found)
        if spots:
            yield _words_found([reached(spots, own)])

    parts = rows.select("lang", "text").mapInArrow(tally, "part int, at binary, n binary")
    found = parts.repartition("part").sortWithinPartitions("part").mapInArrow(add, "size int, first long, words binary").toArrow()
    out = _empty(bits)
    for size, first, words in zip(found.column("size").to_pylist(), found.column("first").to_pylist(), found.column("words").to_pylist()):
        some = np.frombuffer(words, np.uint64)
        out.maps[size - 1].view(np.uint64)[first:first + len(some)] |= some
    return out


def count(rows: DataFrame, new: Proposed, old: Proposed, some: Proposed) -> DataFrame:
    """(lang, phrase, size, n): exact counts in all rows (lang, text), with each language's words as size 0, phrase null.

    Counted are the candidates under `old` that `some` holds, and all that are only candidates under `new`.
    """
    _, is_cut = _tables()
    sent = rows.sparkSession.sparkContext.broadcast((new, old, some))
    schema = "lang string, phrase string, size int, n long"

    def run(batches):
        new, old, some = sent.value
        for buf, langs, names, lang_marks, blocks in _blocks(batches):
            totals = np.zeros(len(names), np.int64)
            for block in blocks:
                totals += np.bincount(langs[block.row[block.carried:]], minlength=len(names))
                for size, spots, own, n, was in _candidates(block, buf, langs, lang_marks, LONGEST, new, old, is_cut):
                    mine = np.flatnonzero((n > 0) & (~was | some.has(size, own)))
                    spots = spots[mine]
                    parts = [block.words.take(pa.array(spots + i)) for i in range(size)]
                    phrase = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(langs[block.row[spots]])), phrase.cast(pa.string()), pa.array(np.full(len(mine), size, np.int32)), pa.array(n[mine].astype(np.int64))],
                        ["lang", "phrase", "size", "n"])
            if len(names):
                yield pa.RecordBatch.from_arrays(
                    [names, pa.nulls(len(names), pa.string()), pa.array(np.zeros(len(names), np.int32)), pa.array(totals)], ["lang", "phrase", "size", "n"])

    found = rows.select("lang", "text").mapInArrow(run, schema)
    return found.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.sum("n").alias("n"))


def sampled(rows: DataFrame, share: float) -> DataFrame:
    """(lang, text): stretches of about STRETCH bytes of every text (lang, text, mark), cut between words; a line break marks a gap."""
    is_word, _ = _tables()

    def run(batches):
        for batch in batches:
            buf, offs = textops.column_bytes(batch.column("text"))
            mark = batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)
            outside = np.append(np.flatnonzero(~is_word[buf]), len(buf))
            texts = []
            for i in range(len(offs) - 1):
                a, b = int(offs[i]), int(offs[i + 1])
                cuts = outside[np.searchsorted(outside, np.arange(a + STRETCH, b, STRETCH))]
                begin = np.unique(np.concatenate(([a], cuts[cuts < b]))) if b > a else np.zeros(0, np.int64)
                dice = textops.mix(mark[i] + (begin - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
                keep = dice < np.uint64(int(share * (1 << 20)))
                part = buf[a:b].copy()
                gaps = begin[1:][keep[1:] & ~keep[:-1]]  # each begins with a byte of no word
                part[gaps - a] = 10
                texts.append(part[np.repeat(keep, np.diff(np.append(begin, b)))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(texts, pa.binary()).cast(pa.string())], ["lang", "text"])

    return rows.mapInArrow(run, "lang string, text string")


def frequent(docs: DataFrame, least: int = LEAST, share: float = SAMPLE, bits: int = BITS, key: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """(lang, phrase, size, n) of every phrase of 1 to LONGEST words with n >= least, and each language's words as size 0, phrase null.

    A null text has no word. Repeated rows count as often as they stand there.
    """
    spark = docs.sparkSession
    rows = prepared(docs, key, text, lang)
    path = scratch_path(spark, "phrases-sample")
    sampled(rows, share).write.parquet(path)
    sample, proposed, some = spark.read.parquet(path), _empty(bits), max(1, int(LOWERED * share * least))
    for size in range(1, LONGEST):
        proposed = proposed.joined(tallied(sample, {size}, proposed, some, bits))
    reach = tallied(rows, set(range(1, LONGEST + 1)), proposed, least, bits + 1)
    path = scratch_path(spark, "phrases")
    count(rows, proposed.joined(reach.halved()), proposed, reach).where((F.col("n") >= least) | (F.col("size") == 0)).write.parquet(path)
    return spark.read.parquet(path)


def _words(phrase: Column, first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def collocations(found: DataFrame, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from the frequent phrases of `frequent`: the best `top` of each language (None: all).

    Of every cut of a phrase in two, the lowest score counts, ties to the
    shorter first part. A phrase inside a longer one that occurs as often is
    left out. Ties of the rank: higher a, then the phrase's bytes.
    """
    f = found.where("size > 0").select("lang", "phrase", "size", "n")
    totals = found.where("size = 0").select("lang", F.col("n").alias("words"))
    longer = f.where("size > 1")
    inner = longer.where("size > 2").select("lang", "n", F.explode(F.array(
        _words(F.col("phrase"), 1, F.col("size") - 1), _words(F.col("phrase"), 2, F.col("size") - 1))).alias("phrase"))
    cuts = longer.select("lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.col("phrase"), 1, F.col("k")).alias("left"),
                       _words(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda name, n: f.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(words as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    best = scored.groupBy("lang", "phrase", "a", F.col("words").alias("n")).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    kept = best.join(inner.select("lang", "phrase", F.col("n").alias("a")), ["lang", "phrase", "a"], "left_anti")
    out = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, top: int | None = TOP, **more) -> DataFrame:
    """The collocations of documents (key, text, lang); see `frequent` and `collocations`. An empty table gives none."""
    return collocations(frequent(docs, least, **more), top)
