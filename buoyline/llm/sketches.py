"""Bottom-k sketches of word-shingle hashes.

A document's fingerprint holds the K smallest distinct 48-bit hashes of its
5-word shingles (A-Z lower-cased; words are cut at ASCII white space). Sketches
merge: the K smallest of two sketches are the sketch of the union. From two
sketches follow resemblance, containment and the number of distinct shingles.
As text a sketch is the hashes in ascending order, 8 base64url digits each.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from buoyline.llm import textops

K = 256
SHINGLE = 5
HASH_BITS = 48
_WORD, _FOLD = textops.non_space(), textops.lower_ascii()


def encode(hashes: np.ndarray) -> str:
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.urlsafe_b64encode(raw.tobytes()).decode()


def decode(text: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.urlsafe_b64decode(text or ""), np.uint8).reshape(-1, 6)
    return np.concatenate((np.zeros((len(raw), 2), np.uint8), raw), axis=1).view(">u8").ravel().astype(np.uint64)


def sketch_column(buf: np.ndarray, offs: np.ndarray, k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of every text of a bytes column, in blocks of bounded size."""
    out = []
    for i, j in textops.blocks(offs):
        part = buf[offs[i]:offs[j]]
        wh, woff, _ = textops.words(part, offs[i:j + 1] - offs[i], _WORD, _FOLD)
        h, soff, _ = textops.shingles(wh, woff, size)
        h = h >> np.uint64(64 - HASH_BITS)
        for a, b in zip(soff[:-1].tolist(), soff[1:].tolist()):
            out.append(np.unique(h[a:b])[:k])
    return out


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the k smallest hashes of the union that both hold; two empty sketches are alike (1)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k hashes."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**HASH_BITS / max(float(a[-1]), 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds too; 1 for an empty a."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:  # both complete: exact
        return float(np.isin(a, b).mean())
    union = np.union1d(a, b)[:k]
    return min(1.0, resemblance(a, b, k) * distinct(union, k) / max(distinct(a, k), 1.0))


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """Sketch of each whole text as a string; '' for null, empty and blank texts."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(s) for s in sketch_column(*textops.column_bytes(pa.array(texts, pa.string())), k, size)], dtype=object)

    return run(text)


def compare(a: Column, b: Column, k: int = K) -> Column:
    """struct(resemblance, containment of a in b, distinct in a, distinct in b) of two sketch columns."""

    @F.pandas_udf("resemblance double, containment double, distinct_a double, distinct_b double")
    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = [(decode(x), decode(y)) for x, y in zip(left, right)]
        return pd.DataFrame([(resemblance(x, y, k), containment(x, y, k), distinct(x, k), distinct(y, k)) for x, y in rows],
                            columns=["resemblance", "containment", "distinct_a", "distinct_b"])

    return run(a, b)


def merge(parts: DataFrame, by: str, sketch_col: str = "fingerprint", k: int = K, salts: int = 64) -> DataFrame:
    """(by, sketch, distinct): the sketch of the union of each group's sketches.

    Merged three times: in each task, over `salts` parts of each group, and over
    those; so a hot group costs no task more than its share.
    """

    def union(batches):
        kept: dict = {}
        for frame in batches:
            for key, text in zip(frame["by"], frame["sketch"]):
                key = None if pd.isna(key) else key
                kept[key] = np.union1d(kept.get(key, np.zeros(0, np.uint64)), decode(text))[:k]
            if len(kept) > 4096:  # many groups: hand on what is merged so far
                yield pd.DataFrame({"by": list(kept), "sketch": [encode(v) for v in kept.values()]})
                kept = {}
        yield pd.DataFrame({"by": pd.Series(list(kept), dtype=object), "sketch": pd.Series([encode(v) for v in kept.values()], dtype=object)})

    rows = parts.select(F.col(by).alias("by"), F.col(sketch_col).alias("sketch"))
    schema = rows.schema
    part = rows.mapInPandas(union, schema)
    salted = part.repartition(F.col("by"), F.pmod(F.xxhash64("sketch"), F.lit(salts))).mapInPandas(union, schema)

    def final(batches):
        for frame in union(batches):
            yield frame.assign(distinct=[distinct(decode(x), k) for x in frame["sketch"]])

    # Sorted within the task, so that a group's last parts arrive together and none is handed on twice.
    def one_row_each(batches):
        key, have, some = None, None, False
        for frame in batches:
            rows = []
            for x, text in zip(frame["by"], frame["sketch"]):
                x = None if pd.isna(x) else x
                if some and x != key:
                    rows.append((key, encode(have), distinct(have, k)))
                    some = False
                have = np.union1d(have, decode(text))[:k] if some else decode(text)
                key, some = x, True
            yield pd.DataFrame(rows, columns=["by", "sketch", "distinct"])
        if some:
            yield pd.DataFrame([(key, encode(have), distinct(have, k))], columns=["by", "sketch", "distinct"])

    last = salted.repartition("by").sortWithinPartitions("by").mapInPandas(
        one_row_each, schema.add("distinct", "double"))
    return last.withColumnRenamed("by", by)


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(bucket, guest, key, text), dealt and sorted so that a row's successor by key follows it in its task.

    Buckets are key ranges between quantiles; a quantile is a key of the table,
    so the first rows of the next bucket are known without a second pass and
    come along as guests (the smallest key's rows after the last bucket). Null
    keys come first; rows of one key follow by text.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cuts, least, nulls = rows.agg(
        F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10 * parts), F.min("key"), F.count_if(F.col("key").isNull())).first()
    cuts = sorted(set(cuts or []) - {least})
    if nulls and least is not None:
        cuts = [least, *cuts]
    step = max(1, int(len(cuts) ** 0.5))
    fine = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    if cuts:  # two short searches instead of one through all cuts
        arrays = F.array(*[F.array(*map(F.lit, x)) for x in fine])
        coarse = F.size(F.filter(F.array(*[F.lit(x[0]) for x in fine]), lambda c: c <= F.col("key")))
        inner = F.size(F.filter(F.get(arrays, coarse - 1), lambda c: c <= F.col("key")))
        bucket = F.when(F.col("key").isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + inner)
        edge = F.array_contains(F.get(arrays, coarse - 1), F.col("key"))
    else:
        bucket, edge = F.lit(0), F.lit(False)
    first = F.col("key").isNull() if nulls else F.col("key") == F.lit(least).cast("long")
    placed = rows.withColumn("bucket", bucket.cast("int")).withColumn("guests", F.array_compact(F.array(
        F.when(F.coalesce(edge, F.lit(False)), F.col("bucket") - 1), F.when(first, F.lit(len(cuts))))))
    spots = F.concat(F.array(F.struct("bucket", F.lit(0).alias("guest"))),
                     F.transform("guests", lambda b: F.struct(b.cast("int").alias("bucket"), F.lit(1).alias("guest"))))
    dealt = placed.select("key", "text", F.explode(spots).alias("at")).select("at.bucket", "at.guest", "key", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("key").asc_nulls_first(), "text")


def edited(text: str, following: str) -> str:
    """The text with its last quarter (in code points) replaced by the start of the following one."""
    m = len(text) // 4
    return text[:len(text) - m] + following[:m]


FINGERPRINTS = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, containment_edited double, distinct_shingles double"
)


def fingerprint_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and its likeness to both that and the next row.

    The next row is the one that follows by (key, text); the last is followed
    by the first, and a lone row by itself. Null texts count as empty. Extra
    columns are left out. An empty table gives an empty result.
    """

    def run(batches):
        held = None  # (bucket, key, text, sketch) of the row whose successor is still to come
        for batch in batches:
            buf, offs = textops.column_bytes(batch.column("text"))
            prints = sketch_column(buf, offs, k)
            texts = batch.column("text").to_pylist()
            pairs, due = [], held
            for now in zip(batch.column("bucket").to_pylist(), batch.column("guest").to_pylist(), batch.column("key").to_pylist(), texts, prints):
                if due is not None and due[0] == now[0]:
                    pairs.append((due, now))
                due = now if not now[1] else None
            held = due
            yield emit(pairs)

    def emit(pairs):
        changed = [edited(a[3], b[3]) for a, b in pairs]
        new = sketch_column(*textops.column_bytes(pa.array(changed, pa.string())), k)
        cols = [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
            pa.array([encode(a[4]) for a, _ in pairs], pa.string()),
            pa.array([encode(x) for x in new], pa.string()),
            pa.array([resemblance(a[4], x, k) for (a, _), x in zip(pairs, new)], pa.float64()),
            pa.array([resemblance(a[4], b[4], k) for a, b in pairs], pa.float64()),
            pa.array([containment(a[4], x, k) for (a, _), x in zip(pairs, new)], pa.float64()),
            pa.array([distinct(a[4], k) for a, _ in pairs], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["key", *[x.split()[0] for x in FINGERPRINTS.split(", ")]])

    return neighbours(docs, key, text).mapInArrow(run, f"key long, {FINGERPRINTS}").withColumnRenamed("key", key)
