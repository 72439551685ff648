"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints
that differ in at most 3 bits, one segment differs in at most 1 bit. Every
segment is therefore indexed under its 32 one-wildcard variants (one bit
masked out): two segments share a variant exactly if they differ in at most
that one bit. Equal variants are gathered by an equality shuffle, and each
candidate pair is verified on all 64 bits.

A variant shared by many fingerprints is dealt out by blocks: its members get
a hashed block number, and every pair of blocks is one bounded task-side group,
so nothing is capped and no group grows with the data. Groups return the edges
of a star for each of their components, never all pairs.

Both sides of every join here grow with the data, and Spark sizes the variants
as if there were one per fingerprint, the fingerprints by their compressed
files: the joins are merge joins whatever it reckons, so no side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from buoyline.llm import common, connected, textops

BITS = 64
SEGMENT = 32
BLOCK = 1024  # members of one variant that are compared in one group (two blocks at a time)


def _fingerprint(text: bytes, size: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], 42) for s, e in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):  # a long document's bits are unpacked in pieces
        part = h[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): the SimHash of every whole text as a signed 64-bit number.

    Words are runs of anything but ASCII white space, with A-Z lower-cased;
    a bit is 1 if set in over half the shingle hashes, repeats included.
    A text of fewer words than `size` is one shingle; null, empty and blank
    texts get 0.
    """
    rows = docs.select(common.column(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = StructType([StructField("key", rows.schema["key"].dataType), StructField("fp", LongType())])

    def run(batches):
        for batch in batches:
            buf, offs = textops.column_bytes(batch.column("text"))
            data = buf.tobytes()
            fps = [_fingerprint(data[a:b], size) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            fp = pa.array(np.array(fps, np.uint64).astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), fp], ["key", "fp"])

    return rows.mapInArrow(run, out).withColumnRenamed("key", common.name(key))


def variants(fps: DataFrame) -> DataFrame:
    """(variant, fp): the 64 one-wildcard segment variants of each fingerprint.

    A variant packs the segment's number, the masked bit and the remaining bits.
    """
    ones = (1 << SEGMENT) - 1
    segments = (F.col("fp").bitwiseAND(F.lit(ones)), F.shiftrightunsigned("fp", SEGMENT))
    keys = [
        seg.bitwiseAND(F.lit(ones ^ (1 << bit))).bitwiseOR(F.lit((number * SEGMENT + bit) << SEGMENT))
        for number, seg in enumerate(segments) for bit in range(SEGMENT)
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("variant"))


def _stars(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges from each member to the first of its component, links being `distance` bits or fewer."""
    rest, edges = fps, []
    while len(rest) > 1:
        root, front, rest = int(rest[0]), [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= distance
            if near.any():
                found = rest[near]
                edges += [(root, x) for x in found.tolist()]
                front += list(found)
                rest = rest[~near]
    return edges


def _link_sorted(distance: int):
    """mapInArrow body over rows sorted by (variant, one, two): the verified star edges of each group."""

    def emit(edges):
        a, b = (np.array(x, np.uint64).astype(np.int64) for x in (zip(*edges) if edges else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            n = len(cols[0])
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            cuts = np.flatnonzero(new)
            held = [c[cuts[-1]:] for c in cols]  # the last group may go on in the next batch
            yield emit(groups(cols[3].astype(np.uint64), cuts))
        if held is not None:
            yield emit(_stars(np.unique(held[3].astype(np.uint64)), distance))

    def groups(fp, cuts):
        """Edges of all groups but the last; cuts: where each group begins."""
        size = np.diff(cuts)
        two = cuts[:-1][size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        edges = list(zip(fp[near].tolist(), fp[near + 1].tolist()))
        for i in np.flatnonzero(size > 2):
            edges += _stars(np.unique(fp[cuts[i]:cuts[i + 1]]), distance)
        return list(set(edges))

    return run


def links(fps: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between distinct fingerprints that connect exactly those within `distance` bits.

    `distance` is at most 3, for which two segments guarantee one with at most
    one differing bit. `fps` holds distinct fingerprints in column `fp`.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard find distances of 3 bits or fewer")
    index = variants(fps)
    crowds = (
        index.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1")
        .select("variant", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    members = index.join(crowds.hint("merge"), "variant").select("variant", "fp", "blocks", own.alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = members.select("variant", "fp", "own", other.alias("other")).select(
        "variant", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "fp")
    dealt = paired.repartition("variant", "one", "two").sortWithinPartitions("variant", "one", "two")
    return dealt.mapInArrow(_link_sorted(distance), "a long, b long").distinct()


def components(docs: DataFrame, size: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for every row of `docs`.

    component_id is the smallest key reachable over links of `distance` bits or
    fewer, the row's own included. Rows of equal fingerprints are linked, so
    blank and null texts (fingerprint 0) form one group with whatever lies near
    0. A null key takes part in the links but is never the smallest unless all
    keys of the component are null. Repeated rows come out as often as they
    come in. An empty table gives an empty result.
    """
    prints = fingerprints(docs, size, text, key).checkpoint()
    nodes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    stars = connected.components(links(nodes.select("fp"), distance))
    rooted = nodes.join(stars.hint("merge"), nodes["fp"] == stars["node"], "left").select(
        nodes["fp"], "least", F.coalesce("root", nodes["fp"]).alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest.hint("merge"), "root").select("fp", "component_id")
    return prints.join(named.hint("merge"), "fp").select(key, "fp", "component_id")


def fingerprint_hex(fp):
    """16 lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
