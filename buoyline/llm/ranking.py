"""Ranked lexical search of many items at once, sharing the work that items have in common.

A document's score for an item is a sum over the item's terms, so items that
share terms share partial sums. Sets of terms that several items hold are mined
first: every item is a sequence of its terms in one canonical order (most
shared first), and pairs of neighbours that stand in two items or more become a
node of their own, again and again, until no pair is shared. The nodes form a
graph: a term, the sum of two nodes, or an item's root. For a block of
documents every node is one row of partial accumulators, made once from its two
parts, level by level; an item's scores are its root's row.

Documents are read once per block of items: their counts of the items' terms
are written as a table, the corpus statistics come from it, and it is scored in
blocks of rows. A task passes on its best `top` documents per item; pairs of
documents and items are never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from buoyline.llm import textops, wordarrays
from buoyline.session import scratch_path

TOP = 50
ITEMS = 2048  # about so many items, and TERMS terms of them, are searched in one pass over the documents
TERMS = 1 << 18
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CELLS = 1 << 23  # accumulators (documents x nodes) of a block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: str | Column) -> Column:
    """The terms of a text, with repeats: runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(col.cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))


@dataclass
class Graph:
    """Nodes 0..terms-1 are terms; a later node is the sum of the nodes left and right of it. Levels: ranges of nodes that need only those before."""

    terms: int
    left: np.ndarray
    right: np.ndarray
    levels: list[tuple[int, int]]
    roots: np.ndarray  # each item's node
    shared: int  # nodes that several items use


def shared_graph(sets: list[list[int]], n: int) -> Graph:
    """The graph of the items' sets of terms 0..n-1 (none empty)."""
    use = Counter(t for s in sets for t in s)
    runs = [sorted(set(s), key=lambda t: (-use[t], t)) for s in sets]
    parts: dict[tuple[int, int], int] = {}
    while True:
        pairs = Counter(p for run in runs for p in zip(run, run[1:]))
        chosen = {p for p, c in pairs.items() if c > 1}
        if not chosen:
            break
        for k, run in enumerate(runs):
            out, i = [], 0
            while i < len(run):
                # Of two overlapping pairs the one that more items hold.
                p = tuple(run[i:i + 2])
                if p in chosen and not (tuple(run[i + 1:i + 3]) in chosen and pairs[tuple(run[i + 1:i + 3])] > pairs[p]):
                    out.append(parts.setdefault(p, n + len(parts)))
                    i += 2
                else:
                    out.append(run[i])
                    i += 1
            runs[k] = out
    shared = len(parts)
    while any(len(run) > 1 for run in runs):  # what is left of an item is summed in pairs
        runs = [[parts.setdefault((run[i], run[i + 1]), n + len(parts)) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)] for run in runs]
    depth = [0] * n
    for a, b in parts:
        depth.append(1 + max(depth[a], depth[b]))
    order = sorted(range(n, n + len(parts)), key=lambda v: (depth[v], v))
    place = np.arange(n + len(parts))
    place[order] = np.arange(n, n + len(parts))
    pair = list(parts)
    left, right = (np.array([place[pair[v - n][side]] for v in order], np.int64) for side in (0, 1))
    deep = np.array([depth[v] for v in order], np.int64)
    levels = [(int(at[0]) + n, int(at[-1]) + n + 1) for d in range(1, int(deep.max(initial=0)) + 1) for at in [np.flatnonzero(deep == d)]]
    return Graph(n, left, right, levels, np.array([place[run[0]] for run in runs], np.int64), shared)


def accumulators(graph: Graph, doc: np.ndarray, term: np.ndarray, part: np.ndarray, docs: int) -> np.ndarray:
    """(items, documents): the sums of each document's parts over each item's terms."""
    acc = np.zeros((graph.terms + len(graph.left), docs), np.int64)
    acc[term, doc] = part
    for a, b in graph.levels:
        np.add(acc[graph.left[a - graph.terms:b - graph.terms]], acc[graph.right[a - graph.terms:b - graph.terms]], out=acc[a:b])
    return acc[graph.roots]


def term_counts(docs: DataFrame, vocabulary: list[str], key: str, text: str) -> DataFrame:
    """(key, n, terms, tfs) of every document with a term: all its terms with repeats, and those of the vocabulary by number."""
    is_word, fold = textops.alphanumeric(), textops.lower_ascii()
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    schema = "key long, n long, terms array<int>, tfs array<int>"

    def run(batches):
        names = pa.array(known.value, pa.large_string())
        for batch in batches:
            buf, offs = textops.column_bytes(batch.column("text"))
            n, found, size = np.zeros(batch.num_rows, np.int64), [], len(names)
            for block in wordarrays.blocks(buf, offs, is_word, fold):
                n += np.bincount(block.row, minlength=batch.num_rows)
                at = pc.index_in(block.words, value_set=names)
                hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                found.append(np.unique(block.row[hit] * size + at.take(pa.array(hit)).to_numpy().astype(np.int64), return_counts=True))
            cells, which = np.unique(np.concatenate([c for c, _ in found] or [np.zeros(0, np.int64)]), return_inverse=True)
            tf = np.zeros(len(cells), np.int64)
            np.add.at(tf, which, np.concatenate([c for _, c in found] or [np.zeros(0, np.int64)]))
            some = np.flatnonzero(n)
            ends = pa.array(np.append(np.searchsorted(cells, some * size), len(cells)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (cells % max(size, 1), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(some)), pa.array(n[some]), *lists], ["key", "n", "terms", "tfs"])

    return rows.mapInArrow(run, schema)


def _best(item: np.ndarray, score: np.ndarray, none: np.ndarray, key: np.ndarray, top: int) -> np.ndarray:
    """Places of each item's best `top` rows: highest score, then a key before none, then the smaller key."""
    order = np.lexsort((key, none, -score, item))
    item = item[order]
    first = np.concatenate(([0], np.flatnonzero(item[1:] != item[:-1]) + 1)) if len(item) else np.zeros(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    return order[rank < top]


def scored(counts: DataFrame, graph: Graph, weights: np.ndarray, documents: int, words: int, top: int) -> DataFrame:
    """(item, key, score): of every task the best `top` rows of each item with a score above 0, ties to smaller keys."""
    sent = counts.sparkSession.sparkContext.broadcast((graph, weights))

    def run(batches):
        graph, weights = sent.value
        nodes = graph.terms + len(graph.left)
        at_once = max(1, CELLS // nodes)
        floor = np.ones(len(graph.roots), np.int64)  # what a score needs to be among the best so far
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                key, none = part.column("key").fill_null(0).to_numpy().astype(np.int64), part.column("key").is_null().to_numpy(zero_copy_only=False)
                n, lists = part.column("n").to_numpy(), part.column("terms")
                term, tf = lists.flatten().to_numpy(), part.column("tfs").flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                m = 50 + (50 * n * documents) // words
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                acc = accumulators(graph, doc, term, value, part.num_rows)
                least = floor
                if part.num_rows > top:
                    least = np.maximum(floor, np.partition(acc, part.num_rows - top, axis=1)[:, part.num_rows - top])
                item, d = np.nonzero(acc >= least[:, None])
                kept = [np.concatenate(x) for x in zip(kept, (item, acc[item, d], none[d], key[d]))]
                if len(kept[0]) > 4 * top * len(graph.roots):
                    kept = _cut(kept, floor, top)
        kept = _cut(kept, floor, top)
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), pa.array(kept[3], mask=kept[2]), pa.array(kept[1])], ["item", "key", "score"])

    return counts.mapInArrow(run, "item int, key long, score long")


def _cut(kept: list[np.ndarray], floor: np.ndarray, top: int) -> list[np.ndarray]:
    best = _best(kept[0], kept[1], kept[2], kept[3], top)
    kept = [x[best] for x in kept]
    full = np.bincount(kept[0], minlength=len(floor)) >= top
    last = np.full(len(floor), np.iinfo(np.int64).max)
    np.minimum.at(last, kept[0], kept[1])
    floor[full] = np.maximum(floor[full], last[full])
    return kept


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           items_at_once: int = ITEMS, terms_at_once: int = TERMS) -> DataFrame:
    """(item, rank, key, score): each item's `top` highest-scoring documents with a score above 0; equal scores by ascending key.

    Keys are whole numbers; a null key comes last among equal scores. Every row
    is a document of its own, repeated keys too; rows of one item id are one
    item of all their terms. Items without a term, or whose terms no document
    holds, have no row; nor has an empty table. Only the items and their terms'
    document counts pass the driver, about `items_at_once` items at a time.
    """
    spark = docs.sparkSession
    each = items.select(F.col(item).alias("item"), F.explode(terms(item_text)).alias("term")).groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    path = scratch_path(spark, "ranking-items")
    each.write.parquet(path)
    each = spark.read.parquet(path)
    count, size = each.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n = max(1, -(-count // items_at_once), -(-size // terms_at_once))
    found = None
    for k in range(n):
        block = each.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).toArrow().sort_by("item")
        part = _search_block(docs, block.column("item").combine_chunks(), block.column("terms").to_pylist(), top, key, text)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").cast(docs.schema[key].dataType).alias(key), "score")


def _search_block(docs: DataFrame, ids: pa.Array, sets: list[list[str]], top: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for s in sets for t in s})
    number = {t: i for i, t in enumerate(vocabulary)}
    path = scratch_path(spark, "ranking-counts")
    term_counts(docs, vocabulary, key, text).write.parquet(path)
    counts = spark.read.parquet(path)
    documents, words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow().to_pylist():
        df[row["term"]] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    graph = shared_graph([[number[t] for t in s] for s in sets], len(vocabulary))
    best = scored(counts, graph, weights, documents, words, top)
    names = spark.createDataFrame(pa.table({"at": pa.array(range(len(ids)), pa.int32()), "item": ids}))
    return best.join(F.broadcast(names), best["item"] == names["at"]).select(names["item"], "key", "score")
