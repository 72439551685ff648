"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: every node projects on the difference
of two sampled vectors of the node and splits at the median. Every row is then
routed to a leaf of every tree. A query walks all trees through one priority
queue, ordered by how far the query lies on the wrong side of the splits above
a node, until the leaves it has opened hold its budget of rows, which never
falls below what makes k candidates certain. The rows of opened leaves are its
candidates; they are reranked by the exact inner product in double precision.

Leaves are joined to the queries that opened them in bounded blocks: a leaf with
many rows (one vector may be very common) is dealt out by a hash of the row's
id, and the queries by a hash of theirs.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLE = 8192  # rows the trees are fitted on
TREES = 8
DEPTH = 5
SHARE = 1.5  # rows in opened leaves (a row counts once per tree), as a share of all rows
BLOCK_ROWS = 2048
BLOCK_QUERIES = 1024


@dataclass
class Forest:
    """normals: trees x nodes x dim, cuts: trees x nodes; node k's children are 2k+1 (below the cut) and 2k+2."""

    normals: np.ndarray
    cuts: np.ndarray
    depth: int

    def sides(self, x: np.ndarray) -> np.ndarray:
        """Signed distances rows x trees x nodes."""
        t, n, d = self.normals.shape
        return (x @ self.normals.reshape(t * n, d).T).reshape(len(x), t, n) - self.cuts

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf (0 .. 2^depth-1) of every row in every tree."""
        s = self.sides(x)
        at = np.zeros(s.shape[:2], np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (np.take_along_axis(s, at[:, :, None], 2)[:, :, 0] > 0)
        return at - (2**self.depth - 1)

    def search(self, sides: np.ndarray, sizes: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """Leaves of one query in the order in which the shared queue opens them, until they hold `budget` rows."""
        inner = 2**self.depth - 1
        queue = [(0.0, t, 0) for t in range(len(sides))]
        opened, held = [], 0
        while queue and held < budget:
            wrong, t, node = heapq.heappop(queue)
            if node >= inner:
                if sizes[t, node - inner]:
                    opened.append((t, node - inner))
                    held += sizes[t, node - inner]
                continue
            side = sides[t][node]
            heapq.heappush(queue, (max(wrong, side), t, 2 * node + 1))
            heapq.heappush(queue, (max(wrong, -side), t, 2 * node + 2))
        return opened


def fit(x: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    nodes, dim = 2**depth - 1, x.shape[1]
    normals, cuts = np.zeros((trees, nodes, dim)), np.zeros((trees, nodes))
    for t in range(trees):
        members = {0: np.arange(len(x))}
        for node in range(nodes):
            own = members.pop(node)
            a = rng.normal(size=dim)
            if len(own) > 1:
                i, j = rng.choice(own, 2, replace=False)
                if np.linalg.norm(x[i] - x[j]) > 1e-9:
                    a = x[i] - x[j]
            a = a / np.linalg.norm(a)
            p = x[own] @ a
            cut = float(np.median(p)) if len(own) else 0.0
            normals[t, node], cuts[t, node] = a, cut
            members[2 * node + 1], members[2 * node + 2] = own[p - cut <= 0], own[p - cut > 0]
    return Forest(normals, cuts, depth)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null or empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda c: c != 0)


def _matrix(col: pa.Array) -> np.ndarray:
    """A batch's list column as float64 rows (all of one length, no nulls)."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = TREES,
           depth: int = DEPTH, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, key, score): the k best candidates of every query row, best first, ties to the smaller key.

    All rows are candidates but those of the query's own key; with k or fewer
    of them, all are returned. Unusable vectors (see `usable`), those of
    another length than the sample's most frequent one, and null keys take no
    part. Repeated rows of one key and vector count once. No usable row gives
    an empty result. Extra columns are left out.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    got = rows.select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not got:
        return rows.sparkSession.createDataFrame([], empty).withColumnRenamed("vec_id", key)
    lengths = pd.Series([len(r[0]) for r in got]).value_counts()
    dim = int(lengths[lengths == lengths.max()].index.min())
    forest = fit(np.array([r[0] for r in got if len(r[0]) == dim]), trees, depth)
    rows = rows.where(F.size("vector") == dim)

    def route(batches):
        for b in batches:
            x = _matrix(b.column("vector"))
            leaves = forest.leaves(x) if len(x) else np.zeros((0, trees), np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), b.column("asks"), pa.array(leaves.tolist(), pa.list_(pa.int32()))],
                ["vec_id", "vector", "asks", "leaves"])

    routed = rows.mapInArrow(route, "vec_id long, vector binary, asks boolean, leaves array<int>").dropDuplicates(["vec_id", "vector", "asks"]).checkpoint()
    member = routed.select("vec_id", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    # trees * 2^depth counts, whatever the number of rows.
    counted = {(r[0], r[1]): r[2] for r in member.groupBy("tree", "leaf").count().collect()}
    sizes = np.zeros((trees, 2**depth), np.int64)
    for (t, leaf), n in counted.items():
        sizes[t, leaf] = n
    total = sizes[0].sum()
    asking = routed.where("asks")
    query_blocks = max(1, -(-asking.count() // BLOCK_QUERIES))
    splits = np.maximum(1, -(-sizes // BLOCK_ROWS))
    # Opened leaves of trees * (k + 1) rows hold k + 1 rows of some tree, so k candidates; a smaller table is opened whole.
    budget = max(share * total, trees * (k + 1))

    def open_leaves(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column("vector").to_pylist()), np.float64).reshape(-1, dim)
            ids, vecs = b.column("vec_id").to_pylist(), b.column("vector").to_pylist()
            spots = [forest.search(s, sizes, budget) for s in forest.sides(x)]
            flat = [(i, t, leaf, part) for i, s in enumerate(spots) for t, leaf in s for part in range(splits[t, leaf])]
            for a in range(0, len(flat), 4096):
                i, t, leaf, part = zip(*flat[a:a + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[n] for n in i], pa.int64()), pa.array([vecs[n] for n in i], pa.binary()), pa.array(t, pa.int32()), pa.array(leaf, pa.int32()), pa.array(part, pa.int32())],
                    ["query_id", "query", "tree", "leaf", "part"])

    spots = asking.select("vec_id", "vector").mapInArrow(open_leaves, "query_id long, query binary, tree int, leaf int, part int")
    spots = spots.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    parts = F.array(*[F.lit(int(n)) for n in splits.ravel()])
    member = member.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.get(parts, F.col("tree") * F.lit(2**depth) + F.col("leaf"))).cast("int"))
    member = member.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    names = ["tree", "leaf", "part", "block"]

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        m = np.frombuffer(b"".join(left["vector"]), np.float64).reshape(-1, dim)
        q = np.frombuffer(b"".join(right["query"]), np.float64).reshape(-1, dim)
        ids, asks = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        s = q @ m.T
        s[asks[:, None] == ids] = -np.inf
        top = min(k, len(ids))
        kth = np.partition(s, len(ids) - top, axis=1)[:, len(ids) - top]
        # Ties and what rounding may tell apart come along; the exact score decides.
        a, b = np.nonzero((s >= kth[:, None] - 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))[:, None]) & np.isfinite(s))
        exact = np.concatenate([np.zeros(0), *[(q[a[i:i + 65536]] * m[b[i:i + 65536]]).sum(1) for i in range(0, len(a), 65536)]])
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        keep = place < k
        return pd.DataFrame({"query_id": asks[a[keep]], "vec_id": ids[b[keep]], "score": exact[keep]})

    best = member.select("vec_id", "vector", *names).groupBy(*names).cogroup(spots.groupBy(*names)).applyInPandas(
        rerank, "query_id long, vec_id long, score double")
    # A pair met in several trees has one score, so its copies share a dense rank.
    ranked = best.withColumn("rank", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.distinct().select("query_id", "rank", F.col("vec_id").alias(key), "score")
