"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a sample (by a hash of vec_id) of at most SAMPLE vectors and
SAMPLE_BYTES; every vector is then put into the leaf it descends to. Leaves are as small
as keeps about LEAF_VECTORS vectors of the table in each (and LEAST_LEAF of the sample), so
their number grows with the table. A query keeps a priority queue of nodes by distance to
their centre: the nearest is taken, its children are added, and leaves are visited in the
order they come up. How many leaves a query visits is widened until queries from the
sample find at least TARGET of their true neighbours; a query whose leaves hold fewer than
k others goes on until they do not.

Leaves are cut into parts and a leaf's queries into groups, both of at most BLOCK_BYTES of
vectors, so a task holds one part and one group whatever the size of a leaf; a query's best
k of each part are then merged. A vector goes to the groups of its own leaf only, of which
there is one as long as few queries visit it. Distances are exact, in double precision;
where squares leave the range of doubles, differences are scaled first.

Defined cases: vectors that are null, zero, of another length than most of the sample, or
hold null or non-finite components take no part, neither as queries nor as candidates;
ties go to the smaller vec_id; rows that share a vec_id are candidates of their own, but
a query never finds its own vec_id, and of several vectors of one query the smallest (by
components, in order) asks; rows with a null vec_id take no part; components of any finite
size are compared; an empty table has no result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE, SAMPLE_BYTES = 50_000, 32 << 20
BRANCHES = 8
#: Vectors of the table that a leaf has on average, and of the sample at least.
LEAF_VECTORS, LEAST_LEAF = 512, 16
TARGET = 0.95
CALIBRATION = 300
BLOCK_BYTES = 8 << 20
ROUNDS = 12
#: Scaled components are kept within this, so that their squares are finite.
_FAR = 1e100


@dataclass
class Node:
    """centres: of the children, one row each."""

    leaf: int = -1
    centres: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Which of at most k clusters each row is in; k-means++ start, Lloyd rounds."""
    centres = [x[rng.integers(len(x))]]
    nearest = ((x - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = nearest.sum()
        if total <= 0:
            break
        centres.append(x[rng.choice(len(x), p=nearest / total)])
        nearest = np.minimum(nearest, ((x - centres[-1]) ** 2).sum(1))
    c, own = np.array(centres), np.zeros(len(x), np.int64)
    for _ in range(ROUNDS):
        own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return own


@dataclass
class Tree:
    """scale: a power of two by which vectors are divided, so that the sample's components are about 1 at most."""

    root: Node
    n_leaves: int
    visits: int = 1
    scale: float = 1.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(x / self.scale, -_FAR, _FAR)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row (of scaled vectors)."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not node.children:
                out[rows] = node.leaf
            elif len(rows):
                c = node.centres
                own = ((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)
                todo += [(n, rows[own == j]) for j, n in enumerate(node.children)]
        return out

    def best_bins(self, q: np.ndarray, visits: int, counts: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves that a best-bin-first search of q (scaled) visits; more, while the leaves hold fewer than `least` by counts."""
        queue, pushed, out, held = [(0.0, 0, self.root)], 1, [], 0
        while queue and (len(out) < visits or held < least):
            _, _, node = heapq.heappop(queue)
            if not node.children:
                out.append(node.leaf)
                held += int(counts[node.leaf]) if counts is not None else least
                continue
            for d, child in zip(((node.centres - q) ** 2).sum(1).tolist(), node.children, strict=True):
                heapq.heappush(queue, (d, pushed, child))
                pushed += 1
        return out


def fit_tree(x: np.ndarray, k: int, n_vectors: int | None = None) -> Tree:
    """x: the sample of n_vectors. Chooses the number of visits from queries of the sample."""
    rng = np.random.default_rng(17)
    largest = float(np.abs(x).max())
    tree = Tree(Node(), 0, scale=float(2.0 ** np.clip(np.floor(np.log2(largest)), -1022, 1023)))
    x = tree.scaled(x)
    leaves, size = 0, max(LEAST_LEAF, -(-len(x) * LEAF_VECTORS // max(n_vectors or len(x), 1)))

    def grow(rows: np.ndarray) -> Node:
        nonlocal leaves
        if len(rows) >= 2 * size:
            own = _kmeans(x[rows], min(BRANCHES, len(rows) // size), rng)
            groups = [rows[own == j] for j in np.unique(own)]
            if len(groups) > 1:
                return Node(-1, np.array([x[g].mean(0) for g in groups]), [grow(g) for g in groups])
        leaves += 1
        return Node(leaves - 1)

    tree.root = grow(np.arange(len(x)))
    tree.n_leaves = leaves
    leaf = tree.descend(x)
    found = np.zeros(leaves, np.int64)
    squares = (x**2).sum(1)
    for i in rng.choice(len(x), min(CALIBRATION, len(x)), replace=False):
        d = squares - 2 * x @ x[i]
        d[i] = np.inf
        n = min(k, len(x) - 1)
        near = np.argpartition(d, n)[:n] if n else np.zeros(0, np.int64)
        order = np.empty(leaves, np.int64)
        order[tree.best_bins(x[i], leaves)] = np.arange(leaves)
        np.add.at(found, order[leaf[near]], 1)
    share = np.cumsum(found) / max(1, found.sum())
    tree.visits = int(np.searchsorted(share, TARGET - 1e-12)) + 1 if found.sum() else leaves
    tree.visits = min(tree.visits, leaves)
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x to q, also where squares are too large or too small for doubles."""
    with np.errstate(over="ignore"):
        apart = x - q
        out = np.sqrt((apart**2).sum(1))
    odd = ~np.isfinite(out) | (out < 1e-140)
    if odd.any():
        most = np.abs(apart[odd]).max(axis=1)
        safe = np.where((most > 0) & np.isfinite(most), most, 1.0)
        with np.errstate(invalid="ignore"):
            out[odd] = np.where(np.isfinite(most), most * np.sqrt(((apart[odd] / safe[:, None]) ** 2).sum(1)), np.inf)
    return out


@dataclass
class Index:
    """vectors: vec_id, vector, leaf. counts: vectors of each leaf."""

    tree: Tree
    vectors: DataFrame
    counts: np.ndarray
    width: int

    @property
    def block(self) -> int:
        """Vectors that a task holds of either side."""
        return max(64, BLOCK_BYTES // (8 * self.width))


def build_index(vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> Index | None:
    """None if no vector takes part."""
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.where(fine)
    by_hash = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector")
    sizes = [r.n for r in by_hash.limit(1_000).select(F.size("vector").alias("n")).collect()]
    if not sizes:
        return None
    width = min(((-n, w) for w, n in Counter(sizes).items()))[1]
    rows = rows.where(F.size("vector") == width)
    n_vectors = rows.count()
    by_hash = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector")
    sample = by_hash.limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))).select("vector").toArrow().column(0).combine_chunks()
    tree = fit_tree(_matrix(sample), k, n_vectors)
    held = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        for batch in batches:
            if batch.num_rows:
                leaf = tree.descend(tree.scaled(_matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf.astype(np.int32))], ["vec_id", "vector", "leaf"])

    placed = stored(rows.mapInArrow(place, "vec_id long, vector array<double>, leaf int"), "vectors")
    held.destroy()
    counts = np.zeros(tree.n_leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # at most a row for each leaf
        counts[r["leaf"]] = r["n"]
    return Index(tree, placed, counts, width)


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """queries: vec_id, vector. query_id, rank, vec_id, score."""
    spark = queries.sparkSession
    held = spark.sparkContext.broadcast((index.tree, index.counts))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            # one more than k, for the query's own vector may be in one of the leaves
            wanted = [tree.best_bins(q, tree.visits, counts, k + 1) for q in tree.scaled(_matrix(batch.column(1)))]
            take = pa.array(np.repeat(np.arange(len(wanted)), [len(w) for w in wanted]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(wanted).astype(np.int32))], ["query_id", "vector", "leaf"])

    routed = queries.select(F.col("vec_id").alias("query_id"), "vector").mapInArrow(route, "query_id long, vector array<double>, leaf int")
    asked = {r["leaf"]: r["n"] for r in routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row for each leaf
    cuts = [(leaf, int(-(-index.counts[leaf] // index.block)), -(-n // index.block)) for leaf, n in sorted(asked.items()) if index.counts[leaf]]
    dealt = F.broadcast(spark.createDataFrame(cuts, "leaf int, parts int, groups int"))
    part, group = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = index.vectors.join(dealt, "leaf").select("leaf", part.alias("part"), every("groups").alias("batch"), "vec_id", "vector")
    asking = routed.join(dealt, "leaf").select("leaf", every("parts").alias("part"), group.alias("batch"), "query_id", "vector")

    def nearest(there: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if there.num_rows and asked.num_rows:
            ids = there.column("vec_id").to_numpy()
            x = _matrix(there.column("vector").combine_chunks())
            q_ids = asked.column("query_id").to_numpy()
            q = _matrix(asked.column("vector").combine_chunks())
            # rough distances of scaled vectors
            _, power = np.frexp(max(np.abs(x).max(), np.abs(q).max()))
            small, small_q = np.ldexp(x, -power), np.ldexp(q, -power)
            squares = (small**2).sum(1)
            step = max(1, (8 << 20) // len(x))
            for lo in range(0, len(q), step):
                rough = squares - 2 * small_q[lo : lo + step] @ small.T
                for i, row in enumerate(rough):
                    other = ids != q_ids[lo + i]
                    row[~other] = np.inf
                    n = min(k, int(other.sum()))
                    if n:
                        # rounding of the rough distances is far below this slack; the exact ones decide
                        slack = 1e-9 * (squares.max() + (small_q[lo + i] ** 2).sum())
                        near = np.flatnonzero((row <= np.partition(row, n - 1)[n - 1] + slack) & other)
                        d = _distances(x[near], q[lo + i])
                        best = np.lexsort((ids[near], d))[:n]
                        out.append((np.full(n, q_ids[lo + i]), ids[near][best], d[best]))
        a, b, c = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    keys = ("leaf", "part", "batch")
    found = there.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # each task keeps a query's k best before the shuffle (a group limit below the window)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int, k: int = 10) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by `every`, among all other rows."""
    index = build_index(vectors, k)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return search(index, queries, k)
