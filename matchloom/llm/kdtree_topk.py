"""Exact top-k inner products with KD-trees per shard.

Vectors become whole numbers, floor(64 x). Rows are dealt to shards of bounded
size, and each shard builds a tree: median splits on the widest dimension, and
the tight bounding box of every node. A query walks a tree best first, by the
largest inner product that a box allows, and stops when no box can reach the
k-th best score it knows. That score is propagated: a block of queries first
searches one shard, and takes its k-th scores along to all other shards.

The queries (rows whose id is divisible by ``EVERY``) are packed in blocks, and
each block meets each shard's tree once: the tree goes to one task (to a few,
while there are fewer trees than tasks), and the blocks come to it there. Results are exact: scores are computed
in doubles where these are exact, else in whole numbers of any size, and ties
go to the smaller id. Scores beyond 64 bits are stated as the nearest 64-bit value.

Nulls: rows with a null id or vector, or with a null or non-finite component,
take no part. Vectors meet vectors of their own length only; empty ones score
0. Rows that repeat an id are rows of their own, and only a row itself is left
out of its candidates. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, saved

EVERY, TOP = 20, 20
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 8192, 128, 512


def whole(rows: list) -> np.ndarray:
    """floor(64 x) of every component: doubles if they are small enough for exact products, else whole numbers."""
    x = np.floor(64.0 * np.array(rows, np.float64).reshape(len(rows), -1))
    top = float(np.abs(x).max()) if x.size else 0.0
    if top * top * max(x.shape[1], 1) < 2**52:
        return x
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


class Tree:
    """Nodes of a KD-tree over the rows of a matrix, and the rows in the order of its leaves."""

    def __init__(self, rows: np.ndarray | None, parts: tuple = ()):
        if parts:
            self.low, self.high, self.span, self.child = parts
            return
        self.order = np.arange(len(rows))
        low, high, self.span, self.child = [], [], [], []
        open_ = [(0, len(rows), -1)]
        while open_:
            a, b, above = open_.pop()
            own = rows[self.order[a:b]]
            node = len(self.span)
            if above >= 0:
                self.child[above].append(node)
            low.append(own.min(0))
            high.append(own.max(0))
            self.span.append((a, b))
            self.child.append([])
            if b - a <= LEAF_ROWS or not own.shape[1]:
                continue
            axis = int(np.argmax(high[-1] - low[-1]))
            if high[-1][axis] == low[-1][axis]:
                continue  # equal rows: one leaf, one box without extent
            mid = (b - a) // 2
            column = own[:, axis]
            cut = np.argsort(column, kind="stable") if column.dtype == object else np.argpartition(column, mid)
            self.order[a:b] = self.order[a:b][cut]
            open_ += [(a, a + mid, node), (a + mid, b, node)]
        self.low, self.high = np.array(low), np.array(high)

    def parts(self) -> tuple:
        return self.low, self.high, self.span, self.child

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each node's box."""
        up, down = np.where(queries > 0, queries, 0), np.where(queries > 0, 0, queries)
        return up @ self.high.T + down @ self.low.T


def search(tree: Tree, rows: np.ndarray, ids: np.ndarray, uids: np.ndarray, q: np.ndarray, own: int, bounds: np.ndarray, known, k: int):
    """The candidates of one query that may be among its k best, best first, given that it knows k scores of ``known`` or more."""
    heap = [(-bounds[0], 0)]
    least = known
    best = np.zeros(0, rows.dtype)
    at = np.zeros(0, np.int64)
    while heap:
        bound, node = heapq.heappop(heap)
        if least is not None and -bound < least:
            break
        if tree.child[node]:
            for c in tree.child[node]:
                if least is None or bounds[c] >= least:
                    heapq.heappush(heap, (-bounds[c], c))
            continue
        a, b = tree.span[node]
        score = rows[a:b] @ q
        keep = uids[a:b] != own
        if least is not None:
            keep &= (score >= least).astype(bool)
        if not keep.any():
            continue
        best = np.concatenate((best, score[keep]))
        at = np.concatenate((at, np.flatnonzero(keep) + a))
        if len(best) >= k:
            kth = np.sort(best)[-k] if best.dtype == object else np.partition(best, len(best) - k)[len(best) - k]
            least = kth if least is None else max(least, kth)
            stay = (best >= least).astype(bool)
            best, at = best[stay], at[stay]
    order = sorted(range(len(best)), key=lambda i: (-best[i], ids[at[i]], uids[at[i]]))[:k]
    return [(int(best[i]), int(ids[at[i]]), int(uids[at[i]])) for i in order]


def build(part: pa.Table) -> pa.Table:
    """A shard's rows to its tree, packed."""
    rows = whole(part["embedding"].to_pylist())
    tree = Tree(rows)
    packed = pickle.dumps((tree.parts(), rows[tree.order], part["vec_id"].to_numpy()[tree.order], part["uid"].to_numpy()[tree.order]))
    return pa.table({"dim": part["dim"][:1], "shard": part["shard"][:1], "tree": pa.array([packed], pa.binary())})


def pack(part: pa.Table) -> pa.Table:
    """A block of queries, packed, with the k-th scores they know (none yet)."""
    packed = pickle.dumps((whole(part["embedding"].to_pylist()), part["vec_id"].to_numpy(), part["uid"].to_numpy()))
    return pa.table({"dim": part["dim"][:1], "block": part["block"][:1], "queries": pa.array([packed], pa.binary())})


SCHEMA = "block long, quid long, query_id long, score decimal(38,0), vec_id long, uid long"


def walker(k: int):
    """A function for mapInArrow from (block, queries, known, tree) to candidates."""

    def walk(batches):
        for part in batches:
            for r in part.to_pylist():
                queries, qids, quids = pickle.loads(r["queries"])
                parts, rows, ids, uids = pickle.loads(r["tree"])
                tree = Tree(None, parts)
                known = {x["quid"]: int(x["least"]) for x in r["known"] or []}
                if queries.dtype != rows.dtype:
                    queries, rows = queries.astype(object), rows.astype(object)
                    tree.low, tree.high = tree.low.astype(object), tree.high.astype(object)
                bounds = tree.bounds(queries)
                out = []
                for i in range(len(queries)):
                    own = int(quids[i])
                    for score, v, u in search(tree, rows, ids, uids, queries[i], own, bounds[i], known.get(own), k):
                        out.append((r["block"], own, int(qids[i]), score, v, u))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64()]
                clip = lambda s: max(min(s, 10**37), -(10**37))
                columns[3] = [clip(s) for s in columns[3]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "quid", "query_id", "score", "vec_id", "uid"]
                )

    return walk


def top_products(vectors: DataFrame, every: int = EVERY, k: int = TOP, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of every query's ``k`` largest inner products."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = saved(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("dim", F.size("embedding"))
    )
    asked = F.col("vec_id") % every == 0
    n = rows.agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).first()
    shards, blocks = max(1, math.ceil(n["n"] / shard_rows)), max(1, math.ceil(n["q"] / block_rows))
    dealt = lambda parts: F.pmod(F.xxhash64("uid"), F.lit(parts))
    trees = saved(
        rows.withColumn("shard", dealt(shards)).groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, tree binary")
    )
    packs = saved(
        rows.where(asked).withColumn("block", dealt(blocks)).groupBy("dim", "block").applyInArrow(pack, "dim int, block long, queries binary")
    )
    # A block starts in one shard that there is for its length; the k-th scores found there go along to the others.
    homes = trees.select("dim", "shard").join(packs.select("dim", "block"), "dim").withColumn("far", F.pmod(F.col("shard") - F.col("block"), F.lit(shards)))
    pairs = homes.withColumn("turn", F.row_number().over(Window.partitionBy("dim", "block").orderBy("far"))).select("dim", "block", "shard", "turn")
    none = F.lit(None).cast("array<struct<quid:bigint,least:decimal(38,0)>>")
    # A tree is far larger than a block, so blocks travel to trees. Few trees are copied, so that every task has one.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = min(blocks, math.ceil(2 * tasks / shards))
    copied = trees.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def met(some: DataFrame) -> DataFrame:
        asking = some.join(packs, ["dim", "block"]).withColumn("copy", F.pmod("block", F.lit(copies)).cast("int"))
        one = asking.join(copied.hint("merge"), ["dim", "shard", "copy"])
        return mapped(one.select("block", "queries", "known", "tree"), walker(k), SCHEMA)

    first = saved(met(pairs.where("turn = 1").withColumn("known", none)))
    kth = (
        first.groupBy("block", "quid").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        .groupBy("block").agg(F.collect_list(F.struct("quid", "least")).alias("known"))  # a block's queries at most
    )
    rest = met(pairs.where("turn > 1").join(kth, "block", "left"))
    order = Window.partitionBy("quid").orderBy(F.col("score").desc(), "vec_id", "uid")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    edge = F.lit(2**63 - 1).cast("decimal(38,0)")
    score = F.greatest(F.least("score", edge), -edge).cast("long")
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
