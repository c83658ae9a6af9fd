"""Approximate nearest neighbours by largest inner product, with vantage-point trees.

Vectors are dealt into shards of about ``SHARD_ROWS`` rows and each shard gets one tree.
A further coordinate lifts all vectors of a shard to equal length; there the largest
inner product is the smallest distance, and the triangle inequality holds. A tree node
keeps a vantage point and, for either half of its rows, the least and greatest distance
to it. A search leaves a half out if the query's distance to that interval, times
``FACTOR``, exceeds the distance of its k-th best row so far. Factor 1 leaves out only
what cannot matter, so the search is exact; a larger factor prunes more.

Every query meets every shard, in blocks of queries; each pair of a shard and a block
gives k rows per query, and the k best of all shards remain. The score is computed
from the original vectors in double precision, always summed in the same order.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
rows without an id, take no part; vectors of different lengths are never compared; rows
with the query's id are no candidates; a repeated row is a candidate of its own, and a
repeated query is searched once, by its smallest vector; equal scores go to the smaller
vec_id; an empty table gives no rows; extra columns, texts of any length among them, are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.tables import salted

SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
LEAF = 64
K = 20
FACTOR = 2.0
SEED = 4


class Tree:
    """Rows in leaf order and, per node, the vantage point and the two halves' distance intervals."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = SEED):
        norms = (x * x).sum(1)
        self.top = norms.max() if len(x) else 0.0
        self.x, self.lift = x, np.sqrt(np.maximum(self.top - norms, 0))
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(seed)
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            here = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][3 + side] = here
            if b - a <= leaf:
                self.nodes.append([a, b, None])
                continue
            own = self.order[a:b]
            point = own[rng.integers(len(own))]
            d = self._distances(x[point], self.lift[point], own)
            rank = np.argsort(d, kind="stable")  # halves by rank, so equal distances are split as well
            self.order[a:b] = own[rank]
            d, half = d[rank], (b - a) // 2
            self.nodes.append([a, b, (point, d[0], d[half - 1], d[half], d[-1]), -1, -1])
            todo += [(a + half, b, here, 1), (a, a + half, here, 0)]
        self.in_order = x[self.order]

    def _distances(self, q: np.ndarray, lift: float, rows: np.ndarray) -> np.ndarray:
        diff = self.x[rows] - q
        return np.sqrt((diff * diff).sum(1) + (self.lift[rows] - lift) ** 2)

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """For every query the scores and places of its k best rows, as far as found (place -1: none)."""
        n = len(q)
        best, place = np.full((n, k), -np.inf), np.full((n, k), -1)
        size = (q * q).sum(1)
        reach = np.full(n, np.inf)

        def distance(product: np.ndarray, who: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(size[who, None] + self.top - 2 * product, 0))

        def visit(node: int, who: np.ndarray, first: bool) -> None:
            a, b = self.nodes[node][:2]
            score = q[who] @ self.in_order[a:b].T
            if first:  # only a bound; the row is met again
                if score.shape[1] >= k:
                    kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                    reach[who] = np.where(np.isfinite(kth), distance(kth[:, None], who)[:, 0], np.inf)
                return
            every = np.concatenate([best[who], score], 1)
            at = np.concatenate([place[who], np.broadcast_to(np.arange(a, b), score.shape)], 1)
            top = np.argpartition(-every, k - 1, axis=1)[:, :k]
            best[who], place[who] = np.take_along_axis(every, top, 1), np.take_along_axis(at, top, 1)
            low = best[who].min(1)
            found = np.isfinite(low)
            reach[who[found]] = np.minimum(reach[who[found]], distance(low[found, None], who[found])[:, 0])

        for first in (True, False):  # down to the nearest leaf for a first bound, then the whole search
            todo = [(0, np.arange(n))] if len(self.x) else []
            while todo:
                node, who = todo.pop()
                if not len(who):
                    continue
                if self.nodes[node][2] is None:
                    visit(node, who, first)
                    continue
                (point, *bounds), left, right = self.nodes[node][2:5]
                d = distance((q[who] @ self.x[point])[:, None], who)[:, 0]
                gaps = [np.maximum(np.maximum(lo - d, d - hi), 0) for lo, hi in (bounds[:2], bounds[2:])]
                near_left = gaps[0] <= gaps[1]
                if first:
                    todo += [(left, who[near_left]), (right, who[~near_left])]
                else:  # rounding of a distance must not prune what lies on the border
                    slack = reach[who] * (1 + 1e-9) + 1e-7
                    todo += [(c, who[g * factor <= slack]) for c, g in ((right, gaps[1]), (left, gaps[0]))]
        return best, place


def _usable(v: Column) -> Column:
    # A NaN equals itself in Spark SQL and exceeds every number, so it needs its own test.
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _searcher(k: int, factor: float, leaf: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(_, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            rows = rows.sort_values("vec_id", kind="stable")
            queries = queries.sort_values("query_id", kind="stable")
            # Equal vectors are one row of the tree, which stands for their ids in rising order.
            x, group = np.unique(_matrix(rows.v), axis=0, return_inverse=True)
            ids = rows.vec_id.to_numpy()[np.argsort(group.ravel(), kind="stable")]
            ends = np.cumsum(np.bincount(group.ravel(), minlength=len(x)))
            starts = np.append(0, ends[:-1])
            tree = Tree(x, leaf)
            q_ids, q = queries.query_id.to_numpy(), _matrix(queries.v)
            for a in range(0, len(q), 256):
                # One more for the query's own row, some more for scores that rounding may turn round.
                _, place = tree.search(q[a:a + 256], min(k + 8, len(x)), factor)
                for i, places in enumerate(place, a):
                    at = tree.order[places[places >= 0]]
                    exact = (x[at] * q[i]).sum(1)
                    # k ids and the query's own are all that a row can give.
                    found = [ids[starts[j]:min(ends[j], starts[j] + k + 1)] for j in at]
                    score, own = np.repeat(exact, [len(f) for f in found]), np.concatenate([ids[:0], *found])
                    score, own = score[own != q_ids[i]], own[own != q_ids[i]]
                    top = np.lexsort((own, -score))[:k]
                    out["query_id"].append(np.full(len(top), q_ids[i]))
                    out["vec_id"].append(own[top])
                    out["score"].append(score[top])
        return pd.DataFrame({c: np.concatenate(p) if p else np.zeros(0, np.float64 if c == "score" else np.int64)
                             for c, p in out.items()})
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR,
            shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score for rows and queries of (vec_id, embedding)."""
    def clean(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        return df.where(_usable(v)).select(F.col("vec_id").cast("long"), v.alias("v"), F.size(v).alias("dim"))

    rows = clean(vectors)
    asked = clean(queries).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("s"))
    asked = asked.select(F.col("vec_id").alias("query_id"), "s.v", "s.dim")
    n, m = (dict(df.groupBy("dim").count().collect()) for df in (rows, asked))  # one row per vector length
    both = sorted(n.keys() & m.keys())

    def by_length(count: dict[int, int], part: int) -> Column:
        chosen = F.lit(None).cast("long")
        for dim in both:
            chosen = F.when(F.col("dim") == dim, F.lit(-(-count[dim] // part)).cast("long")).otherwise(chosen)
        return chosen

    shards, blocks = by_length(n, shard_rows), by_length(m, block_queries)

    def every(parts: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))

    # Rows that repeat more often than a part of a shard go on to the next shards.
    rows = (salted(rows.where(F.col("dim").isin(both)), ["vec_id", "v"], max(1, shard_rows // 4))
            .withColumn("shard", F.pmod(F.pmod(F.xxhash64("vec_id", "v"), shards) + F.col("salt"), shards))
            .withColumn("block", every(blocks)).drop("salt"))
    asked = (asked.where(F.col("dim").isin(both)).withColumn("block", F.pmod(F.xxhash64("query_id"), blocks))
             .withColumn("shard", every(shards)))
    keys = ("dim", "shard", "block")
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        _searcher(k, factor, leaf), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
