"""Nearest neighbours by a permutation index.

A vector is represented by the pivots nearest to it, in order. In each block of the table a vector is posted in the
inverted files of its pivots, with the pivot's place in its order. A query walks the files of its own pivots; with a
pivot missing from an order counted as at the place after the last, the footrule distance of two orders is a constant
less twice the sum of (LENGTH - the larger place) over the pivots that they share, which the walk adds up. The vectors
of the smallest footrule are reranked by inner product in double precision on the original vectors.

Blocks are dealt by row, so that equal vectors and crowded pivots spread; each pair of a block of vectors and a block of
queries is a task of bounded size, which returns its best for each query.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounds, materialize, narrow, runs

#: Pivots, of how many vectors at most they are drawn, and how many of them represent a vector.
PIVOTS, SAMPLE, LENGTH = 256, 20_000, 64
#: Vectors and queries of a block.
BLOCK, QUERIES = 16_384, 2048
#: Share of a block that is reranked, and its least number; all whose footrule is at most CLOSE of the largest are, too.
RERANKED, LEAST, CLOSE = 0.1, 400, 0.15


def pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Distinct vectors far apart: chosen one by one from a bounded sample, each the farthest of a few from those before."""
    n = vectors.count()
    rows = (vectors.sample(0.97 * SAMPLE / n, seed=7) if n > SAMPLE else vectors).select("vector").collect()  # SAMPLE vectors at most, but for a chance below 1e-5
    if not rows:
        return np.zeros((0, 0))
    width = Counter(len(r[0]) for r in rows).most_common(1)[0][0]
    found = np.array([r[0] for r in rows if len(r[0]) == width], dtype=np.float64)
    found = np.unique(found, axis=0)
    unit = found / np.linalg.norm(found, axis=1, keepdims=True)
    rng = np.random.default_rng(7)
    chosen = [int(rng.integers(len(unit)))]
    nearest = unit @ unit[chosen[0]]
    while len(chosen) < min(count, len(unit)):
        few = rng.integers(len(unit), size=4)
        best = int(few[np.argmin(nearest[few])])
        if nearest[best] >= 1 - 1e-9:
            best = int(np.argmin(nearest))
            if nearest[best] >= 1 - 1e-9:
                break
        chosen.append(best)
        nearest = np.maximum(nearest, unit @ unit[best])
    return unit[chosen]


def orders(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Of each vector the LENGTH nearest pivots, nearest first."""
    near = x @ pivot.T
    n = min(LENGTH, near.shape[1])
    some = np.argpartition(-near, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


class InvertedFiles:
    """For each pivot the rows posted in it and their places in those rows' orders."""

    def __init__(self, order: np.ndarray, count: int):
        self.rows, self.length = len(order), order.shape[1]
        by_pivot = np.argsort(order.ravel(), kind="stable")
        ends = np.searchsorted(order.ravel()[by_pivot], np.arange(count + 1))
        self.files = [((by_pivot[a:b] // self.length), (by_pivot[a:b] % self.length).astype(np.int16)) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def footrules(self, order: np.ndarray) -> np.ndarray:
        """Footrule distances of these orders (by row) from each row's. One walk over each file serves all orders that have its pivot."""
        shared = np.zeros((len(order), self.rows), dtype=np.int16)
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[by_pivot], np.arange(len(self.files) + 1))
        for (rows, places), a, b in zip(self.files, ends[:-1], ends[1:], strict=True):
            asking, own = by_pivot[a:b] // self.length, (by_pivot[a:b] % self.length).astype(np.int16)
            if len(asking) and len(rows):
                shared[np.ix_(asking, rows)] += self.length - np.maximum(own[:, None], places[None, :])
        return self.length * (self.length + 1) - 2 * shared.astype(np.int32)


def _each(query_ids: np.ndarray, queries: np.ndarray, order: np.ndarray, index: InvertedFiles, at_once: int = 256):
    for lo in range(0, len(queries), at_once):
        yield from zip(query_ids[lo : lo + at_once].tolist(), queries[lo : lo + at_once], index.footrules(order[lo : lo + at_once]), strict=True)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivot: np.ndarray, k: int):
    """(query, id, score) of the best k of a block for each query. Rows with a query's own id are none of its neighbours."""
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    index = InvertedFiles(orders(x, pivot), len(pivot))
    most = index.length * (index.length + 1)
    count = min(len(ids), max(LEAST, int(np.ceil(RERANKED * len(ids)))))
    out = []
    order = orders(queries, pivot) if len(queries) else np.zeros((0, index.length), dtype=np.int64)
    for q, v, far in _each(query_ids, queries, order, index):
        if count < len(ids):
            rank = far.astype(np.int64) * len(ids) + np.arange(len(ids))  # ties to the smaller id
            taken = np.zeros(len(ids), dtype=bool)
            taken[np.argpartition(rank, count)[:count]] = True
            taken |= far <= CLOSE * most
            rows = np.flatnonzero(taken)
        else:
            rows = np.arange(len(ids))
        rows = rows[ids[rows] != q]
        score = (x[rows] * v).sum(axis=1)  # row by row, so that equal vectors have equal scores
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), q), ids[rows][best], score[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _search(shared, k: int):
    def run(batches):
        pivot = shared.value
        for table in runs(batches, ["block", "part"]):
            at = bounds(table, ["block", "part"])
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                t = table.slice(int(lo), int(hi - lo))
                asks = t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                if asks.all() or not asks.any():
                    continue
                ids = t.column("id").to_numpy()
                x = np.array(t.column("vector").combine_chunks().values.to_numpy(), dtype=np.float64).reshape(len(ids), -1)
                q, i, s = search_block(ids[~asks], x[~asks], ids[asks], x[asks], pivot, k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part: no null, zero vector, null or non-finite component."""
    v = F.col("vector")
    rows = narrow(vectors, id_col, vector_col).toDF("id", "vector").select(F.col("id").cast("long").alias("id"), v.cast("array<double>").alias("vector"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return rows.filter("id is not null and vector is not null").filter(fine)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each query among rows of another id.

    Rows that don't take part (see usable()), or whose vectors have another length than most of the sample's, neither ask
    nor answer; a query without candidates has no rows. Ties go to the smaller id. Rows that repeat an id and a vector
    count once; an id with several vectors answers by its best, and asks with each, for the best over them. Empty tables
    give no rows.
    """
    spark = vectors.sparkSession
    all_rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    pivot = pivots(all_rows)
    schema = "query_id long, vec_id long, score double"
    if not len(pivot):
        found = spark.createDataFrame([], schema)
    else:
        width = pivot.shape[1]
        all_rows = all_rows.filter(F.size("vector") == width)
        asking = usable(queries, id_col, vector_col).filter(F.size("vector") == width)
        n, m = all_rows.count(), asking.count()
        blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
        to = lambda count: F.pmod(F.xxhash64("id", "vector"), F.lit(count))
        each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
        posted = all_rows.select(to(blocks).alias("block"), each(parts).alias("part"), F.lit(False).alias("asks"), "id", "vector")
        asked = asking.select(each(blocks).alias("block"), to(parts).alias("part"), F.lit(True).alias("asks"), "id", "vector")
        tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        pairs = posted.unionByName(asked).repartition(min(tasks, blocks * parts), "block", "part").sortWithinPartitions("block", "part")
        found = pairs.mapInArrow(_search(spark.sparkContext.broadcast(pivot), k), schema)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
