"""Approximate nearest neighbours by collision counting over single projections.

Each of m seeded projections is a hash function of its own; a block of vectors keeps them as
sorted arrays. A query opens a window around its own projection in every array. A vector that
lies in at least `threshold` windows is verified by its exact distance. While fewer than k
verified vectors lie within the radius, virtual rehashing widens all windows by the factor c,
which only looks at more of the same sorted arrays.

The table is dealt to blocks by a hash of the id, so reruns agree. Each vector goes to its block
alone, once; there it joins the block's sorted arrays, before which the queries then pass in
batches. So the vectors that move are the table and, for each block, the queries: linear in the
table for a given query set. A query's nearest of all blocks are merged.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, as queries or candidates; equal distances rank by smaller id; repeated rows each count,
so the query's own id is no candidate however often it stands; with fewer than k candidates all
are returned; vectors of another dimension than the query's are no candidates; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

SCHEMA = "query_id long, vec_id long, score double"


class Projections:
    """m unit-variance projections for vectors of a dimension, the same everywhere."""

    def __init__(self, dim: int, m: int = 48, seed: int = 42):
        self.lines = np.random.default_rng([seed, dim]).standard_normal((dim, m))

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.lines


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, on the original vectors."""
    gap = vectors - query
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


class Block:
    """Vectors of a block with the sorted arrays of their projections.

    At radius R a window holds the projections within R of the query's. A vector at distance s
    is in a window with probability erf(R / (s sqrt 2)): 0.82 at s = reach * R, well above
    `share`, the part of the m windows in which it must lie. So rounds end once k verified
    vectors lie within reach * R, and there is no limit on how many are verified.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = 32, share: float = 0.6, reach: float = 0.75, c: float = 1.25, seed: int = 42):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.project = Projections(vectors.shape[1], m, seed)
        stored = self.project(self.vectors)
        self.order = np.argsort(stored, axis=0, kind="stable").T.copy()
        self.arrays = [stored[self.order[j], j] for j in range(m)]
        self.m, self.reach, self.c = m, reach, c
        self.threshold = int(np.ceil(share * m))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int = 10) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, (vec_id, distance) of the k nearest verified vectors of the block."""
        asked = self.project(queries)
        middles = np.stack([a.searchsorted(asked[:, j]) for j, a in enumerate(self.arrays)], axis=1)
        return [self._nearest(*x, k) for x in zip(query_ids, queries, asked, middles.tolist())]

    def _nearest(self, query_id: int, query: np.ndarray, asked: np.ndarray, low: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, order, n = self.ids, self.order, len(self.ids)
        own = ids == query_id
        want = min(k, n - int(own.sum()))
        counts, verified = np.zeros(n, np.int16), own.copy()
        high = low.copy()
        near_ids, near = np.zeros(0, np.int64), np.zeros(0)
        # the first radius: the nearest of some neighbours in a single projection, so hardly ever too wide
        around = order[0][max(0, low[0] - 16) : low[0] + 16]
        around = around[~own[around]]
        radius = max(0.5 * float(distances(query, self.vectors[around]).min()) / self.reach, 1e-9) if len(around) else 1.0
        while want:
            for j, array in enumerate(self.arrays):
                a, b = array.searchsorted((asked[j] - radius, np.nextafter(asked[j] + radius, np.inf)))
                if a < low[j]:
                    counts[order[j, a : low[j]]] += 1
                    low[j] = a
                if b > high[j]:
                    counts[order[j, high[j] : b]] += 1
                    high[j] = b
            fresh = np.flatnonzero((counts >= self.threshold) & ~verified)
            if len(fresh):
                verified[fresh] = True
                near_ids = np.concatenate([near_ids, ids[fresh]])
                near = np.concatenate([near, distances(query, self.vectors[fresh])])
                best = np.lexsort((near_ids, near))[:want]
                near_ids, near = near_ids[best], near[best]
            if verified.all() or len(near) == want and near[-1] <= self.reach * radius:
                break
            radius *= self.c
        return near_ids, near


def valid(vector: Column) -> Column:
    """No null, NaN or infinite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length and without nulls, as `valid` and `dim` have seen to."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((dim, b, query), ids, vectors) of rows that stand together in the order of these three."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "b", "query")], axis=1)
        cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))).tolist() if len(keys) else []
        for a, b in zip(cuts, [*cuts[1:], len(keys)]):
            part = batch.slice(a, b - a)
            yield tuple(keys[a].tolist()), part.column("vec_id").to_numpy(), _matrix(part.column("embedding"))


def nearest(table: DataFrame, every: int = 100, k: int = 10, block: int = 1 << 15, **how) -> DataFrame:
    """query_id, rank, vec_id, score for queries with vec_id divisible by `every`.

    table: vec_id, embedding. block: vectors that a task holds at most (about); a small table has
    smaller blocks, so that all tasks have some.
    """
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(valid(F.col("embedding")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))
    rows = materialize(rows, "neighbours")
    least = F.least(F.ceil(F.col("n") / 1024), F.lit(2 * spark.sparkContext.defaultParallelism))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("dim", F.greatest(F.lit(1), F.ceil(F.col("n") / block), least).cast("int").alias("blocks"))
    dims, total = sizes.agg(F.count(F.lit(1)), F.sum("blocks")).first()
    rows = rows.join(F.broadcast(sizes) if dims <= 1000 else sizes, "dim")
    blocks = F.col("blocks")
    stored = rows.select("dim", "vec_id", "embedding", F.pmod(F.xxhash64("vec_id", F.lit(7)), blocks).cast("int").alias("b"), F.lit(False).alias("query"))
    asking = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "embedding"])
    asking = asking.select("dim", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"), F.lit(True).alias("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, index = None, [], None
        for (dim, b, query), ids, vectors in _pieces(batches):
            if place != (dim, b):
                place, held, index = (dim, b), [], None
            if not query:
                held.append((ids, vectors))
                continue
            if index is None and held:
                index, held = Block(*map(np.concatenate, zip(*held)), **how), []
            for i in range(0, len(ids) if index else 0, 256):
                found = index.search(ids[i : i + 256], vectors[i : i + 256], k)
                asked = np.repeat(ids[i : i + 256], [len(x) for x, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(asked), *(pa.array(np.concatenate(x)) for x in zip(*found))], ["query_id", "vec_id", "score"])

    # more partitions than blocks, so that few hold two; the number of tasks grows with the table
    dealt = stored.union(asking).repartition(3 * int(total or 1), "dim", "b").sortWithinPartitions("dim", "b", "query")
    found = dealt.mapInArrow(run, SCHEMA)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
