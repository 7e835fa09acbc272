"""Links between vectors that lie within a distance, for density clusters, without comparing all pairs.

A vector is projected on a random line; two vectors within ``epsilon`` are within ``epsilon`` there too, so they lie in
the same or in neighbouring cells of that width. Several lines make a cell's key; each vector is posted under its own
cell and, as the smaller of two, meets its neighbours' cells. What meets is confirmed by the exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

#: Vectors of a block that is broadcast, and distances that a task holds at once.
BLOCK, _CELLS = 16_384, 1_000_000


def _cells(rows: DataFrame, epsilon: float, lines: int, seed: int, dims: int) -> DataFrame:
    generator = np.random.default_rng(seed)
    directions = generator.normal(size=(lines, dims))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    spots = [F.floor(vectors.dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in d))) / epsilon).cast("int") for d in directions]
    return rows.select("vec_id", "embedding", F.array(*spots).alias("cell"))


def epsilon_links(rows: DataFrame, epsilon: float, lines: int = 2, seed: int = 1) -> DataFrame:
    """(a, b, distance), a < b, of all pairs of rows (vec_id, embedding) within ``epsilon``: exact."""
    first = rows.select(F.size("embedding")).first()
    cells = _cells(rows.where(vectors.usable(F.col("embedding"))), epsilon, lines, seed, first[0] if first else 0)
    around = [F.array(*(F.get("cell", F.lit(k)) + d for k, d in enumerate(steps))) for steps in product((-1, 0, 1), repeat=lines)]
    left = cells.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), F.explode(F.array(*around)).alias("cell"))
    right = cells.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), "cell")
    met = left.join(right, "cell").where("a < b")
    return met.select("a", "b", vectors.euclidean_distance(F.col("x"), F.col("y")).alias("distance")).where(F.col("distance") <= epsilon)


def epsilon_link_counts(rows: DataFrame, epsilon: float, seed: int = 1) -> DataFrame:
    """(vec_id, n_links): how many rows of another id lie within ``epsilon`` of an id's rows; exact, none without links.

    No link is written or shuffled. Blocks of vectors are broadcast to all of them, sorted by their projection on a random
    line; a task compares its own, sorted alike, with the stretch of the block that the line does not rule out, by matrix
    products, and sends one number for each vector of the block. Distances that rounding leaves in doubt are taken again.
    """
    spark = rows.sparkSession
    sound = rows.where(F.col("vec_id").isNotNull() & vectors.usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = max(1, -(-sound.count() // BLOCK))
    block = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks))
    # All blocks meet the same exchange, which gives every core some vectors however the files are cut.
    dealt = sound.repartition(2 * spark.sparkContext.defaultParallelism, "vec_id")

    def run(no: int) -> DataFrame:
        some = sound.where(block == no).collect()
        v = np.array([r[1] for r in some], dtype=float).reshape(len(some), -1)
        line = np.random.default_rng(seed).normal(size=v.shape[1])
        line /= np.linalg.norm(line) or 1.0
        order = np.argsort(v @ line)
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in some], dtype=np.int64)[order], v[order], line))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, line = sent.value
            if not len(ids):
                return
            spot, square, n = q @ line, (q * q).sum(axis=1), np.zeros(len(ids), dtype=np.int64)
            by_id, step = np.argsort(ids, kind="stable"), max(1, _CELLS // len(ids))
            for batch in batches:
                names = batch.column(0).to_numpy(zero_copy_only=False)
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = v @ line
                order = np.argsort(own)
                for at in (order[a : a + step] for a in range(0, len(order), step)):
                    slack = epsilon + 1e-9 * (1 + np.abs(own[at]).max())
                    low, high = np.searchsorted(spot, own[at[0]] - slack), np.searchsorted(spot, own[at[-1]] + slack, "right")
                    if low == high:
                        continue
                    near = _within(q[low:high], square[low:high], v[at], epsilon)
                    # Rows of one id are no link.
                    first, end = (np.searchsorted(ids[by_id], names[at], side) for side in ("left", "right"))
                    j = np.repeat(np.arange(len(at)), end - first)
                    i = by_id[np.arange(len(j)) - np.repeat(np.cumsum(end - first) - end, end - first)] - low
                    inside = (i >= 0) & (i < high - low)
                    near[i[inside], j[inside]] = False
                    n[low:high] += near.sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], names=["vec_id", "n_links"])

        return dealt.mapInArrow(count, "vec_id long, n_links long")

    found = reduce(DataFrame.unionByName, [run(no) for no in range(blocks)])
    return found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))


def _within(q: np.ndarray, square: np.ndarray, v: np.ndarray, epsilon: float) -> np.ndarray:
    """Queries x vectors: whether they lie within ``epsilon``."""
    own = (v * v).sum(axis=1)
    d = square[:, None] + own - 2 * (q @ v.T)
    near, most = d <= epsilon * epsilon, 1e-11 * (square.max() + own.max() + epsilon * epsilon)
    i, j = np.nonzero(np.abs(d - epsilon * epsilon) <= most)
    for a in range(0, len(i), 10_000):
        x, y = i[a : a + 10_000], j[a : a + 10_000]
        near[x, y] = np.sqrt(((q[x] - v[y]) ** 2).sum(axis=1)) <= epsilon
    return near
