"""A metric index of vectors: nearest neighbours and links within a distance, without comparing all pairs.

At most a few hundred vectors, one for each CELL, drawn by a hash of their keys, are pivots. Every vector belongs to its nearest pivot, and a pivot's
vectors, sorted by their distance to it, are cut into rings of at most about RING vectors, each a packed row. The
triangle inequality bounds every distance from a query to a ring by the query's distance to the pivot and the ring's
two radii, and by half its distance beyond its own nearest pivot. Nearest neighbours take two passes: the ring that
looks nearest gives each query the distance of its k-th neighbour so far, and only rings that may hold something nearer are
visited then. A visit compares packed rings with portions of queries by matrix products and gives back k rows a query.

Cosine distances are measured as Euclidean ones of unit vectors, where the inequality holds. What is broadcast are the
pivots and the rings' radii, whose numbers are bounded by PIVOTS and RINGS. Results are exact whatever the index leaves out;
how much that is depends on the vectors: much where they form groups, little where all distances are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources import files

PIVOTS, CELL, RING, RINGS, PORTION = 256, 2048, 4096, 65_536, 4096
#: Distances that a task holds at once.
_CUBE = 2_000_000
#: Distances are rounded to 9 digits before they are compared.
_NEAR = 1e-8


def distances(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Queries x vectors. Cosine is a matrix product; differences are taken a few vectors at a time, so no cube of all is held."""
    if metric == "cosine":
        return 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    out, step = np.empty((len(q), len(v))), max(1, 2_000_000 // max(1, q.size))
    for a in range(0, len(v), step):
        gap = q[:, None, :] - v[None, a : a + step, :]
        out[:, a : a + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)) if metric == "euclidean" else np.abs(gap).sum(axis=2)
    return out


def _metric(d: np.ndarray, metric: str) -> np.ndarray:
    """A distance as one for which the triangle inequality holds."""
    return np.sqrt(2 * np.maximum(d, 0)) if metric == "cosine" else d


def _plain(d: np.ndarray, metric: str) -> np.ndarray:
    return d * d / 2 if metric == "cosine" else d


@dataclass
class Rings:
    """Pivots, and for each ring its number, pivot, radii and size."""

    pivots: np.ndarray
    ring: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray

    def bounds(self, q: np.ndarray, metric: str) -> np.ndarray:
        """Queries x rings: distances that no vector of the ring falls below."""
        to = _metric(distances(self.pivots, q, metric), metric)
        own = to.min(axis=1, keepdims=True)
        to = to[:, self.cell]
        low = np.maximum(np.maximum(to - self.high, self.low - to), (to - own) / 2)
        return _plain(np.maximum(0, low - 1e-9), metric)


def _flat(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


class Index:
    """An index of (contract_id, pos, embedding) rows; unusable vectors are left out."""

    def __init__(self, items: DataFrame, metric: str = "cosine", pivots: int = PIVOTS):
        spark = items.sparkSession
        self.metric, self.context = metric, spark.sparkContext
        rows = items.where(vectors.usable(F.col("embedding"))).select(F.col("contract_id").cast("long").alias("contract_id"), F.col("pos").cast("long").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"))
        self.n = rows.count()
        drawn = rows.select("embedding", F.xxhash64("contract_id", "pos").alias("at")).orderBy("at").limit(max(1, min(pivots, self.n // CELL))).collect()
        self.pivots = np.unique(np.array([r[0] for r in drawn], dtype=float), axis=0) if drawn else np.zeros((0, 0))
        path = files.scratch(spark)
        self._packed(rows, max(RING, -(-self.n // RINGS))).write.parquet(path)
        #: (ring, cell, low, high, n, contracts, poses, vectors): a row for each ring.
        self.rings = spark.read.parquet(path)

    @cached_property
    def sent(self) -> Broadcast:
        found = self.rings.select("ring", "cell", "low", "high", "n").toPandas()
        return self.context.broadcast(Rings(self.pivots, *(found[c].to_numpy() for c in ("ring", "cell", "low", "high", "n"))))

    def _packed(self, rows: DataFrame, size: int) -> DataFrame:
        pivots, metric = self.context.broadcast(self.pivots), self.metric

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = _metric(distances(pivots.value, _flat(batch.column(2), batch.num_rows), metric), metric)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int64)), pa.array(d.min(axis=1))], names=["contract_id", "pos", "embedding", "cell", "radius"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, seq, rest = TaskContext.get().partitionId() << 32, 0, None
            for batch in batches:
                columns = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)), _flat(batch.column(2), batch.num_rows), *(batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))]
                if not batch.num_rows:
                    continue
                rest = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns, strict=True)]
                while len(rest[3]) > size or rest[3][0] != rest[3][-1]:
                    cut = min(size, int(np.argmax(np.append(rest[3] != rest[3][0], True))))
                    yield one(first + seq, [x[:cut] for x in rest])
                    rest, seq = [x[cut:] for x in rest], seq + 1
            if rest is not None and len(rest[3]):
                yield one(first + seq, rest)

        def one(name: int, columns: list[np.ndarray]) -> pa.RecordBatch:
            contracts, poses, v, cell, radius = columns
            flat = [name, int(cell[0]), radius.min(), radius.max(), len(cell)]
            lists = [pa.array([x], pa.list_(pa.from_numpy_dtype(x.dtype))) for x in (contracts, poses, v.ravel())]
            return pa.RecordBatch.from_arrays([*(pa.array([x]) for x in flat), *lists], names=["ring", "cell", "low", "high", "n", "contracts", "poses", "vectors"])

        placed = rows.mapInArrow(place, "contract_id long, pos long, embedding array<double>, cell long, radius double")
        # Ties of radius, as copies of one vector make, are dealt by a hash, so they can lie in several tasks.
        dealt = placed.withColumn("h", F.xxhash64("contract_id", "pos")).repartitionByRange("cell", "radius", "h").sortWithinPartitions("cell", "radius", "h")
        return dealt.select("contract_id", "pos", "embedding", "cell", "radius").mapInArrow(pack, "ring long, cell long, low double, high double, n long, contracts array<long>, poses array<long>, vectors array<double>")

    def visits(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(ring, query_id, query_pos, embedding, most): the rings that may hold a vector within ``most`` of a query.

        ``queries`` have that column, a distance; or ``k`` is given, and each query's first ring or rings are returned that
        look nearest and hold k vectors.
        """
        rings, metric = self.sent, self.metric

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = rings.value
            step = max(1, 1_000_000 // max(1, len(r.ring)))
            for whole in batches:
                for a in range(0, whole.num_rows if len(r.ring) else 0, step):
                    batch = whole.slice(a, step)
                    low, most = r.bounds(_flat(batch.column(2), batch.num_rows), metric), batch.column(3).to_numpy(zero_copy_only=False)
                    if k is None:
                        i, j = np.nonzero(low <= most[:, None] + _NEAR)
                    else:
                        order = np.argsort(low, axis=1, kind="stable")
                        i, j = np.nonzero(np.cumsum(r.n[order], axis=1) - r.n[order] < k)
                        j = order[i, j]
                    at = pa.array(i)
                    yield pa.RecordBatch.from_arrays([pa.array(r.ring[j]), *(batch.column(c).take(at) for c in range(4))], names=["ring", "query_id", "query_pos", "embedding", "most"])

        asked = queries.select("query_id", "query_pos", "embedding", "most")
        return asked.mapInArrow(visit, "ring long, query_id long, query_pos long, embedding array<double>, most double")

    def meetings(self, visits: DataFrame, portions: int) -> DataFrame:
        """(contracts, poses, vectors, visits): each ring with the queries that visit it, in portions."""
        portion = F.pmod(F.xxhash64("query_id", "query_pos"), F.lit(portions)).alias("portion")
        lists = visits.groupBy("ring", portion).agg(F.collect_list(F.struct("query_id", "query_pos", "embedding", "most")).alias("visits"))
        return lists.join(self.rings.select("ring", "contracts", "poses", "vectors"), "ring").select("contracts", "poses", "vectors", "visits")

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, query_pos, contract_id, pos, distance): the k nearest of each (query_id, query_pos, embedding), and a few more."""
        metric = self.metric

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for contracts, poses, v, keys, q in met(batch):
                    d = distances(v, q, metric)
                    near = np.round(d, 9)
                    i, j = np.nonzero(near <= np.partition(near, min(k, len(v)) - 1, axis=1)[:, [min(k, len(v)) - 1]])
                    # Of ties at the k-th place those with the smallest keys.
                    order = np.lexsort((poses[j], contracts[j], near[i, j], i))
                    i, j = i[order], j[order]
                    first = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j = i[first], j[first]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[i, 0], keys[i, 1], contracts[j], poses[j], d[i, j])], names=["query_id", "query_pos", "contract_id", "pos", "distance"])

        rows = queries.where(vectors.usable(F.col("embedding"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("query_pos").cast("long").alias("query_pos"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(0.0).alias("most"))
        portions = max(1, -(-rows.count() // PORTION))
        schema = "query_id long, query_pos long, contract_id long, pos long, distance double"
        key = ["query_id", "query_pos"]
        path = files.scratch(queries.sparkSession)
        first = self.visits(rows, k)
        first.select("ring", *key).write.parquet(f"{path}/visited")
        self.meetings(first, portions).mapInArrow(meet, schema).write.parquet(f"{path}/found")
        visited, found = (queries.sparkSession.read.parquet(f"{path}/{name}") for name in ("visited", "found"))
        # The k-th distance so far; of a query with fewer vectors everything matters.
        nth = found.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("distance"))).where(F.col("nth") == k)
        bounded = rows.drop("most").join(nth.select(*key, F.col("distance").alias("most")), key, "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
        more = self.visits(bounded).join(visited, ["ring", *key], "left_anti")
        return found.unionByName(self.meetings(more, portions).mapInArrow(meet, schema))

    def within(self, queries: DataFrame, most: float) -> DataFrame:
        """(query_id, query_pos, contract_id, pos, distance) of all vectors within a distance of each query."""
        metric = self.metric

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for contracts, poses, v, keys, q in met(batch):
                    d = distances(v, q, metric)
                    i, j = np.nonzero(d <= most)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[i, 0], keys[i, 1], contracts[j], poses[j], d[i, j])], names=["query_id", "query_pos", "contract_id", "pos", "distance"])

        rows = queries.where(vectors.usable(F.col("embedding"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("query_pos").cast("long").alias("query_pos"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(float(most)).alias("most"))
        portions = max(1, -(-rows.count() // PORTION))
        return self.meetings(self.visits(rows), portions).mapInArrow(meet, "query_id long, query_pos long, contract_id long, pos long, distance double")

    def compared(self, queries: DataFrame, k: int) -> float:
        """Share of all pairs of a query and a vector that ``nearest`` compares."""
        near = self.nearest(queries, k).groupBy("query_id", "query_pos").agg(F.sort_array(F.collect_list("distance")).alias("d"))
        asked = queries.join(near.select("query_id", "query_pos", F.get("d", F.lit(k - 1)).alias("most")), ["query_id", "query_pos"])
        used = self.visits(asked).join(self.rings.select("ring", "n"), "ring").agg(F.sum("n")).first()[0] or 0
        return used / max(1, self.n * queries.count())


def met(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """The meetings of a batch as arrays: contracts, positions and vectors of a ring, keys and vectors of some of its queries."""
    for n in range(batch.num_rows):
        contracts, poses, v = (batch.column(c)[n].values.to_numpy(zero_copy_only=False) for c in range(3))
        found = batch.column(3)[n].values
        keys = np.stack([found.field(c).to_numpy(zero_copy_only=False) for c in (0, 1)], axis=1)
        q, step = _flat(found.field(2), len(keys)), max(1, _CUBE // len(contracts))
        for a in range(0, len(keys), step):
            yield contracts, poses, v.reshape(len(contracts), -1), keys[a : a + step], q[a : a + step]
