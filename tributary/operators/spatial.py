"""A spatial index: which places can be among the nearest of a query, without measuring all of them.

Places are sorted along a space-filling curve (bits of latitude and longitude in turn) and cut into leaves of neighbours, at
most about LEAVES of them, each with its bounding box; leaves are written as packed rows. A query looks at all boxes
in rings of growing distance: the far corners of the first boxes that together hold enough places bound the distance
that still matters, and only leaves whose near edge lies within it are visited. A visit gives back the few places of
its leaf that can count. Boxes are measured by bounds that hold on the plane and on the sphere; on the ellipsoid, a
distance differs from the sphere's by less than SPREAD, so only what is left needs the exact formula.

What is broadcast are the boxes, whose number is bounded. Places at one point are first cut to those with the
smallest ids that can count, so a point that a third of all places share is no hot leaf; queries that visit one leaf
meet it in portions of PORTION.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import files

LEAF, LEAVES, PORTION = 512, 16_384, 2048
#: Largest difference of a distance on the ellipsoid to that on the sphere, as a share (really below 0.006).
SPREAD = 0.01
#: Distances that differ by no more can round to the same similarity.
_NEAR = 1e-6


def curve(lat: Column, lon: Column, bits: int = 26) -> Column:
    """Place on a space-filling curve: the bits of both coordinates in turn. Coordinates beyond the globe's count as its edge."""

    def spread(share: Column) -> Column:
        v = F.least(F.greatest(F.floor(share * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread((lat + 90) / 180), 1).bitwiseOR(spread((lon + 180) / 360))


def _angle(gap: np.ndarray) -> np.ndarray:
    """A difference of longitudes the short way round."""
    gap = np.abs(gap) % 360
    return np.minimum(gap, 360 - gap)


def planar(lat: np.ndarray, lon: np.ndarray, qlat: np.ndarray, qlon: np.ndarray) -> np.ndarray:
    return np.hypot((lat - qlat) * geo.KM_LATITUDE, (lon - qlon) * geo.KM_LONGITUDE)


def circle(lat: np.ndarray, lon: np.ndarray, qlat: np.ndarray, qlon: np.ndarray) -> np.ndarray:
    y, x = np.sin(np.radians(lat - qlat) / 2), np.sin(np.radians(lon - qlon) / 2)
    return 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.clip(y * y + np.cos(np.radians(lat)) * np.cos(np.radians(qlat)) * x * x, 0, 1)))


@dataclass
class Boxes:
    """Leaves with their bounds and numbers of places."""

    leaf: np.ndarray
    n: np.ndarray
    south: np.ndarray
    north: np.ndarray
    west: np.ndarray
    east: np.ndarray

    def bounds(self, lat: np.ndarray, lon: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Queries x leaves: distances that no place of the leaf falls below and that none exceeds."""
        lat, lon = lat[:, None], lon[:, None]
        low = np.maximum(0, np.maximum(self.south - lat, lat - self.north))
        high = np.maximum(np.abs(lat - self.south), np.abs(lat - self.north))
        if kind == "planar":
            near, far = np.maximum(0, np.maximum(self.west - lon, lon - self.east)), np.maximum(np.abs(lon - self.west), np.abs(lon - self.east))
            return np.hypot(low * geo.KM_LATITUDE, near * geo.KM_LONGITUDE), np.hypot(high * geo.KM_LATITUDE, far * geo.KM_LONGITUDE)
        within = (lon >= self.west) & (lon <= self.east)
        near = np.where(within, 0, np.minimum(_angle(self.west - lon), _angle(self.east - lon)))
        # The far side: half way round if the box reaches there, else its farther edge.
        across = (lon + 180 - self.west) % 360 <= self.east - self.west
        far = np.where(across, 180, np.maximum(_angle(self.west - lon), _angle(self.east - lon)))
        ends = [np.cos(np.radians(np.clip(x, -90, 90))) for x in (self.south, self.north)]
        widest = np.where((self.south <= 0) & (self.north >= 0), 1, np.maximum(*ends))
        own = np.maximum(0, np.cos(np.radians(lat)))

        def arc(y: np.ndarray, x: np.ndarray, narrow: np.ndarray) -> np.ndarray:
            return 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.clip(np.sin(np.radians(y) / 2) ** 2 + own * np.maximum(0, narrow) * np.sin(np.radians(x) / 2) ** 2, 0, 1)))

        low, high = arc(np.minimum(low, 180), near, np.minimum(*ends)), arc(np.minimum(high, 180), far, widest)
        return (low * (1 - SPREAD), high * (1 + SPREAD)) if kind == "geodesic" else (low, high)


def packed(places: DataFrame, leaf: int) -> DataFrame:
    """(leaf, n, south, north, west, east, ids, lats, lons) from (id, lat, lon): runs of ``leaf`` places along the curve, by id inside."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq, rest = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            while len(rest[0]) >= leaf:
                yield one(first + seq, [x[:leaf] for x in rest])
                rest, seq = [x[leaf:] for x in rest], seq + 1
        if rest is not None and len(rest[0]):
            yield one(first + seq, rest)

    def one(name: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(columns[0], kind="stable")
        ids, lats, lons = (c[order] for c in columns)
        flat = [name, len(ids), lats.min(), lats.max(), lons.min(), lons.max()]
        lists = [pa.array([x], pa.list_(pa.from_numpy_dtype(x.dtype))) for x in (ids, lats, lons)]
        return pa.RecordBatch.from_arrays([*(pa.array([x]) for x in flat), *lists], names=["leaf", "n", "south", "north", "west", "east", "ids", "lats", "lons"])

    rows = places.withColumn("at", curve(F.col("lat"), F.col("lon"))).repartitionByRange("at").sortWithinPartitions("at").select("id", "lat", "lon")
    return rows.mapInArrow(pack, "leaf long, n long, south double, north double, west double, east double, ids array<long>, lats array<double>, lons array<double>")


def candidates(places: DataFrame, queries: DataFrame, k: int, kind: str = "planar", level: float = 0.0, share: float = 1.0) -> DataFrame:
    """(query_id, contract_id, lat, lon, qlat, qlon): for each query all places that can be among its k nearest, and few others.

    ``places``: (contract_id, lat, lon), ``queries``: (query_id, lat, lon). Up to the distance ``level`` all places count
    as equally near, and those with the smallest ids come first. Similarities of which only a ``share`` counts are equal
    over as much wider a gap.
    """
    slight = _NEAR / min(1.0, share)
    spark = places.sparkSession
    context = spark.sparkContext
    ids = {name: df.schema[name].dataType for df, name in ((places, "contract_id"), (queries, "query_id"))}
    spots = places.where(geo.located(F.col("lat"), F.col("lon"))).select(F.col("contract_id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    asked = queries.where(geo.located(F.col("lat"), F.col("lon"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("lat").cast("double").alias("qlat"), F.col("lon").cast("double").alias("qlon"))
    # Of places at one point only the first k by id: the rank is cut before rows are shuffled.
    spots = spots.withColumn("nth", F.row_number().over(Window.partitionBy("lat", "lon").orderBy("id"))).where(F.col("nth") <= k).drop("nth")
    n = places.count()
    path = files.scratch(spark)
    packed(spots, max(LEAF, math.ceil(n / LEAVES))).write.parquet(path)
    leaves = spark.read.parquet(path)
    found = leaves.select("leaf", "n", "south", "north", "west", "east").toPandas()
    boxes = context.broadcast(Boxes(*(found[c].to_numpy() for c in ("leaf", "n", "south", "north", "west", "east"))))
    portions = max(1, -(-asked.count() // PORTION))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = boxes.value
        step = max(1, 1_000_000 // max(1, len(b.leaf)))
        for batch in batches:
            q, lat, lon = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for a in range(0, len(q) if len(b.leaf) else 0, step):
                cut = slice(a, a + step)
                low, high = b.bounds(lat[cut], lon[cut], kind)
                order = np.argsort(high, axis=1)
                enough = (np.cumsum(b.n[order], axis=1) < k).sum(axis=1)
                at = np.minimum(enough, len(b.leaf) - 1)[:, None]
                most = np.where(enough[:, None] < len(b.leaf), np.take_along_axis(np.take_along_axis(high, order, 1), at, 1), np.inf)
                most = np.maximum(most, level) * (1 + slight) + slight
                i, j = np.nonzero(low <= most)
                yield pa.RecordBatch.from_arrays([pa.array(b.leaf[j]), *(pa.array(x[cut][i]) for x in (q, lat, lon)), pa.array(most[i, 0])], names=["leaf", "query_id", "qlat", "qlon", "most"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = planar if kind == "planar" else circle
        slack = (1 + SPREAD) / (1 - SPREAD) if kind == "geodesic" else 1.0
        for batch in batches:
            for row in batch.to_pylist():
                ids, lats, lons = (np.array(row[c]) for c in ("ids", "lats", "lons"))
                q = np.array([v["query_id"] for v in row["visits"]])
                qlat, qlon, most = (np.array([v[c] for v in row["visits"]]) for c in ("qlat", "qlon", "most"))
                step = max(1, 2_000_000 // len(ids))
                for a in range(0, len(q), step):
                    cut = slice(a, a + step)
                    d = np.maximum(measure(lats, lons, qlat[cut, None], qlon[cut, None]), level)
                    some = min(k, len(ids))
                    # The first k by distance, then id; ids ascend in a leaf, so a stable order is enough.
                    order = np.argsort(d, axis=1, kind="stable")[:, :some]
                    kth = np.take_along_axis(d, order[:, -1:], 1)
                    within = (d > level) & (d <= kth * slack * (1 + slight) + slight)
                    np.put_along_axis(within, order, True, 1)
                    within &= d * (1 - SPREAD * (kind == "geodesic")) <= most[cut, None]
                    i, j = np.nonzero(within)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q[cut][i], ids[j], lats[j], lons[j], qlat[cut][i], qlon[cut][i])], names=["query_id", "contract_id", "lat", "lon", "qlat", "qlon"])

    visits = asked.mapInArrow(visit, "leaf long, query_id long, qlat double, qlon double, most double")
    lists = visits.groupBy("leaf", F.pmod(F.xxhash64("query_id"), F.lit(portions)).alias("portion")).agg(F.collect_list(F.struct("query_id", "qlat", "qlon", "most")).alias("visits"))
    met = lists.join(leaves.select("leaf", "ids", "lats", "lons"), "leaf").select("ids", "lats", "lons", "visits").mapInArrow(meet, "query_id long, contract_id long, lat double, lon double, qlat double, qlon double")
    return met.select(F.col("query_id").cast(ids["query_id"]).alias("query_id"), F.col("contract_id").cast(ids["contract_id"]).alias("contract_id"), "lat", "lon", "qlat", "qlon")
