"""Nearest neighbours and per-query top results.

Reference rows stay where they are: queries, the small side, go to them. They are broadcast while there are at most
QUERY_ROWS of them (vectors: QUERY_VECTORS), and taken in blocks of about that size beyond, so memory does not grow
with the number of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import geo, vectors
from . import pivots, spatial

QUERY_ROWS = 20_000
#: Query vectors that a task compares its items with, whichever queries they belong to.
QUERY_VECTORS = 4096
#: Distances that a task holds at once.
CELLS = 500_000
#: Items whose order to one query a task makes at once, some hundred bytes for each; distances of all queries of a task, 20 bytes
#: each, which its memory holds without spilling.
WHOLE, PORTION = 2_000_000, 12_000_000


def top_k(df: DataFrame, by: Column, k: int | None, partition: list[str], ties: list[str], rank: str = "rank") -> DataFrame:
    """The first k rows of each partition in the order of ``by`` (give it with asc or desc), then of ``ties``; all with k None.

    Rows whose value is null or NaN never come: callers leave them out (``usable``) before.
    """
    order = Window.partitionBy(*partition).orderBy(by, *ties)
    ranked = df.withColumn(rank, F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def usable(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(value))


def in_blocks(queries: DataFrame, key: list[str], run: Callable[[DataFrame], DataFrame], rows: int = QUERY_ROWS) -> DataFrame:
    """``run`` on broadcast blocks of the queries, the results together; whole keys stay in one block."""
    n = queries.count()
    blocks = max(1, -(-n // rows))
    part = F.pmod(F.xxhash64(*key), F.lit(blocks))
    out = None
    for k in range(blocks):
        one = run(F.broadcast(queries if blocks == 1 else queries.where(part == k)))
        out = one if out is None else out.unionByName(one)
    return out


def flattened(df: DataFrame, key: str, vectors_col: str = "embeddings", texts_col: str | None = None) -> DataFrame:
    """(key, pos, embedding[, item]) from arrays of vectors (and of texts beside them); unusable vectors are left out."""
    zipped = df.select(key, F.posexplode(vectors_col).alias("pos", "embedding"), *([F.col(texts_col).alias("texts")] if texts_col else []))
    rows = zipped.select(key, "pos", F.col("embedding").cast("array<double>").alias("embedding"), *([F.get("texts", F.col("pos")).alias("item")] if texts_col else []))
    return rows.where(vectors.usable(F.col("embedding")))


def matrix(rows: list[list[float]]) -> np.ndarray:
    """Vectors of one length as rows; none make an empty matrix."""
    return np.array(rows, dtype=float).reshape(len(rows), len(rows[0]) if rows else 0)


def vector_distances(items: DataFrame, queries: DataFrame, distance: str = "cosine", item_key: tuple[str, ...] = ("contract_id", "pos"), query_key: tuple[str, ...] = ("query_id", "query_pos")) -> DataFrame:
    """Every (query, item) pair with its distance, by matrices: tasks compare their items with a broadcast block of queries
    and hold CELLS distances at once, whatever the number of items; keys may be of any type."""
    context = items.sparkSession.sparkContext
    vector = F.col("embedding").cast("array<double>")

    def run(block: DataFrame) -> DataFrame:
        rows = block.where(vectors.usable(F.col("embedding"))).select(*query_key, vector.alias("embedding")).orderBy(*query_key).toArrow().combine_chunks()
        sent = context.broadcast(([rows.column(c).combine_chunks() for c in query_key], matrix(rows.column("embedding").to_pylist())))

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, q = sent.value
            if not len(q):
                return
            step = max(1, CELLS // len(q))
            for batch in (full.slice(a, step) for full in batches for a in range(0, full.num_rows, step)):
                n = batch.num_rows
                v = batch.column(len(item_key)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                d = pivots.distances(v, q, distance)
                # Runs in the order of queries and distances: whoever sorts all pairs has only to merge them.
                order = np.argsort(np.rint(d * 1e9), axis=1, kind="stable")
                of, at = np.repeat(np.arange(len(q)), n), order.ravel()
                columns = [*(x.take(pa.array(of)) for x in keys), *(batch.column(c).take(pa.array(at)) for c in range(len(item_key))), pa.array(np.take_along_axis(d, order, axis=1).ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=[*query_key, *item_key, "distance"])

        source = items.where(vectors.usable(F.col("embedding"))).select(*item_key, vector.alias("embedding"))
        kinds = [df.schema[name] for df, key in ((queries, query_key), (items, item_key)) for name in key]
        return source.mapInArrow(pairs, StructType([*kinds, StructField("distance", DoubleType())]))

    return in_blocks(queries, [*query_key], run, rows=QUERY_VECTORS).where(~F.isnan("distance"))


def nearest_items(items: DataFrame, queries: DataFrame, k: int | None = 1, distance: str = "cosine", item_key: tuple[str, ...] = ("contract_id", "pos"), query_key: tuple[str, ...] = ("query_id", "query_pos")) -> DataFrame:
    """The k nearest items of every query vector, ascending; equal distances go by the item's key.

    With k given, tasks keep k rows a query; all pairs are written out only where all are wanted, or under other keys.
    """
    usual = (item_key, query_key) == (("contract_id", "pos"), ("query_id", "query_pos"))
    if k is not None and usual:
        types = {name: df.schema[name].dataType for df, key in ((queries, query_key), (items, item_key)) for name in key}
        return nearest_items_block(items, queries, k, distance).select(*(F.col(name).cast(kind).alias(name) for name, kind in types.items()), "distance", "rank")
    pairs = vector_distances(items, queries, distance, item_key, query_key)
    # Nine digits as in F.round, which makes decimals of all pairs.
    return top_k(pairs, (F.rint(F.col("distance") * 1e9) + 0.0).asc(), k, [*query_key], [*item_key])


def full_order(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query_pos, contract_id, pos, rank): all items in the order of their cosine distance (nine digits) to every query, then of their key.

    ``nearest_items`` of all, without the distance: no row for each pair is shuffled or sorted. A task sends each query its
    distances as one array of four bytes each, beside keys that are the same for all queries, so compression leaves them
    out; whoever has a query's arrays orders them. Beyond WHOLE items, or where a key is null, rows of pairs are sorted.
    """
    known = items.agg(F.count("*"), F.count(F.when(F.col("contract_id").isNotNull() & F.col("pos").isNotNull(), 1))).first()
    if known[0] > min(WHOLE, known[1]):
        return nearest_items(items, queries, None).drop("distance")
    context = items.sparkSession.sparkContext
    names = ["query_id", "query_pos", "contract_id", "pos"]
    types = [df.schema[name].dataType.simpleString() for df, name in zip((queries, queries, items, items), names, strict=True)]

    def run(block: DataFrame) -> DataFrame:
        rows = block.where(vectors.usable(F.col("embedding"))).select("query_id", "query_pos", F.col("embedding").cast("array<double>").alias("embedding")).orderBy("query_id", "query_pos").toArrow().combine_chunks()
        sent = context.broadcast(([rows.column(c).combine_chunks() for c in (0, 1)], matrix(rows.column(2).to_pylist())))

        def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, q = sent.value
            if not len(q):
                return
            step = max(1, CELLS // len(q))
            for batch in (full.slice(a, step) for full in batches for a in range(0, full.num_rows, step)):
                v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                d = np.rint(pivots.distances(v, q, "cosine") * 1e9)
                # A distance that is no number has no place.
                good = ~np.isnan(d)
                offsets = pa.array(np.concatenate([[0], np.cumsum(good.sum(axis=1))]).astype(np.int32))
                each = [d[good].astype(np.int32), *(np.broadcast_to(batch.column(c).to_numpy(), d.shape)[good] for c in (0, 1))]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in each)], names=["query_id", "query_pos", "near", "ids", "at"])

        source = items.where(vectors.usable(F.col("embedding"))).select(F.col("contract_id").cast("long"), F.col("pos").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
        return source.mapInArrow(arrays, f"query_id {types[0]}, query_pos {types[1]}, near array<int>, ids array<long>, at array<long>")

    def ordered(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        near, ids, at = (np.concatenate([x.flatten().to_numpy() for x in parts.column(c).chunks]) for c in ("near", "ids", "at"))
        order = np.lexsort((at, ids, near))
        n = len(order)
        of = [pa.repeat(x, n) for x in key]
        return pa.table([*of, pa.array(ids[order]), pa.array(at[order]), pa.array(np.arange(1, n + 1, dtype=np.int32))], names=[*names, "rank"])

    arrays_of = in_blocks(queries, ["query_id", "query_pos"], run, rows=QUERY_VECTORS)
    portions = max(context.defaultParallelism, -(-known[0] * queries.count() // PORTION))
    dealt = arrays_of.repartition(portions, "query_id", "query_pos")
    found = dealt.groupBy("query_id", "query_pos").applyInArrow(ordered, f"query_id {types[0]}, query_pos {types[1]}, contract_id long, pos long, rank int")
    return found.select(*(F.col(name).cast(kind).alias(name) for name, kind in zip(names, types, strict=True)), "rank")


def nearest_items_block(items: DataFrame, queries: DataFrame, k: int = 1, distance: str = "cosine") -> DataFrame:
    """``nearest_items`` by matrices: each task compares its items with a broadcast block of queries and keeps k a query,
    so at most k rows a query and task are shuffled. Same result, for many queries. A task holds CELLS distances and
    k rows for each query of a block, whatever the number of items."""
    context = items.sparkSession.sparkContext

    def run(block: DataFrame) -> DataFrame:
        rows = block.where(vectors.usable(F.col("embedding"))).select("query_id", "query_pos", "embedding").orderBy("query_id", "query_pos").collect()
        sent = context.broadcast(([(r[0], r[1]) for r in rows], matrix([r[2] for r in rows])))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, q = sent.value
            if not len(keys):
                return
            # The k best so far of each query, in rows: rounded and whole distance, contract, position.
            near, whole, ids, at = (np.zeros((len(keys), 0), dtype=t) for t in (float, float, np.int64, np.int64))
            step = max(1, CELLS // len(keys))
            for batch in (full.slice(a, step) for full in batches for a in range(0, full.num_rows, step)):
                v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                d = pivots.distances(v, q, distance)
                rounded = np.round(d, 9)
                # Once a query has k, only a row that is as near as its last one changes anything, or any if that one's distance is no number.
                of = np.flatnonzero(~(rounded > near[:, -1:]).all(axis=1)) if near.shape[1] == k else np.arange(len(keys))
                fresh = [np.broadcast_to(batch.column(c).to_numpy(zero_copy_only=False), (len(of), batch.num_rows)) for c in (0, 1)]
                more = [np.hstack(x) for x in ((near[of], rounded[of]), (whole[of], d[of]), (ids[of], fresh[0]), (at[of], fresh[1]))]
                order = np.lexsort((more[3], more[2], more[0]), axis=1)[:, :k]
                more = [np.take_along_axis(x, order, axis=1) for x in more]
                if order.shape[1] > near.shape[1]:
                    near, whole, ids, at = more
                else:
                    for kept, new in zip((near, whole, ids, at), more, strict=True):
                        kept[of] = new
            n = near.shape[1]
            mine = np.repeat(np.array(keys, dtype=np.int64), n, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mine[:, 0].copy(), mine[:, 1].copy(), ids.ravel(), at.ravel(), whole.ravel())], names=["query_id", "query_pos", "contract_id", "pos", "distance"])

        source = items.where(vectors.usable(F.col("embedding"))).select("contract_id", F.col("pos").cast("long").alias("pos"), "embedding")
        return source.mapInArrow(best, "query_id long, query_pos long, contract_id long, pos long, distance double")

    pairs = in_blocks(queries, ["query_id", "query_pos"], run, rows=QUERY_VECTORS).where(~F.isnan("distance"))
    return top_k(pairs, F.round("distance", 9).asc(), k, ["query_id", "query_pos"], ["contract_id", "pos"])


def least_distances(items: DataFrame, queries: DataFrame, distance: str = "cosine") -> DataFrame:
    """(query_id, query_pos, distance): each query's distance to its nearest item, by matrices as in ``nearest_items_block``.
    A task holds CELLS distances and sends one number for each query."""
    context = items.sparkSession.sparkContext

    def run(block: DataFrame) -> DataFrame:
        rows = block.where(vectors.usable(F.col("embedding"))).select("query_id", "query_pos", "embedding").collect()
        sent = context.broadcast(([[r[c] for r in rows] for c in (0, 1)], matrix([r[2] for r in rows])))

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, q = sent.value
            if not len(q):
                return
            found, step = np.full(len(q), np.nan), max(1, CELLS // len(q))
            for batch in (full.slice(a, step) for full in batches for a in range(0, full.num_rows, step)):
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                # A distance that is no number counts for nothing.
                found = np.fmin(found, np.fmin.reduce(pivots.distances(v, q, distance), axis=1))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in keys), pa.array(found)], names=["query_id", "query_pos", "distance"])

        return items.where(vectors.usable(F.col("embedding"))).select(F.col("embedding").cast("array<double>")).mapInArrow(least, "query_id long, query_pos long, distance double")

    types = [queries.schema[name].dataType for name in ("query_id", "query_pos")]
    parts = in_blocks(queries, ["query_id", "query_pos"], run, rows=QUERY_VECTORS).where(~F.isnan("distance"))
    found = parts.groupBy("query_id", "query_pos").agg(F.min("distance").alias("distance"))
    return found.select(*(F.col(name).cast(kind).alias(name) for name, kind in zip(("query_id", "query_pos"), types, strict=True)), "distance")


def nearest_items_indexed(items: DataFrame, queries: DataFrame, k: int = 1, distance: str = "cosine") -> DataFrame:
    """``nearest_items`` by a metric index, for items that form groups: rings of vectors that cannot hold a nearer one are left out."""
    pairs = pivots.Index(items, distance).nearest(queries, k)
    return top_k(pairs, F.round("distance", 9).asc(), k, ["query_id", "query_pos"], ["contract_id", "pos"])


def location_distances(places: DataFrame, queries: DataFrame, kind: str = "planar") -> DataFrame:
    """Every (query, contract) pair with its distance in kilometres; unusable points are left out. Both sides have lat and lon."""
    left = places.where(geo.located(F.col("lat"), F.col("lon"))).select("contract_id", "lat", "lon")
    right = queries.where(geo.located(F.col("lat"), F.col("lon"))).select("query_id", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
    value = _kilometres(kind)(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon"))
    return in_blocks(right, ["query_id"], lambda q: left.crossJoin(q).select("query_id", "contract_id", value.alias("distance")))


def _kilometres(kind: str) -> Callable[..., Column]:
    return {"planar": geo.planar_km, "great_circle": geo.great_circle_km, "geodesic": geo.geodesic_km}[kind]


def nearest_places(places: DataFrame, queries: DataFrame, k: int = 1, kind: str = "planar") -> DataFrame:
    """The k nearest places of every query; only candidates from the spatial index are measured."""
    near = spatial.candidates(places, queries, k, kind)
    pairs = usable(near.select("query_id", "contract_id", _kilometres(kind)(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon")).alias("distance")), "distance")
    return top_k(pairs, F.round("distance", 9).asc(), k, ["query_id"], ["contract_id"])


def clustered_nearest(items: DataFrame, clusters: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    """Two-level search: the k nearest cluster representatives of each query, then all their members at that distance.

    ``clusters``: (contract_id, pos, cluster_id) of every item; the representative is the member with the smallest key.
    Distances are taken to representatives only, so a cluster's members cost one comparison.
    """
    key = ["contract_id", "pos"]
    placed = items.join(clusters, key)
    heads = placed.groupBy("cluster_id").agg(F.min_by("embedding", F.struct(*key)).alias("embedding")).select(F.col("cluster_id").alias("contract_id"), F.lit(0).alias("pos"), "embedding")
    near = nearest_items(heads, queries, k).select("query_id", "query_pos", F.col("contract_id").alias("cluster_id"), "distance")
    return near.join(placed.select("cluster_id", *key), "cluster_id").select("query_id", "query_pos", *key, "cluster_id", "distance")


def identical_clusters(items: DataFrame) -> DataFrame:
    """(contract_id, pos, cluster_id): equal vectors are one cluster, named by a hash of the vector."""
    return items.select("contract_id", "pos", F.xxhash64("embedding").alias("cluster_id"))
