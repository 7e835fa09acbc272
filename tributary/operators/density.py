"""Clusters of vectors by density, and nearest neighbours through them.

A vector is dense if at least ``least`` vectors, itself included, lie within ``epsilon`` of it, both as unit vectors. Dense
vectors within ``epsilon`` of each other share a cluster, clusters of fewer than ``least`` vectors are none, and a vector
in no cluster forms one with its equals. This is the flat cut of the hierarchy of mutual reachability at ``epsilon``.

Equal vectors are counted first and travel as one. Each task compares its vectors, by matrix products, with blocks of BLOCK
vectors that are broadcast in turn. In the first pass it sends counts, in the second the links of a forest over its batch and
the block; neither pairs nor vectors are shuffled for them. Links meet in stars, contracted in rounds that are written as tables.

Both passes begin with one block. A vector that is dense by that block's vectors alone needs no further count, and two vectors
that its links have joined need no further link. So only vectors that are not yet known as dense go on to be counted, and
those outside the largest cluster so far to be linked, each of them with all: the result is that of all pairs. Where most
vectors are dense and belong together, as random ones do, that leaves few; where none are, all pairs are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources import files
from . import nearest

#: Vectors of a block that is broadcast, and similarities that a task holds at once.
BLOCK, CELLS = 16_384, 1_000_000


def _settled(df: DataFrame) -> DataFrame:
    path = files.scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _roots(links: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that links (a row for each, two nodes) reach from it."""
    root = np.arange(n)
    while len(links):
        a, b = root[links[:, 0]], root[links[:, 1]]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    return root


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of links (a, b) that reach a smaller node than themselves: the smallest.

    Stars are contracted in turn: all larger neighbours of a node are hung on its smallest one, then all smaller ones.
    """
    now = _settled(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = _settled(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column; none make an empty matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)) if len(flat) else np.zeros((0, 1))


def _near(v: np.ndarray, q: np.ndarray, most: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of unit vectors, and which of them lie within a cosine distance of which of ``q``: slice x ``q``.

    Products are taken in single precision; those that its rounding leaves in doubt, again in double.
    """
    one, two, step = v.astype(np.float32), np.ascontiguousarray(q.astype(np.float32).T), max(1, CELLS // max(1, len(q)))
    least, doubt = 1 - most, (v.shape[1] + 16) * 1.2e-7
    for a in range(0, len(v), step):
        at = slice(a, a + step)
        product = one[at] @ two
        near = product >= np.float32(least)
        # The two limits are wider than the doubt by a rounding at most.
        i, j = np.nonzero((product > least - doubt) & (product < least + doubt))
        for c in range(0, len(i), 10_000):
            x, y = i[c : c + 10_000], j[c : c + 10_000]
            near[x, y] = 1 - np.einsum("ij,ij->i", v[a + x], q[y]) <= most
        yield at, near


def _blocks(rows: DataFrame) -> list[DataFrame]:
    """Rows (node, ...) in blocks of about BLOCK, by a hash."""
    blocks = -(-rows.count() // BLOCK)
    return [rows.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == no) for no in range(blocks)]


def _against(rows: DataFrame, blocks: list[DataFrame], schema: str, meet: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    """``meet(batches, (nodes, n, unit vectors))`` of all rows (node, n, embedding) with each of the blocks, which are broadcast."""
    spark = rows.sparkSession
    # All blocks meet the same exchange, which gives every core some vectors however the files are cut.
    dealt = rows.repartition(2 * spark.sparkContext.defaultParallelism, "node")

    def run(block: DataFrame) -> DataFrame:
        some = block.toArrow()
        sent = spark.sparkContext.broadcast((*(some.column(c).to_numpy() for c in (0, 1)), _vectors(some.column(2))))
        return dealt.mapInArrow(lambda batches: meet(batches, sent.value) if len(sent.value[0]) else iter(()), schema)

    return reduce(DataFrame.unionByName, map(run, blocks), spark.createDataFrame([], schema))


def density_clusters(items: DataFrame, epsilon: float = 0.5, least: int = 5) -> DataFrame:
    """(contract_id, pos, cluster_id, dense) of every usable row (contract_id, pos, embedding).

    ``cluster_id`` is the smallest hash of a vector of the cluster; ``dense``: whether it is one by density.
    """
    most = epsilon * epsilon / 2
    rows = items.where(vectors.usable(F.col("embedding"))).select("contract_id", "pos", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("node", F.xxhash64("embedding"))
    heads = _settled(rows.groupBy("node").agg(F.count("*").alias("n"), F.first("embedding").alias("embedding")))

    def own_counts(batches: Iterator[pa.RecordBatch], block: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        _, times, q = block
        kind = np.float32 if times.sum() < 1 << 24 else np.float64
        for batch in batches:
            near = np.zeros(batch.num_rows, dtype=np.int64)
            for at, within in _near(_vectors(batch.column(2)), q, most):
                near[at] = within.astype(kind) @ times.astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near)], names=["node", "near"])

    def counts(batches: Iterator[pa.RecordBatch], block: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        nodes, _, q = block
        near = np.zeros(len(nodes))
        for batch in batches:
            times = batch.column(1).to_numpy()
            # Sums of whole numbers that single precision holds are exact in it.
            kind = np.float32 if times.sum() < 1 << 24 else np.float64
            for at, within in _near(_vectors(batch.column(2)), q, most):
                near += times[at].astype(kind) @ within.astype(kind)
        seen = near > 0
        yield pa.RecordBatch.from_arrays([pa.array(nodes[seen]), pa.array(near[seen].astype(np.int64))], names=["node", "near"])

    def joined(batches: Iterator[pa.RecordBatch], block: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        nodes, _, q = block
        for batch in batches:
            own = batch.column(0).to_numpy()
            names, at = np.unique(np.concatenate((nodes, own)), return_inverse=True)
            root, there, here = np.arange(len(names)), at[: len(nodes)], at[len(nodes) :]
            for part, within in _near(_vectors(batch.column(2)), q, most):
                # Only links between parts that are not yet joined change anything.
                i, j = np.nonzero(within & (root[here[part], None] != root[None, there]))
                if len(i):
                    root = _roots(np.stack([root[here[part]][i], root[there][j]], axis=1), len(names))[root]
            linked = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[root[linked]])], names=["a", "b"])

    nears, links = "node long, near long", "a long, b long"
    blocks = _blocks(heads)
    dense = _settled(_against(heads, blocks[:1], nears, own_counts).where(F.col("near") >= least).select("node"))
    if len(blocks) > 1:
        rest = _settled(heads.join(dense, "node", "left_anti"))
        near = _against(heads, _blocks(rest), nears, counts).groupBy("node").agg(F.sum("near").alias("near"))
        dense = dense.unionByName(near.where(F.col("near") >= least).select("node"))
    core = _settled(heads.join(dense, "node", "left_semi"))
    blocks = _blocks(core)
    root = components(_against(core, blocks[:1], links, joined))
    if len(blocks) > 1:
        stars = _settled(core.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
        largest = stars.groupBy("root").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "root").first()["root"]
        more = _against(core, _blocks(_settled(stars.where(F.col("root") != largest).drop("root"))), links, joined)
        root = components(more.unionByName(stars.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = core.select("node", "n").join(root, "node", "left").select("node", "n", F.coalesce("root", "node").alias("cluster_id"))
    large = named.groupBy("cluster_id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("cluster_id")
    clusters = named.join(large, "cluster_id", "left_semi").select("node", "cluster_id")
    return rows.join(clusters, "node", "left").select("contract_id", "pos", F.coalesce("cluster_id", "node").alias("cluster_id"), F.col("cluster_id").isNotNull().alias("dense"))


def nearest_clusters(items: DataFrame, clusters: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    """(query_id, query_pos, cluster_id, distance): the clusters of the k nearest distinct vectors of each query, written as a table.

    ``clusters``: (contract_id, pos, cluster_id) of the items, as ``density_clusters`` gives.
    """
    key = ["contract_id", "pos"]
    distinct = items.groupBy("embedding").agg(F.min(F.struct(*key)).alias("first")).select("first.contract_id", "first.pos", "embedding")
    return _settled(nearest.nearest_items(distinct, queries, k).join(clusters.select(*key, "cluster_id"), key).select("query_id", "query_pos", "cluster_id", "distance"))


def with_members(found: DataFrame, clusters: DataFrame) -> DataFrame:
    """(query_id, query_pos, contract_id, pos, cluster_id, distance): rows (query_id, query_pos, cluster_id, distance) with all members of their clusters."""
    key = ["contract_id", "pos"]
    # Most queries may lead to one cluster, so they go to its members. These are few bytes, but become many rows: every core gets some.
    members = clusters.select(*key, "cluster_id").repartition(2 * clusters.sparkSession.sparkContext.defaultParallelism, *key)
    pairs = nearest.in_blocks(found, ["query_id"], lambda some: members.join(some, "cluster_id"))
    return pairs.select("query_id", "query_pos", *key, "cluster_id", "distance")


def density_nearest(items: DataFrame, clusters: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    """(query_id, query_pos, contract_id, pos, cluster_id, distance): the clusters of the k nearest distinct vectors of each
    query, with all their members at the distance of the vector that led to them."""
    return with_members(nearest_clusters(items, clusters, queries, k), clusters)
