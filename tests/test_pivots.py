"""The metric index and clusters by density against all pairs."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

from tributary.operators import cluster, density, nearest, pivots

ITEM, QUERY = "contract_id long, pos long, embedding array<double>", "query_id long, query_pos long, embedding array<double>"


def groups(seed: int, n: int, dims: int = 8, spread: float = 0.05, centres: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(99).normal(size=(centres, dims))
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * spread


def frame(spark, v: np.ndarray, kind: str):
    return spark.createDataFrame([(k // 3, k % 3, [float(x) for x in row]) for k, row in enumerate(v)], kind)


def ranked(df):
    return sorted(tuple(r) for r in df.select("query_id", "query_pos", "rank", "contract_id", "pos", F.round("distance", 7).alias("d")).collect())


def everything(items, queries, k, metric):
    pairs = nearest.vector_distances(items, queries, metric)
    return ranked(nearest.top_k(pairs, F.round("distance", 9).asc(), k, ["query_id", "query_pos"], ["contract_id", "pos"]))


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_indexed_neighbours_are_those_of_all_pairs(spark, monkeypatch, metric):
    for name, value in (("CELL", 20), ("RING", 16), ("PORTION", 8), ("_CUBE", 100)):
        monkeypatch.setattr(pivots, name, value)
    v = np.concatenate([groups(1, 300), np.repeat(groups(2, 1), 60, axis=0), np.random.default_rng(3).normal(size=(40, 8))])
    odd = [(500, 0, None), (501, 0, [0.0] * 8), (502, 0, [float("nan")] * 8)]
    items = frame(spark, v, ITEM).unionByName(spark.createDataFrame(odd, ITEM))
    queries = frame(spark, np.concatenate([groups(4, 20), v[300:303]]), QUERY)
    for k in (1, 7):
        want = everything(items, queries, k, metric)
        assert ranked(nearest.nearest_items_indexed(items, queries, k, metric)) == want
        assert ranked(nearest.nearest_items(items, queries, k, metric)) == want
    few = frame(spark, v[:4], ITEM)
    assert ranked(nearest.nearest_items_indexed(few, queries, 9, metric)) == everything(few, queries, 9, metric)


def test_most_pairs_are_left_out_where_vectors_form_groups(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CELL", 60)
    monkeypatch.setattr(pivots, "RING", 32)
    items, queries = frame(spark, groups(5, 3000, centres=40), ITEM), frame(spark, groups(6, 60, centres=40), QUERY)
    share = pivots.Index(items).compared(queries, 5)
    assert share < 0.2, share


def test_bounds_are_below_all_distances(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CELL", 20)
    monkeypatch.setattr(pivots, "RING", 8)
    v = groups(7, 200)
    q = np.concatenate([groups(8, 10), np.random.default_rng(9).normal(size=(10, 8))])
    for metric in ("cosine", "euclidean", "manhattan"):
        index = pivots.Index(frame(spark, v, ITEM), metric)
        rings = index.sent.value
        low = rings.bounds(q, metric)
        for r in index.rings.collect():
            d = pivots.distances(np.array(r["vectors"]).reshape(r["n"], -1), q, metric)
            assert (low[:, rings.ring == r["ring"]] <= d.min(axis=1, keepdims=True) + 1e-9).all()
        assert rings.n.sum() == 200 and rings.n.max() <= 8


def test_nothing_to_index(spark):
    items, queries = frame(spark, groups(1, 5), ITEM), frame(spark, groups(2, 2), QUERY)
    assert nearest.nearest_items_indexed(items.limit(0), queries, 2).count() == 0
    assert nearest.nearest_items_indexed(items, queries.limit(0), 2).count() == 0


def plain_clusters(v: np.ndarray, epsilon: float, least: int) -> list[set[int]]:
    """Sets of places that share a cluster, by all pairs."""
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = 1 - unit @ unit.T <= epsilon * epsilon / 2
    core = near.sum(axis=1) >= least
    label = np.full(len(v), -1)
    for k in np.flatnonzero(core):
        if label[k] < 0:
            stack = [k]
            while stack:
                x = stack.pop()
                if label[x] < 0:
                    label[x] = k
                    stack += np.flatnonzero(near[x] & core & (label < 0)).tolist()
    out: dict = {}
    for k in range(len(v)):
        large = label[k] >= 0 and (label == label[k]).sum() >= least
        out.setdefault(("dense", label[k]) if large else ("equal", v[k].tobytes()), set()).add(k)
    return list(out.values())


@pytest.mark.parametrize(("epsilon", "least"), [(0.1, 5), (0.05, 3), (0.3, 8)])
def test_clusters_are_those_of_all_pairs(spark, monkeypatch, epsilon, least):
    for name, value in (("CELL", 40), ("RING", 16), ("PORTION", 32), ("_CUBE", 200)):
        monkeypatch.setattr(pivots, name, value)
    v = np.concatenate([groups(11, 400, spread=0.03), np.random.default_rng(12).normal(size=(60, 8)), np.repeat(groups(13, 1), 30, axis=0), np.repeat(np.random.default_rng(14).normal(size=(3, 8)), 2, axis=0), groups(15, 10)[:, :] * 2.0])
    found: dict = {}
    for r in density.density_clusters(frame(spark, v, ITEM), epsilon, least).collect():
        found.setdefault(r["cluster_id"], set()).add(r["contract_id"] * 3 + r["pos"])
    want = plain_clusters(v, epsilon, least)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want))
    assert max(map(len, want)) >= least


def test_components_of_a_chain_a_star_and_a_ring(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(7, 7)]
    found = dict(map(tuple, density.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {k: 0 for k in range(1, 301)} | {1000 + k: 1000 for k in range(1, 200)} | {2000 + k: 2000 for k in range(1, 50)}
    assert density.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_local_roots_are_components():
    rng = np.random.default_rng(16)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        links = rng.integers(0, n, size=(int(rng.integers(0, 40)), 2))
        root = density._roots(links, n)
        assert all(root[a] == root[b] for a, b in links) and all(root[root[k]] == root[k] <= k for k in range(n))
        want = n
        reach = np.eye(n, dtype=bool)
        for a, b in links:
            reach[a, b] = reach[b, a] = True
        for _ in range(n):
            reach = reach @ reach
        want = len({tuple(r) for r in reach})
        assert len(set(root.tolist())) == want


def test_nearest_through_clusters_brings_all_members(spark):
    v = np.concatenate([groups(17, 60, spread=0.01, centres=3), np.random.default_rng(18).normal(size=(5, 8))])
    items = frame(spark, v, ITEM)
    clusters = density.density_clusters(items, 0.2, 5)
    of = {(r["contract_id"], r["pos"]): r["cluster_id"] for r in clusters.collect()}
    found = density.density_nearest(items, clusters, frame(spark, v[:1], QUERY)).collect()
    assert {(r["contract_id"], r["pos"]) for r in found} == {key for key, c in of.items() if c == of[0, 0]} and len(found) > 5
    assert {round(r["distance"], 9) for r in found} == {0.0}


def test_a_task_holds_few_distances_whatever_the_batch(spark, monkeypatch):
    """The block search takes items by slices, so what it holds grows neither with a batch nor with the items."""
    monkeypatch.setattr(nearest, "CELLS", 60)
    items, queries = frame(spark, np.concatenate([groups(8, 200), np.repeat(groups(9, 1), 90, axis=0)]), ITEM), frame(spark, groups(9, 12), QUERY)
    for k in (1, 7, 400):
        assert ranked(nearest.nearest_items_block(items, queries, k)) == everything(items, queries, k, "cosine")


def test_distances_that_are_no_number_hide_no_neighbour(spark, monkeypatch):
    """A vector with infinity has no distance; where it comes first, those after it are found all the same."""
    monkeypatch.setattr(nearest, "CELLS", 1)
    endless = [float("inf")] * 8
    rows = [(k, 0, endless if k < 3 else [float(x) for x in v]) for k, v in enumerate(groups(10, 9))]
    items, queries = spark.createDataFrame(rows, ITEM).coalesce(1), frame(spark, groups(11, 4), QUERY).unionByName(spark.createDataFrame([(50, 0, endless)], QUERY))
    for metric in ("cosine", "euclidean"):
        for k in (1, 2, 9):
            found = ranked(nearest.nearest_items_block(items, queries, k, metric))
            assert found == everything(items, queries, k, metric)
            assert sum(f[0] < 50 for f in found) == 4 * min(k, 6 if metric == "cosine" else 9)


def test_a_query_of_many_vectors_is_taken_in_blocks(spark, monkeypatch):
    """All queries' vectors count for a block's size, also where one query has them all."""
    items, queries = frame(spark, groups(8, 60), ITEM), frame(spark, groups(9, 90), QUERY).withColumn("query_pos", F.expr("query_id * 3 + query_pos")).withColumn("query_id", F.lit(7).cast("long"))
    want = everything(items, queries, 2, "cosine")
    least = {r[:2]: r[5] for r in want if r[2] == 1}
    sizes = []
    blocks = nearest.in_blocks
    monkeypatch.setattr(nearest, "in_blocks", lambda df, key, run, **_: blocks(df, key, lambda block: sizes.append(block.count()) or run(block), rows=15))
    assert ranked(nearest.nearest_items_block(items, queries, 2)) == want
    assert sum(sizes) == 90 and max(sizes) < 45, sizes
    assert {(r[0], r[1]): round(r[2], 7) for r in nearest.least_distances(items, queries).collect()} == least
    assert ranked(nearest.top_k(nearest.vector_distances(items, queries), F.round("distance", 9).asc(), 2, ["query_id", "query_pos"], ["contract_id", "pos"])) == want
    assert sum(sizes) == 270 and max(sizes) < 45, sizes


def memory(kind: str) -> dict[int, float]:
    """MB of every Python worker below this process, now (VmRSS) or at most (VmHWM)."""
    workers = [p for p in psutil.Process().children(recursive=True) if "python" in p.name()]
    return {p.pid: int(re.search(rf"{kind}:\s+(\d+)", Path(f"/proc/{p.pid}/status").read_text())[1]) / 1e3 for p in workers}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_memory_of_workers_is_bounded(spark, metric):
    """10,000 items and 1,500 queries in one task: before tasks took slices, it held several arrays of all their distances."""
    vector = "transform(sequence(1, 4), x -> sin(id * x) + 2D) as embedding"
    items = spark.range(0, 10_000, 1, 1).selectExpr("id div 5 as contract_id", "id % 5 as pos", vector)
    queries = spark.range(1_500).selectExpr("id as query_id", "0L as query_pos", vector)
    arrays = [nearest.flattened(df.groupBy(key).agg(F.collect_list("embedding").alias("embeddings")), key) for df, key in ((items, "contract_id"), (queries, "query_id"))]
    before = memory("VmRSS")
    for pid in before:
        Path(f"/proc/{pid}/clear_refs").write_text("5")
    for search in (nearest.nearest_items, nearest.nearest_items_block):
        assert search(items, queries, 3, metric).count() == 4_500
    assert nearest.nearest_items(arrays[0].coalesce(1), arrays[1].withColumnRenamed("pos", "query_pos"), 3, metric).count() == 4_500
    assert (grown := {pid: most - before.get(pid, 0) for pid, most in memory("VmHWM").items()}) and max(grown.values()) < 400, grown


def test_link_counts_are_those_of_all_pairs_and_send_no_pair(spark, monkeypatch):
    v = np.concatenate([groups(12, 150, centres=6), np.repeat(groups(13, 1), 40, axis=0), np.eye(8)[:2] * 0.3, np.eye(8)[:1] * 0.7])
    ids = [*range(len(v) - 1), 3]
    rows = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in zip(ids, v, strict=True)] + [(900, None), (901, [0.0] * 8)], "vec_id long, embedding array<double>").repartition(3)
    for epsilon in (0.2, 0.4):
        links = cluster.epsilon_links(rows, epsilon).select("a", "b").collect()
        want: dict[int, int] = {}
        for k in (k for link in links for k in link):
            want[k] = want.get(k, 0) + 1
        for size, cells in ((16_384, 1_000_000), (50, 300)):
            monkeypatch.setattr(cluster, "BLOCK", size)
            monkeypatch.setattr(cluster, "_CELLS", cells)
            found = cluster.epsilon_link_counts(rows, epsilon)
            assert {r["vec_id"]: r["n_links"] for r in found.collect()} == want and want
            assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("epsilon", "least"), [(0.1, 5), (0.3, 8)])
def test_density_clusters_come_from_blocks_and_shuffle_no_vector_for_a_meeting(spark, monkeypatch, epsilon, least):
    """Vectors met in the rings of the index before, to which random ones travelled in the square of their number."""
    monkeypatch.setattr(density, "BLOCK", 50)
    monkeypatch.setattr(density, "CELLS", 300)
    monkeypatch.setattr(pivots, "Index", None)
    v = np.concatenate([groups(21, 160, spread=0.03), np.random.default_rng(22).normal(size=(40, 8)), np.repeat(groups(23, 1), 12, axis=0)])
    found: dict = {}
    for r in density.density_clusters(frame(spark, v, ITEM), epsilon, least).collect():
        found.setdefault(r["cluster_id"], set()).add(r["contract_id"] * 3 + r["pos"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, plain_clusters(v, epsilon, least)))


def test_dense_vectors_of_one_cluster_do_not_meet_every_block(spark, monkeypatch):
    """All vectors were broadcast in both passes before, whatever the first block had shown of them."""
    monkeypatch.setattr(density, "BLOCK", 50)
    v = np.concatenate([groups(28, 400, spread=0.01, centres=1), groups(29, 60, spread=0.01, centres=1), np.random.default_rng(30).normal(size=(20, 8))])
    rows, sent = frame(spark, v, ITEM), []
    plain = type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda df: (sent.append(got := plain(df)), got)[1])
    found: dict = {}
    for r in density.density_clusters(rows, 0.2, 5).collect():
        found.setdefault(r["cluster_id"], set()).add(r["contract_id"] * 3 + r["pos"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, plain_clusters(v, 0.2, 5)))
    assert sum(x.num_rows for x in sent) < 300 < len(v)


def test_queries_go_to_the_members_of_their_clusters(spark):
    """All queries may lead to one cluster, whose members then must not meet in one task."""
    items = frame(spark, groups(24, 60, spread=0.01, centres=1), ITEM)
    found = density.density_nearest(items, density.density_clusters(items, 0.2, 5), frame(spark, groups(25, 4, spread=0.01, centres=1), QUERY))
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert "strategy=broadcast" in joins[0] and found.count() == 240, joins


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_least_distances_are_those_of_all_pairs_and_join_nothing(spark, monkeypatch, metric):
    monkeypatch.setattr(nearest, "CELLS", 60)
    odd = [(500, 0, None), (501, 0, [0.0] * 8), (502, 0, [float("nan")] * 8)]
    items = frame(spark, groups(26, 120), ITEM).unionByName(spark.createDataFrame(odd, ITEM))
    queries = frame(spark, np.concatenate([groups(27, 10), groups(26, 2)]), QUERY).unionByName(spark.createDataFrame(odd, QUERY))
    want = nearest.vector_distances(items, queries, metric).groupBy("query_id", "query_pos").agg(F.round(F.min("distance"), 7).alias("d"))
    found = nearest.least_distances(items, queries, metric)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.select("query_id", "query_pos", F.round("distance", 7)).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_full_order_is_that_of_all_pairs_and_no_join_makes_them(spark, monkeypatch, metric):
    monkeypatch.setattr(nearest, "CELLS", 60)
    v = np.concatenate([groups(1, 80), np.repeat(groups(2, 1), 9, axis=0)])
    w = np.concatenate([groups(4, 12), v[80:83]])
    odd = [(500, 0, None), (501, 0, [0.0] * 8), (502, 0, [float("nan")] * 8), (503, 0, [])]
    items = frame(spark, v, ITEM).unionByName(spark.createDataFrame(odd, ITEM))
    queries = frame(spark, w, QUERY).unionByName(spark.createDataFrame(odd, QUERY))
    found = nearest.nearest_items(items, queries, None, metric)
    assert "MapInArrow" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Join" not in plan
    want = []
    for j, q in enumerate(w):
        d = {"cosine": lambda x, y: 1 - x @ y / np.sqrt((x @ x) * (y @ y)), "euclidean": lambda x, y: np.sqrt(((x - y) ** 2).sum()), "manhattan": lambda x, y: np.abs(x - y).sum()}[metric]
        order = sorted((round(d(x, q), 9) + 0.0, k // 3, k % 3) for k, x in enumerate(v))
        want += [(j // 3, j % 3, rank, c, p, float(near)) for rank, (near, c, p) in enumerate(order, 1)]
    rows = sorted(tuple(r) for r in found.select("query_id", "query_pos", "rank", "contract_id", "pos", "distance").collect())
    assert [r[:5] for r in rows] == [r[:5] for r in want] and np.allclose([r[5] for r in rows], [r[5] for r in want], atol=1e-8)
    named = nearest.nearest_items(items.selectExpr("'c' || contract_id as name", "embedding"), queries.selectExpr("'q' || query_id || '.' || query_pos as asked", "embedding"), 1, metric, ("name",), ("asked",))
    near = {r["asked"]: r["distance"] for r in named.collect()}
    assert near.keys() == {f"q{a}.{b}" for a, b, *_ in want} and all(abs(near[f"q{a}.{b}"] - d) < 1e-8 for a, b, rank, _, _, d in want if rank == 1)
    assert nearest.nearest_items(items, queries.where("query_id = 500"), None, metric).count() == 0


def test_full_order_comes_from_arrays_of_distances(spark, monkeypatch):
    """Every pair was a row of the shuffle and of the sort before."""
    from tributary.plans import registry

    plan = registry.queries()["op_f2_full_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan, plan
    monkeypatch.setattr(nearest, "CELLS", 60)
    monkeypatch.setattr(nearest, "QUERY_VECTORS", 5)
    v = np.concatenate([groups(31, 80), np.repeat(groups(32, 1), 9, axis=0)])
    odd = [(500, 0, None), (501, 0, [0.0] * 8), (502, 0, [float("nan")] * 8), (503, 0, [])]
    items = frame(spark, v, ITEM).unionByName(spark.createDataFrame(odd, ITEM)).repartition(5)
    queries = frame(spark, np.concatenate([groups(33, 12), v[80:83]]), QUERY).unionByName(spark.createDataFrame(odd, QUERY))
    want = nearest.nearest_items(items, queries, None).drop("distance")
    rows = sorted(map(tuple, want.collect()))
    found = nearest.full_order(items, queries)
    assert found.schema.simpleString() == want.schema.simpleString() and sorted(map(tuple, found.collect())) == rows and len(rows) == 89 * 15
    assert nearest.full_order(items, queries.where("query_id = 500")).count() == nearest.full_order(items.limit(0), queries).count() == 0
    nameless = items.unionByName(spark.createDataFrame([(None, 0, [1.0] * 8)], ITEM))
    assert nearest.full_order(nameless, queries).where("contract_id is null").count() == 15
    monkeypatch.setattr(nearest, "WHOLE", 50)
    assert sorted(map(tuple, nearest.full_order(items, queries).collect())) == rows
