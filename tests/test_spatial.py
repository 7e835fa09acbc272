"""The spatial index against distances to all places."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import nearest, similarity, spatial

KINDS = ("planar", "great_circle", "geodesic")


def globe(seed: int, n: int) -> list[tuple[int, float, float]]:
    """Places all over, some crowded, some at the poles and on both sides of the date line."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.randrange(6)
        lat, lon = {0: (rng.uniform(-90, 90), rng.uniform(-180, 180)), 1: (50 + rng.gauss(0, 0.01), 14 + rng.gauss(0, 0.01)), 2: (rng.choice([-90.0, 90.0, 89.9]), rng.uniform(-180, 180)), 3: (rng.uniform(-5, 5), rng.choice([179.9, -179.9, 180.0, -180.0]))}.get(kind, (49.5, 17.25))
        rows.append((i, lat, lon))
    return rows


def everything(spark, places, queries, k, kind):
    pairs = nearest.location_distances(places, queries, kind)
    return sorted(tuple(r) for r in nearest.top_k(nearest.usable(pairs, "distance"), F.round("distance", 9).asc(), k, ["query_id"], ["contract_id"]).select("query_id", "rank", "contract_id").collect())


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("leaf", [4, 512])
def test_nearest_places_are_those_of_all_distances(spark, monkeypatch, kind, leaf):
    monkeypatch.setattr(spatial, "LEAF", leaf)
    places = spark.createDataFrame([*globe(1, 400), (900, None, 1.0), (901, 0.0, 0.0), (902, float("nan"), 2.0)], "contract_id long, lat double, lon double")
    queries = spark.createDataFrame([*globe(2, 60), (99, None, None)], "query_id int, lat double, lon double")
    found = nearest.nearest_places(places, queries, 7, kind)
    assert dict(found.dtypes)["query_id"] == "int"
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "contract_id").collect()) == everything(spark, places, queries, 7, kind)


def test_bounds_hold_for_every_place():
    rng = np.random.default_rng(3)
    for _ in range(300):
        south, west = rng.uniform(-90, 85), rng.uniform(-180, 170)
        north, east = min(90, south + rng.exponential(10)), min(180, west + rng.exponential(40))
        lat, lon = rng.uniform(south, north, 50), rng.uniform(west, east, 50)
        qlat, qlon = rng.uniform(-90, 90, 1), rng.uniform(-180, 180, 1)
        box = spatial.Boxes(*(np.array([x]) for x in (0, 50, south, north, west, east)))
        for kind, measure in (("planar", spatial.planar), ("great_circle", spatial.circle)):
            low, high = box.bounds(qlat, qlon, kind)
            d = measure(lat, lon, qlat, qlon)
            assert low[0, 0] <= d.min() + 1e-6 and d.max() <= high[0, 0] + 1e-6


def test_few_places_are_measured(spark):
    places = spark.createDataFrame([(i, 48 + i % 200 / 100, 12 + i // 200 / 100) for i in range(20_000)], "contract_id long, lat double, lon double")
    queries = spark.createDataFrame([(q, 48.5 + q / 50, 12.3 + q / 100) for q in range(30)], "query_id long, lat double, lon double")
    for kind in KINDS:
        assert spatial.candidates(places, queries, 5, kind).count() < 30 * 20_000 / 100


def test_a_crowded_point_gives_its_first_ids(spark):
    places = spark.createDataFrame([(i, 50.0, 14.0) for i in range(3000)] + [(5000, 50.001, 14.0)], "contract_id long, lat double, lon double")
    queries = spark.createDataFrame([(1, 50.0, 14.0)], "query_id long, lat double, lon double")
    near = spatial.candidates(places, queries, 3)
    assert near.count() <= 4
    assert [r["contract_id"] for r in nearest.nearest_places(places, queries, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_similar_places_tie_within_the_level(spark, monkeypatch):
    """Places closer than e - 1 km are all alike, so the smallest ids win; contracts with several places count once."""
    monkeypatch.setattr(spatial, "LEAF", 8)
    rng = random.Random(5)
    rows = [(rng.randrange(120), 50 + rng.uniform(-0.05, 0.05), 14 + rng.uniform(-0.05, 0.05)) for _ in range(400)]
    places = spark.createDataFrame(rows, "contract_id long, lat double, lon double")
    queries = spark.createDataFrame([(q, 50 + rng.uniform(-0.1, 0.1), 14.0) for q in range(25)], "query_id long, lat double, lon double")
    want = similarity.top(similarity.by_place(places, queries), 6)
    got = similarity.top_by_place(places, queries, 6)
    columns = ["query_id", "rank", "contract_id", F.round("similarity", 9).alias("s")]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_nothing_to_find(spark):
    some = spark.createDataFrame([(1, 50.0, 14.0)], "contract_id long, lat double, lon double")
    asked = some.withColumnRenamed("contract_id", "query_id")
    assert nearest.nearest_places(some.limit(0), asked, 3).count() == 0
    assert nearest.nearest_places(some, asked.limit(0), 3).count() == 0
    assert similarity.top_by_place(some.limit(0), asked).count() == 0
    assert nearest.nearest_places(some, asked, 3).count() == 1
