"""The best contracts by fused components against the scores of all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import similarity

ITEM, PLACE = "contract_id long, pos long, embedding array<double>", "contract_id long, lat double, lon double"


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)

    def vector():
        return [round(rng.gauss(0, 1), 2) for _ in range(5)]

    items = [(c, p, vector()) for c in range(60) for p in range(rng.randrange(1, 6))]
    items += [(100, p, vector()) for p in range(90)] + [(c, 0, [1.0, 0.0, 0.0, 0.0, 0.0]) for c in range(200, 215)]
    items += [(100, 90 + p, [0.5, -1.0, 0.25, 0.0, 2.0]) for p in range(40)]
    items += [(300, 0, None), (301, 0, [0.0] * 5), (302, 0, [float("nan")] * 5)]
    entity = [(rng.randrange(5), p, vector()) for p in range(80)]
    places = [(rng.randrange(90), 50 + rng.uniform(-0.2, 0.2), 14 + rng.uniform(-0.2, 0.2)) for _ in range(150)] + [(300, 0.0, 0.0), (301, None, 1.0)]
    asked = [(q, p, vector()) for q in range(20) for p in range(1 + q % 3)] + [(50, 0, [1.0, 0.0, 0.0, 0.0, 0.0])]
    where = [(q, 50 + rng.uniform(-0.2, 0.2), 14.0) for q in range(10, 30)]
    query = ITEM.replace("contract_id", "query_id").replace("pos", "query_pos")
    return {
        "subject": (spark.createDataFrame(items, ITEM), spark.createDataFrame(asked, query)),
        "locality": (spark.createDataFrame(places, PLACE), spark.createDataFrame(where, PLACE.replace("contract_id", "query_id"))),
        "entity_subject": (spark.createDataFrame(entity, ITEM), spark.createDataFrame(asked, query)),
    }


def rounded(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "contract_id", F.round("similarity", 7).alias("s")).collect())


@pytest.mark.parametrize("parts", [("subject", "locality", "entity_subject"), ("subject", "locality"), ("locality",), ("entity_subject",)])
@pytest.mark.parametrize("pack, block", [(1024, 4096), (4, 7)])
def test_best_contracts_are_those_of_all_pairs(sides, monkeypatch, parts, pack, block):
    monkeypatch.setattr(similarity, "PACK", pack)
    monkeypatch.setattr(similarity, "BLOCK", block)
    every = {name: similarity.by_place(*sides[name]) if name == "locality" else similarity.by_items(*sides[name]) for name in parts}
    want = similarity.top(similarity.fused(every), 8)
    assert rounded(similarity.fused_top({name: sides[name] for name in parts}, 8)) == rounded(want)


def test_shuffles_no_row_for_each_pair(spark, monkeypatch):
    """With k results of one query, a task sends k rows."""
    items = spark.createDataFrame([(c, 0, [float(c % 7) + 1, 1.0]) for c in range(500)], ITEM)
    asked = spark.createDataFrame([(1, 0, [1.0, 1.0])], ITEM.replace("contract_id", "query_id"))
    sent = []
    top = similarity.top
    monkeypatch.setattr(similarity, "top", lambda rows, k: sent.append(rows.count()) or top(rows, k))
    similarity.fused_top({"subject": (items, asked)}, 3).count()
    assert sent[0] <= 3 * spark.sparkContext.defaultParallelism * 4


def test_nothing_to_score(sides):
    items, asked = sides["subject"]
    assert similarity.fused_top({"subject": (items.limit(0), asked)}, 3).count() == 0
    assert similarity.fused_top({"subject": (items, asked.limit(0))}, 3).count() == 0


@pytest.mark.parametrize("pack, cells", [(1024, 500_000), (3, 40)])
def test_sums_of_items_are_those_of_all_pairs(sides, monkeypatch, pack, cells):
    monkeypatch.setattr(similarity, "PACK", pack)
    monkeypatch.setattr(similarity.nearest, "CELLS", cells)
    items, asked = sides["subject"]
    s = F.col("similarity")
    want = similarity.item_similarities(items, asked).groupBy("query_id", "contract_id").agg(F.sum(s * s).alias("s2"), F.sum(s).alias("s1"))
    plain = lambda df: sorted(tuple(r) for r in df.select("query_id", "contract_id", F.round("s2", 7), F.round("s1", 7)).collect())
    assert plain(similarity.item_sums(items.repartition(3), asked)) == plain(want)


@pytest.mark.parametrize("parts", [("subject", "locality", "entity_subject"), ("locality",)])
def test_places_alone_come_from_the_spatial_index(sides, monkeypatch, parts):
    """Contracts and queries without items are not scored with all others, and the best are the same."""
    want = rounded(similarity.fused_top({name: sides[name] for name in parts}, 8))
    scored, all_pairs = [], similarity._scored_top
    monkeypatch.setattr(similarity, "_scored_top", lambda c, *rest: scored.append(c["locality"]) or all_pairs(c, *rest))
    monkeypatch.setattr(similarity, "PAIRS", 0)
    assert rounded(similarity.fused_top({name: sides[name] for name in parts}, 8)) == want
    places, asked = sides["locality"]
    assert len(scored) == len(parts) // 2 and all(p.count() < places.count() and q.count() < asked.count() for p, q in scored)
