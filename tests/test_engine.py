"""The engine's answers in plain numpy, with vectors that stand for a model's and places for a geocoder's; the seeded bulk case."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.functions import vectors
from tributary.operators import contexts, nearest
from tributary.plans.search import SearchEngine

ITEMS = {0: ["výpočetní technika", "počítače"], 1: ["elektrická energie", "plyn"], 2: ["školení logistiky", "dopravník"], 3: ["jablka", "hrušky"], 4: ["stavba školy"], 5: ["početní technika"]}
ENTITY_ITEMS = {0: ["obchod s elektronikou"], 1: ["energetický poskytovatel"], 2: ["školení logistiky"], 3: ["pěstování plodin"], 4: ["správa města"], 5: ["obchod s alektronikou"]}
PLACES = {0: (50.609, 15.507), 1: (50.088, 14.434), 2: (49.823, 18.190), 3: (50.588, 15.127), 4: (50.609, 15.507), 5: (50.627, 15.609)}
ADDRESSES = {"Jičín": (50.437, 15.351), "Jilemnice": (50.609, 15.507), "Vrchlabí": (50.627, 15.609)}


def vector(text: str) -> np.ndarray:
    """Counts of pairs of letters: texts that look alike lie near."""
    out = np.zeros(40)
    for a, b in zip(f" {text}", f"{text} "):
        out[(ord(a) * 31 + ord(b)) % 40] += 1
    return out


@pytest.fixture(scope="module")
def engine(spark):
    rows = lambda lists: spark.createDataFrame([(c, [float(x) for x in vector(t)]) for c, texts in lists.items() for t in texts], "contract_id long, embedding array<double>")
    words = sorted({t for lists in (ITEMS, ENTITY_ITEMS) for texts in lists.values() for t in texts} | {"notebook", ""})
    known = spark.createDataFrame([(t, [float(x) for x in vector(t)]) for t in words if t], "item string, embedding array<double>")
    located = spark.createDataFrame([(a, *p) for a, p in ADDRESSES.items()], "address string, lat double, lon double")
    places = spark.createDataFrame([(c, *p) for c, p in PLACES.items()], "contract_id long, lat double, lon double")
    return SearchEngine(rows(ITEMS), places, rows(ENTITY_ITEMS), embed=lambda r: r.join(known, "item"), locate=lambda r: r.join(located, "address"), num_results=2)


def by_items(lists, texts: list[str]) -> dict[int, float]:
    out = {}
    for c, own in lists.items():
        s = [(1 + vector(t) @ vector(o) / np.linalg.norm(vector(t)) / np.linalg.norm(vector(o))) / 2 for t in texts for o in own]
        out[c] = sum(x * x for x in s) / sum(s)
    return out


def by_place(point) -> dict[int, float]:
    km = {c: math.hypot((p[0] - point[0]) * 111.319, (p[1] - point[1]) * 71.941) for c, p in PLACES.items()}
    return {c: 1.0 if d <= 0 else min(1.0, 1 / math.log1p(d)) for c, d in km.items()}


def fused(parts: dict[str, dict[int, float]]) -> dict[int, float]:
    weights = {"subject": 1.0, "locality": 0.1, "entity_subject": 0.1}
    return {c: sum(weights[n] * p[c] for n, p in parts.items()) / sum(weights[n] for n in parts) for c in ITEMS}


def best(scores: dict[int, float], k: int = 2) -> list[tuple[int, float]]:
    return [(c, round(s, 9)) for c, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]


def said(df, query: int = 1) -> list[tuple[int, float]]:
    return [(r["contract_id"], round(r["similarity"], 9)) for r in df.where(F.col("query_id") == query).orderBy("rank").collect()]


def one(spark, name: str, value: str):
    return spark.createDataFrame([(1, value)], f"query_id long, {name} string")


def test_queries_by_one_component(spark, engine):
    found = said(engine.query_by_subject(one(spark, "text", "notebook")))
    assert found == best(by_items(ITEMS, ["notebook"]))
    assert said(engine.query_by_address(one(spark, "address", "Jičín"))) == best(by_place(ADDRESSES["Jičín"]))
    found = said(engine.query_by_entity_subject(one(spark, "text", "obchod s elektronikou")))
    assert found == best(by_items(ENTITY_ITEMS, ["obchod s elektronikou"])) and found[0] == (0, 1.0)
    assert said(engine.query_by_subject(one(spark, "text", "nobody knows this"))) == []


@pytest.mark.parametrize("address", ["Jilemnice", "Vrchlabí"])
def test_query_by_all_components(spark, engine, address):
    texts = ["výpočetní technika", "obchod s elektronikou"]
    found = said(engine.query(one(spark, "text", texts[0]), one(spark, "address", address), one(spark, "text", texts[1])))
    assert found == best(fused({"subject": by_items(ITEMS, texts), "locality": by_place(ADDRESSES[address]), "entity_subject": by_items(ENTITY_ITEMS, texts)}))
    alone = said(engine.query(one(spark, "text", texts[0]), None, one(spark, "text", texts[1]), isolate=True))
    assert alone == best(fused({"subject": by_items(ITEMS, texts[:1]), "entity_subject": by_items(ENTITY_ITEMS, texts[1:])}))


def test_queries_by_profiles_and_their_sections(spark, engine):
    profiles = {13: (["stavba školy"], "Jilemnice"), 14: (["plyn", "jablka"], "Jičín"), 16: (["dopravník"], "Vrchlabí")}
    items = spark.createDataFrame([(u, [float(x) for x in vector(t)]) for u, (texts, _) in profiles.items() for t in texts], "query_id long, embedding array<double>")
    places = spark.createDataFrame([(u, k, *p) for u, (_, a) in profiles.items() for k, p in enumerate((ADDRESSES[a], (0.1, 0.2)))], "query_id long, pos int, lat double, lon double")
    parts = {u: {"subject": by_items(ITEMS, t), "locality": by_place(ADDRESSES[a]), "entity_subject": by_items(ENTITY_ITEMS, t)} for u, (t, a) in profiles.items()}
    found = engine.query_by_user_profile(items, places)
    for u, mine in parts.items():
        assert said(found, u) == best(fused(mine))
    for name, rows in engine.sections(items, places).items():
        for u, mine in parts.items():
            assert said(rows, u) == best(fused(mine if name == "all" else {name: mine[name]})), name


def test_the_seeded_bulk_case_keeps_its_published_distance(spark):
    np.random.seed(42)
    drawn = [[[np.random.rand(300) for _ in range(np.random.randint(0, 20))] for _ in range(n)] for n in (1000, 100)]
    frame = lambda rows, key, pos: spark.createDataFrame([(i, k, [float(x) for x in v]) for i, vs in enumerate(rows) for k, v in enumerate(vs)], f"{key} long, {pos} long, embedding array<double>")
    items, queries = frame(drawn[0], "contract_id", "pos"), frame(drawn[1][:3], "query_id", "query_pos")
    for search in (nearest.nearest_items, nearest.nearest_items_block):
        first = search(items, queries, 1).where("query_id = 0 and query_pos = 0").first()
        assert math.isclose(first["distance"], 0.19712971175935512, rel_tol=1e-12)


def test_opposite_points_are_not_lost_and_not_nearest(spark):
    places = spark.createDataFrame([(1, 0.0, 179.7), (2, 0.1, 0.1), (3, None, 1.0), (4, float("nan"), 1.0), (5, 0.0, 0.0)], "contract_id long, lat double, lon double")
    query = spark.createDataFrame([(7, 0.0, 0.001)], "query_id long, lat double, lon double")
    found = [(r["contract_id"], r["distance"]) for r in nearest.nearest_places(places, query, 5, "geodesic").orderBy("rank").collect()]
    assert [c for c, _ in found] == [2, 1] and 15 < found[0][1] < 16 and 19_900 < found[1][1] < 20_100


def test_hashed_embeddings_are_stable(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string").select(vectors.hashed_embedding(F.col("t"), 3).alias("e")).collect()
    assert rows[0]["e"] == rows[1]["e"] != rows[2]["e"] and all(0 <= x < 1 for r in rows for x in r["e"])


CUT = "\n4. Předmět smlouvy\nDodávka strojů.\n5. Cena díla\nSto korun.\n"


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        (CUT, CUT.index("Předmět"), CUT.index("\n5.")),
        ("\n12/2020 Předmět\ntext\n13. Cena\n", 9, len("\n12/2020 Předmět\ntext")),
        ("\n12Předmět bez mezery\n2. nikoli\n13. Cena\n", 3, len("\n12Předmět bez mezery\n2. nikoli")),
        ("\n1\n2. Předmět\ntext\n3. Cena\n", 6, len("\n1\n2. Předmět\ntext")),
        ("\nII. Předmět\ntext\nIII. Cena\n", 5, len("\nII. Předmět\ntext")),
        ("ČLÁNEK 1\nPředmět je toto.\nČlánek 2\nCena", 9, len("ČLÁNEK 1\nPředmět je toto.\n")),
        ("PŘEDMĚT SMLOUVY\nmalá písmena.\nCENA DÍLA\n100", 0, len("PŘEDMĚT SMLOUVY\nmalá písmena.\n")),
        ("Název veřejné zakázky:\nkrátké\nDodávka strojů a zařízení pro obec\nkonec", 6, len("Název veřejné zakázky:\nkrátké\nDodávka strojů a zařízení pro obec")),
        ("na akci „Oprava mostu“ a další text", 0, len("na akci „Oprava mostu“")),
        ("Předmět je dodávka.\nDoba plnění\nMísto plnění", 0, len("Předmět je dodávka.\n")),
        ("Předmět je dodávka\n<FILE id=2>\nx", 0, len("Předmět je dodávka\n")),
        ("bez konce " * 1000, 10, 10 + 3 * 2040),
    ],
)
def test_contexts_end_where_rules_say(text, start, end):
    assert contexts.context_end(text, start) == end
