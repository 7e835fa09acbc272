"""Many keywords in one pass against a search for each."""

from __future__ import annotations

import random
import time

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from tributary.functions import keywords as K
from tributary.functions import text as T
from tributary.operators import contexts, evaluation
from tributary.plans import registry

WORDS = ["Předmět smlouvy", "předmět", "Cena", "a", "aa", "", "ŽLUŤOUČKÝ", "licence", "İstanbul", "smlouvy o"]
TEXTS = ["", None, "aaaaa aaAa", "PŘEDMĚT SMLOUVY o předmětu smlouvy o dílo", "žluťoučký kůň", "İ İstanbul istanbul", "x" * 5000 + "cena", "Licence licenceLICENCE"]


def searched(text, word, limit=None):
    """Places from the left, none overlapping the one before."""
    low, at, out = (text or "").replace("İ", "i").lower(), 0, []
    form = word.lower()
    while form and (at := low.find(form, at)) >= 0:
        out.append(at)
        at += len(form)
    return out if limit is None else out[:limit]


def test_all_hits_are_those_of_single_searches(spark):
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choice(["a", "A", " ", "cena", "Předmět ", "smlouvy ", "o ", "İ"]) for _ in range(rng.randrange(60))) for _ in range(100)]
    words = [w for w in WORDS if "İ" not in w]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    for limit in (None, 2):
        for r in df.select("k", K.hits(F.col("text"), words, limit).alias("h")).collect():
            want = sorted((w, p) for w in words for p in searched(texts[r["k"]], w, limit))
            assert sorted((h["keyword"], h["occ"]) for h in r["h"]) == want, texts[r["k"]]


def test_agrees_with_the_search_by_expressions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = ["license", "the", "de"]
    one = {(r["doc_id"], w, p) for w in words for r in df.select("doc_id", T.positions(F.col("text"), w, None).alias("p")).collect() for p in r["p"] or ()}
    many = {(r["doc_id"], r["keyword"], r["occ"]) for r in df.select("doc_id", F.inline(K.hits(F.col("text"), words))).collect()}
    assert one == many and one


def test_time_does_not_grow_with_the_number_of_keywords():
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = "".join(rng.choice(letters + " ") for _ in range(400_000))
    words = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(1000)]

    def seconds(some):
        automaton, began = K._automaton(some), time.process_time()
        for _ in range(5):
            K.found_in(text, automaton)
        return time.process_time() - began

    assert seconds(words) < 8 * seconds(words[:12]) + 0.5


def test_nothing_to_find(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert df.select(K.hits(F.col("text"), []).alias("h")).first()["h"] == []
    assert contexts.occurrences(df, {"slovo": 1.0}).count() == 0
    assert evaluation.concordances(df, ["t"], around=1).count() == 2


def test_starts_compare_rounded_scores(spark, monkeypatch):
    """A score that is two thirds of the best but for the last bit is not above them."""
    weights = [0.0] * 21
    weights[5], weights[15] = 0.45, 0.1 + 0.2
    rows = spark.createDataFrame([(1, k, w) for k, w in enumerate(weights)], "doc_id long, bin int, weight double")
    monkeypatch.setattr(contexts, "histogram", lambda *_: rows)
    assert [r["start"] for r in contexts.starts(rows).collect()] == [5 * 680]


@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        # The heading-like lines that make the highest edge come after 1,200 occurrences.
        ("op_i3_context_starts", {(1, 8840)}),
        ("op_i4_fixed_contexts", {(1, 8840)}),
        # In one window, the only line of its own is the 1,011th occurrence.
        ("op_i5_refined_starts", {(2, 2021)}),
    ],
)
def test_contexts_count_every_occurrence(spark, tmp_path, name, wanted):
    """Before, only the first 1,002 of a keyword counted in a text."""
    texts = ["none of them", "the " * 1200 + "x " * 2000 + "\nthe\n" * 300 + "x" * 3000, "la" * 1010 + "\nla\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    compare.views(con, str(tmp_path))
    df = registry.queries()[name](spark, str(tmp_path))
    assert wanted <= {(r["doc_id"], r["start"]) for r in df.collect()}
    assert compare.difference(df, con, registry.oracle_sql()[name]) == ""
