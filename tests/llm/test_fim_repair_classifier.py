"""Fill-in-middle, conversation repair and the quality classifier against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import classifier, fim, repair

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_units_and_places_on_random_texts():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("ab<P>SMé 你\n\U0001f600?.1Z") for _ in range(rng.randrange(24)))
        units, found = UNIT.findall(text), fim.Units(text)
        assert found.count == len(units) and found.marked == bool(re.search("<[PSM]>", text))
        for k in range(len(units) + 1):
            assert found.place(k) == len("".join(units[:k]))


def test_forms_against_plain_python_and_back():
    rng, forms = random.Random(2), set()
    for doc_id in [None, -5, *range(2000)]:
        text = "".join(rng.choice("abc <>PSM.é你") for _ in range(rng.randrange(30)))
        found = fim.transformed(doc_id, text)
        assert found == plain_fim(doc_id, text)
        assert fim.restored(found[4], found[1]) == text
        forms.add(found[1])
    assert forms == {"plain", "psm", "spm"}


def test_fim_table(spark, rows, odd, none):
    df = spark.createDataFrame([(1, "a b")] * 2 + [(None, "null id"), (2, "x" * 300_000 + " é" * 50_000)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    want = sorted((i, *plain_fim(i, t)) for i, t in [(r[0], r[1]) for r in df.where("doc_id is not null").collect()])
    got = fim.rearranged(df).where("doc_id is not null").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    d = {r["doc_id"]: r for r in fim.digests(odd).collect()}
    assert d[1]["n"] == 0 and d[1]["form"] == "plain" and d[1]["prefix_chars"] is None
    assert all(r["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for r, t in ((d[i], t) for i, t in odd.select("doc_id", "text").collect()))
    assert fim.digests(none).count() == 0 and fim.digests(odd).count() == odd.count()


def cheapest(kinds):
    """(cost, audit) by a search over all edits, cheapest and then ASCII-least first."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(kinds) and state in ("", "a"):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for role in "ua":
            if (state, role) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", i, step[state, role]))
        if i < len(kinds):
            initial, fault = "-sua"[kinds[i] & 3], kinds[i] >> 2
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            more = 3 if fault == 2 else 0
            if fault != 1:
                for role, letter, price in ((initial, "K", 0), ("u", "R", 3), ("a", "R", 3)):
                    if (state, role) in step:
                        heapq.heappush(heap, (cost + more + price, audit + letter, i + 1, step[state, role]))


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_layers_against_a_search(block):
    rng = random.Random(block)
    for _ in range(1500):
        kinds = bytes(rng.choice([0, 1, 2, 2, 3, 3]) + 4 * rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.randrange(13)))
        cost, edits, end = repair.repair(kinds, block)
        assert (cost, "".join(edits) + end) == cheapest(kinds)


def test_layers_take_linear_time():
    kinds = bytes([2, 3] * 5000)
    noisy = bytes(k + 4 * (i % 17 == 0) for i, k in enumerate(kinds))
    cost, edits, end = repair.repair(noisy)
    assert len(edits) == len(noisy) and cost > 0
    assert repair.repair(kinds) == (0, ["K"] * len(kinds), "")


SPACE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """Every conversation's result by plain Python; rows: (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        turns = found.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        turns += [(turn, "user" if harm == 4 else role, text)] * {0: 0, 3: 2}.get(harm, 1)
    out = {}
    for conv, turns in found.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, role, text in turns:
            bare = text.rstrip(SPACE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            kinds.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + {None: 0, 2: 8}.get(fault, 4))
        cost, audit = cheapest(bytes(kinds))
        numbers = {t for t, *_ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        left, last, rest = [], "", iter(turns)
        for e in audit:
            now = ("", "", "") if e == "I" else next(rest)
            if e != "D":
                last = now[1] if e == "K" else "assistant" if last[:1] == "u" else "user"
                left.append(f"{last}:{now[2]}")
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def test_repair_table_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["Yes.", "No!", "What?", "cut off", "", " \n", None, "End. \t", "é 你。"])) for c in range(150) for t in sorted(rng.sample(range(40), rng.randrange(1, 9)))]
    rows += [(200, None, "user", "a."), (200, None, "user", "a."), (200, 3, "assistant", "b"), (None, 1, "user", "no id."), (None, 0, "system", "s"), (201, 5, "user", "same turn."), (201, 5, "assistant", "same turn."), (202, 0, "", "no role.")]
    rows += [(203, t, ("user", "assistant")[t % 2], f"long {t}." * 50) for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("other") for c in ("kind", "place", "copy", "digest", "pass", "audit")})
    got = {r[0]: tuple(r)[1:] for r in repair.digests(df.repartition(7)).collect()}
    want = plain_repair(rows)
    assert got.keys() == want.keys()
    assert [(c, got[c], want[c]) for c in got if got[c] != want[c]] == []


def test_repair_of_nothing(spark):
    assert repair.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    lost = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    row = repair.digests(spark.createDataFrame([(1, lost, "user", "a.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in row] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def slow_margin(model, row):
    total = model.base
    for split, bound, leaf in zip(model.split, model.bound, model.leaf):
        node = 0
        while node < len(split):
            node = 2 * node + 1 + (row[split[node]] > bound[node])
        total += leaf[node - len(split)]
    return total


def test_trees_learn_and_traverse_alike():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] * x[:, 1] > 0.1)).astype(float)
    model = classifier.grow(x[:2000], y[:2000], np.ones(2000), np.arange(2000) % 5 == 0)
    assert ((model.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert np.allclose(model.margins(x[:50]), [slow_margin(model, r) for r in x[:50]])


def test_a_level_cuts_where_every_cut_tried_is_best():
    """The first tree's root against every cut of every column."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, size=(300, 4)).astype(float)
    y = (x[:, 2] + rng.normal(size=300) > 4).astype(float)
    model = classifier.grow(x, y, np.ones(300), np.zeros(300, bool), trees=1, depth=1)
    p = 1 / (1 + np.exp(-model.base))
    g, h = p - y, np.full(300, p * (1 - p))

    def gain(j, cut):
        left = x[:, j] <= cut
        return sum(g[m].sum() ** 2 / (h[m].sum() + classifier.PENALTY) for m in (left, ~left))

    best = max(((gain(j, c + 0.5), j, c + 0.5) for j in range(4) for c in range(8)))
    assert (model.split[0, 0], model.bound[0, 0]) == best[1:]


def test_statistics_of_a_small_text():
    s = dict(zip(classifier.STATISTICS, classifier.statistics("One two. One two.\n- THREE 4\n- THREE 4\n"), strict=True))
    assert s["words"] == pytest.approx(np.log1p(10)) and s["sentences"] == pytest.approx(np.log1p(2))
    assert s["distinct_words"] == pytest.approx(5 / 10) and s["repeated_lines"] == pytest.approx(1 / 3)
    assert s["bullet_lines"] == pytest.approx(2 / 3) and s["upper_words"] == pytest.approx(2 / 10)
    assert s["letterless_words"] == pytest.approx(4 / 10) and s["signed_words"] == pytest.approx(4 / 10)
    assert {len(classifier.statistics(t)) for t in ("", " ", "a", "\U0001f600", "你好", "x" * 200_000)} == {len(classifier.STATISTICS)}
    assert all(np.isfinite(classifier.statistics(t)).all() for t in ("", " \n", "a", ".", "\U0001f600"))


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = classifier.judged(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in found)
    assert found and right / len(found) > 0.95
    assert sum(r["predicted"] for r in found if r["quality"] == 1) >= 0.98 * sum(r["quality"] for r in found)


def test_quality_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (6, 0)], "doc_id long, quality int")
    found = classifier.judged(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    unlabelled = {r["score"] for r in classifier.judged(odd, labels.limit(0)).collect()}
    assert unlabelled == {0.5}
    assert classifier.judged(none, labels).count() == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
