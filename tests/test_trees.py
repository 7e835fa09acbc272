"""Dependency trees: CoNLL-U both ways, filters and searches against plain Python, sentences with a known subject."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tributary.operators import trees

#: (form, lemma, part of speech, features, head, relation) of made sentences; what the default chain leaves of each.
MADE = {
    "Předmětem smlouvy je dodávka strojů": ("Předmětem předmět NOUN Case=Ins 4 obl|smlouvy smlouva NOUN Case=Gen 1 nmod|je být AUX Polarity=Pos 4 cop|dodávka dodávka NOUN Case=Nom 0 root|strojů stroj NOUN Case=Gen 4 nmod", ""),
    "Prodávající se zavazuje dodat stroje a nářadí": (
        "Prodávající prodávající NOUN Case=Nom 3 nsubj|se se PRON _ 3 expl:pv|zavazuje zavazovat VERB _ 0 root|dodat dodat VERB _ 3 xcomp|stroje stroj NOUN Case=Acc 4 obj|a a CCONJ _ 7 cc|nářadí nářadí NOUN Case=Acc 5 conj",
        "stroje a nářadí",
    ),
    "Dodavatel dodá nové stroje za cenu": ("Dodavatel dodavatel NOUN Case=Nom 2 nsubj|dodá dodat VERB _ 0 root|nové nový ADJ _ 4 amod|stroje stroj NOUN Case=Acc 2 obj|za za ADP _ 6 case|cenu cena NOUN Case=Acc 2 obl", "nové stroje"),
    "Objednatel dodá stroje": ("Objednatel objednatel NOUN Case=Nom 2 nsubj|dodá dodat VERB _ 0 root|stroje stroj NOUN Case=Acc 2 obj", ""),
    "Pro objednatele dodá stroje": ("Pro pro ADP _ 2 case|objednatele objednatel NOUN Case=Acc 3 obl|dodá dodat VERB _ 0 root|stroje stroj NOUN Case=Acc 3 obj", "stroje"),
    "Smlouva o pořízení techniky": ("Smlouva smlouva NOUN Case=Nom 0 root|o o ADP _ 3 case|pořízení pořízení NOUN Case=Loc 1 nmod|techniky technika NOUN Case=Gen 3 nmod", "techniky"),
}


def conllu(tokens: str) -> str:
    rows = [t.split(" ") for t in tokens.split("|")]
    return "# sent\n" + "\n".join(f"{k}\t{f}\t{l}\t{u}\t_\t{x}\t{h}\t{d}\t_\t_" for k, (f, l, u, x, h, d) in enumerate(rows, 1)) + "\n\n"


@pytest.fixture(scope="module")
def drawn(spark):
    draw = random.Random(2)
    out = []
    for doc in range(60):
        text = ""
        for _ in range(draw.randrange(1, 4)):
            n = draw.randrange(1, 12)
            order = list(range(1, n + 1))
            draw.shuffle(order)
            head = {order[0]: 0} | {k: draw.choice(order[:i]) for i, k in enumerate(order) if i}
            for k in range(1, n + 1):
                word = draw.choice("abcde")
                text += f"{k}\t{word.upper()}\t{word}\t{draw.choice(['NOUN', 'VERB'])}\t_\t{draw.choice(['_', 'Case=Nom', 'Case=Nom|Number=Sing'])}\t{head[k]}\tdep\t_\t{draw.choice(['_', 'SpaceAfter=No'])}\n"
            text += "\n"
        out.append((doc, text))
    return spark.createDataFrame(out, "doc_id long, conllu string").cache()


def parsed(drawn):
    out = {}
    for r in drawn.collect():
        for s, block in enumerate(b for b in r["conllu"].split("\n\n") if b.strip()):
            out[r["doc_id"], s] = [line.split("\t") for line in block.strip().split("\n")]
    return out


def above(tokens, k):
    out = []
    while int(tokens[k - 1][6]):
        k = int(tokens[k - 1][6])
        out.append(k)
    return out


def test_conllu_both_ways(drawn):
    rows = trees.sentences(drawn)
    again = {r["doc_id"]: r["conllu"] for r in trees.to_conllu(rows).collect()}
    assert again == {r["doc_id"]: r["conllu"].strip() for r in drawn.collect()}
    said = {r["doc_id"]: r["text"] for r in trees.texts(rows).collect()}
    plain = parsed(drawn)
    for doc in said:
        lines = ["".join(t[1] + ("" if "No" in t[9] else " ") for t in tokens).rstrip(" ") for (d, _), tokens in sorted(plain.items()) if d == doc]
        assert said[doc] == "\n".join(lines)


def test_filters_by_words_and_subtrees(drawn):
    rows, plain = trees.sentences(drawn), parsed(drawn)
    whole = {(r["doc_id"], r["sentence"]) for r in trees.without_sentences_saying(rows, ("a", "b")).collect()}
    assert whole == {k for k, tokens in plain.items() if not any(t[2] in "ab" for t in tokens)}
    for r in trees.without_subtrees(rows, ("a", "b")).collect():
        tokens = plain[r["doc_id"], r["sentence"]]
        left = [k for k in range(1, len(tokens) + 1) if not any(tokens[j - 1][2] in "ab" for j in [k, *above(tokens, k)])]
        assert [(t["form"], t["head"]) for t in r["tokens"]] == [(tokens[k - 1][1], left.index(int(tokens[k - 1][6])) + 1 if int(tokens[k - 1][6]) else 0) for k in left]
        assert [t["ord"] for t in r["tokens"]] == list(range(1, len(left) + 1))


@pytest.mark.parametrize("way", ["next", "previous", "ancestor", "descendant"])
@pytest.mark.parametrize(("reach", "itself"), [(100, False), (2, True)])
def test_searches(drawn, way, reach, itself):
    conditions = ((("lemma", ("[ab]",)), ("feats[Case]", ("Nom",))), (("upos", ("VERB",)), ("unheard", ("x",))))
    found = F.transform("tokens", lambda t: trees.nearest_node(F.col("tokens"), t["ord"], conditions, way, reach, itself))
    plain = parsed(drawn)
    for r in trees.sentences(drawn).select("doc_id", "sentence", found.alias("f")).collect():
        tokens = plain[r["doc_id"], r["sentence"]]
        n = len(tokens)
        met = lambda k: tokens[k - 1][2] in "ab" and "Case=Nom" in tokens[k - 1][5] or tokens[k - 1][3] == "VERB"
        for k in range(1, n + 1):
            path = {"next": list(range(k + 1, n + 1))[:reach], "previous": list(range(k - 1, 0, -1))[:reach], "ancestor": above(tokens, k)[:reach], "descendant": [j for j in range(1, n + 1) if k in above(tokens, j)]}[way]
            assert r["f"][k - 1] == next((j for j in ([k] if itself else []) + path if met(j)), None)


def test_what_the_default_chain_leaves(spark):
    source = [(k, conllu(tokens)) for k, (tokens, _) in enumerate(MADE.values())]
    rows = trees.sentences(spark.createDataFrame(source, "doc_id long, conllu string"))
    said = {r["doc_id"]: r["text"] for r in trees.texts(trees.filtered(rows)).collect()}
    assert [said.get(k, "") for k in range(len(MADE))] == [want for _, want in MADE.values()]


def test_submitter_clauses_go(spark):
    made = {
        "Objednatel platí a dodavatel dodá stroje": ("Objednatel objednatel NOUN Case=Nom 2 nsubj|platí platit VERB _ 6 conj|a a CCONJ _ 6 cc|dodavatel dodavatel NOUN Case=Nom 6 nsubj|stroje stroj NOUN Case=Acc 6 obj|dodá dodat VERB _ 0 root", "a dodavatel stroje dodá"),
        "Stroje": ("Stroje stroj NOUN Case=Nom 0 root", "Stroje"),
        "Zadavatel": ("Zadavatel zadavatel NOUN Case=Nom 0 root", ""),
    }
    rows = trees.sentences(spark.createDataFrame([(k, conllu(t)) for k, (t, _) in enumerate(made.values())], "doc_id long, conllu string"))
    left = trees.without_submitter_clauses(rows)
    assert {r["doc_id"]: r["text"] for r in trees.texts(left).collect()} == {k: want for k, (_, want) in enumerate(made.values())}
    assert trees.without_empty_sentences(left).count() == 2


def test_nodes_found_from_all_tokens_at_once(drawn):
    conditions = ((("lemma", ("[ab]",)), ("feats[Case]", ("Nom",))), (("upos", ("VERB",)), ("unheard", ("x",))))
    ways = {"next": 3, "previous": 2, "ancestor": 2, "descendant": 100}
    rows = trees.sentences(drawn)

    def alone(way, reach):
        return F.transform("tokens", lambda t: trees.nearest_node(F.col("tokens"), t["ord"], conditions, way, reach)).alias(f"one_{way}")

    one = [alone(way, reach) for way, reach in ways.items()]
    for r in trees.found_nodes(rows, conditions, ways, "all_").select("*", *one).collect():
        for way in ways:
            assert r[f"all_{way}"] == r[f"one_{way}"], way


def _long(n: int, shape: str) -> list[dict]:
    """A sentence of n tokens whose tree is a chain, a bush, or drawn."""
    draw = random.Random(n)
    head = {"chain": lambda k: k, "bush": lambda k: min(k, 1), "drawn": lambda k: draw.randrange(max(0, k - 6), k) + 1 if k else 0}[shape]
    lemmas = "stroj dodat předmět objednatel uvedený pořízení zavazovat být".split()
    return [{"ord": k + 1, "form": "je", "lemma": draw.choice(lemmas), "upos": draw.choice(["NOUN", "VERB", "PUNCT"]), "feats": [("Case", "Nom")], "head": head(k), "deprel": draw.choice(["obj", "nmod", "conj", "cop", "root"]), "space": True} for k in range(n)]


@pytest.mark.parametrize("shape", ["chain", "bush", "drawn"])
def test_long_sentences_take_seconds(shape):
    began = time.process_time()
    tokens = _long(5000, shape)
    assert trees.subject_places(trees.Sentence(tokens)) is not None
    assert len(trees.places_without_submitters(trees.Sentence(tokens))) <= 5000
    assert time.process_time() - began < 10


def test_ranges_are_subtrees():
    tokens = _long(300, "drawn")
    s = trees.Sentence(tokens)
    heads = {k: t["head"] - 1 for k, t in enumerate(tokens)}

    def above(k):
        while (k := heads[k]) >= 0:
            yield k

    for k in range(300):
        under = [j for j in range(300) if k in above(j)]
        assert s.below(k).tolist() == under and s.places[s.under(k)].tolist() == under


def test_heads_in_a_circle_count_as_roots():
    tokens = [{"ord": k + 1, "form": "x", "lemma": "stroj", "upos": "NOUN", "feats": [], "head": (2, 1, 2, 9)[k], "deprel": "obj", "space": True} for k in range(4)]
    s = trees.Sentence(tokens)
    assert s.head.tolist() == [-1, 0, 1, -1]


def test_subtrees_of_a_deep_sentence_go(spark):
    """A chain of 300 tokens hangs on the first; all of it goes with its lemma."""
    text = "".join(f"{k}\tf\t{'cut' if k == 2 else 'w'}\tNOUN\t_\t_\t{k - 1}\tdep\t_\t_\n" for k in range(1, 301))
    rows = trees.sentences(spark.createDataFrame([(1, text)], "doc_id long, conllu string"))
    assert [len(r["tokens"]) for r in trees.without_subtrees(rows, ("cut",)).collect()] == [1]


def test_sentences_searched_together_keep_to_themselves():
    """Sentences in a row give the places that each gives alone, and thousands of short ones take no long time."""
    draw = random.Random(11)
    some = [_long(draw.randrange(9), "drawn") + _long(draw.randrange(6), "chain") for _ in range(300)]
    for sentence in some:
        for k, t in enumerate(sentence, 1):
            t |= {"ord": k, "head": draw.randrange(k), "lemma": draw.choice("stroj dodat předmět objednatel dílo pro místo uvedený pořízení dodavatel zavazovat provedený".split())}
    whole, sizes = [t for sentence in some for t in sentence], [len(sentence) for sentence in some]
    for rule in (trees.subject_places, trees.places_without_submitters):
        alone, at = [], 0
        for sentence in some:
            alone += [at + k for k in rule(trees.Sentence(sentence))]
            at += len(sentence)
        assert rule(trees.Sentence(whole, sizes)) == alone and alone
    words, began = [t for t in some if t] * 20, time.process_time()
    trees.subject_places(trees.Sentence([t for sentence in words for t in sentence], [len(sentence) for sentence in words]))
    assert time.process_time() - began < 4e-4 * len(words)
