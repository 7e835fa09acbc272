"""Quotation marks around a term, by pairs: apostrophes are none, and a term between two quotations stands outside."""

from __future__ import annotations

import pytest

from tributary.llm import toxicity


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ("he shouted “you {}” at me", 1.0),
        ("er rief „du {}“ laut", 1.0),
        ("il dit « {} » hier", 1.0),
        ("they wrote ‘a {} of ours’ there", 1.0),
        ('it was "a {}" there', 1.0),
        ("don’t be an {}, it’s bad", 0.0),
        ("don't be an {}, it's bad", 0.0),
        ("l’été {} l’hiver", 0.0),
        ('"a" you {}, "b"', 0.0),
        ('an open " mark\nand a {}\nand a " mark', 0.0),
        ("dogs’ {} and cats’", 0.0),
        ('a "b {} c', 0.0),
    ],
)
def test_a_term_is_quoted_inside_a_pair_alone(text, score):
    found = toxicity.Matcher(["zwerchling"]).matches(text.format("zwerchling"))
    assert [q for *_, q in found] == [score]


def test_pairs_against_a_scan_of_each_line():
    text = '“a „b“ c” «d» e’s ‘f’ "g\n"h" `i` j”'
    assert [text[a : b + 1] for a, b in toxicity.quotations(text)] == ["“a „", "“ c”", "«d»", "‘f’", '"h"', "`i`"]


def test_long_texts_take_linear_time():
    text = ('"zwerchling" said ' * 20_000).strip()
    found = toxicity.Matcher(["zwerchling"]).matches(text[:4000])
    assert found and all(q == 1.0 for *_, q in found)
    assert len(toxicity.quotations(text)) == 20_000
