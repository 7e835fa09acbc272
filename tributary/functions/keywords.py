"""All occurrences of many keywords in one pass over a text, by one automaton whatever their number."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: An occurrence as one number: the keyword's place in the list above these bits, its own place below.
_BITS = 32


def _automaton(keywords: Sequence[str]) -> ahocorasick.Automaton | None:
    """Finds lower-case forms; keywords with one form are found together, the empty keyword never."""
    named: dict[str, list[int]] = {}
    for k, keyword in enumerate(keywords):
        if keyword:
            named.setdefault(keyword.lower(), []).append(k)
    if not named:
        return None
    found = ahocorasick.Automaton()
    for form, places in named.items():
        found.add_word(form, (len(form), places))
    found.make_automaton()
    return found


def found_in(text: str, automaton: ahocorasick.Automaton | None, limit: int | None = None) -> list[int]:
    """Occurrences of each keyword from the left, none overlapping one of the same keyword before it; at most ``limit`` of each."""
    if automaton is None or not text:
        return []
    free: dict[int, int] = {}
    left: dict[int, int] = {}
    out = []
    # The dotted capital I is the only character whose lower case is longer.
    for end, (n, places) in automaton.iter(text.replace("İ", "i").lower()):
        start = end - n + 1
        first = places[0]
        if start >= free.get(first, 0) and (limit is None or left.get(first, 0) < limit):
            free[first], left[first] = end + 1, left.get(first, 0) + 1
            out += [k << _BITS | start for k in places]
    return out


def hits(text: Column, keywords: Sequence[str], limit: int | None = None) -> Column:
    """Array of structs (keyword, occ): where each keyword occurs, in either case, places from 0; empty for a null text."""

    @F.pandas_udf("array<long>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(keywords)
        for texts in parts:
            yield texts.map(lambda t: np.array(found_in(t, automaton, limit), dtype=np.int64))

    names = F.array(*(F.lit(k) for k in keywords)) if keywords else F.array().cast("array<string>")
    return F.transform(find(F.coalesce(text, F.lit(""))), lambda x: F.struct(F.get(names, F.shiftright(x, _BITS).cast("int")).alias("keyword"), x.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int").alias("occ")))
