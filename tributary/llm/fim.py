r"""Operator 11: documents with a middle part moved to the end, by an event scan of one Aho-Corasick automaton.

A text's units are runs of ASCII letters and single other characters. The automaton knows every pair of ASCII
characters in which a letter meets a non-letter, in either order, and the three sentinels; characters beyond ASCII read as
one non-letter each. Its hits cut a text into stretches of one class. A stretch of letters is one unit, another has as
many as it has characters, so running sums over the hits alone count the units before each stretch, and the place of
the k-th unit is one binary search and one addition. Units themselves are never made.

Where the parts begin and what form a document takes depends on a hash of its id alone (``draws``). The text is cut at
two units; form psm writes ``<P>``prefix``<S>``suffix``<M>``middle, spm ``<S>``suffix``<P>``prefix``<M>``middle. A text that
holds a sentinel stays plain, so the sentinels in an output mark its parts without doubt and ``restored`` gives the text
back.

One pass without a shuffle; a text's events take 16 bytes each.

Edge cases: null and empty texts are plain and have no units; a null id hashes as an empty one; rows with one id are cut
by the same draws; repeated rows stay; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import documents, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are rearranged, and so many of these start with the suffix.
RATE, SUFFIX_FIRST = 90, 20
#: Kinds of events: letters begin, letters end, a sentinel.
_BEGIN, _END, _SENTINEL = 0, 1, 2


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    letters = string.ascii_letters
    for other in (c for c in map(chr, range(128)) if c not in letters):
        for letter in letters:
            found.add_word(other + letter, _BEGIN)
            found.add_word(letter + other, _END)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(sentinel, _SENTINEL)
    found.make_automaton()
    return found


class Units:
    """A text's unit count and the places of its units."""

    def __init__(self, text: str):
        seen = text.encode("ascii", "replace").decode("ascii")  # one character for each, whatever its class
        # Place of an event's last character and its kind, in turn.
        hits = np.fromiter(chain.from_iterable(automaton().iter(seen)), np.int64)
        places, kinds = hits[::2], hits[1::2]
        #: Whether a sentinel occurs.
        self.marked = bool((kinds == _SENTINEL).any())
        change = kinds != _SENTINEL
        #: Where each stretch begins, the end of all, and the units before each of these.
        self.bounds = np.concatenate(([0], places[change], [len(seen)]))
        letters = np.concatenate(([bool(seen) and seen[0] in string.ascii_letters], kinds[change] == _BEGIN))
        self.before = np.concatenate(([0], np.cumsum(np.where(letters, 1, np.diff(self.bounds)))))
        self.count = int(self.before[-1])

    def place(self, units: int) -> int:
        """Code points that the first ``units`` units take."""
        k = int(np.searchsorted(self.before, units, "right")) - 1
        return int(self.bounds[k] + units - self.before[k])


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def transformed(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output)."""
    units = Units(text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or units.marked or h3 % 100 >= RATE:
        return units.count, "plain", None, None, text
    first, second = sorted((h1 % (units.count + 1), h2 % (units.count + 1)))
    a, b = units.place(first), units.place(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return units.count, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.count, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text, from an output and its form alone: no part holds a sentinel, so the first of each is the mark."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _columns(rows: list[tuple], kinds: tuple[pa.DataType, ...]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


_CUT = "n long, form string, prefix_chars long, middle_chars long"
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def rearranged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            rows = [transformed(i, t) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *_columns(rows, _KINDS)], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return documents(df, id_col, text_col, id_col).mapInArrow(tidy(run), f"`{id_col}` long, {_CUT}, output string")


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digests(df: DataFrame) -> DataFrame:
    """Query op11: where each document was cut, a digest of its output and one of the text that the output gives back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            rows = []
            for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
                *cut, output = transformed(i, t)
                rows.append((*cut, _sha256(output), _sha256(restored(output, cut[1]))))
            yield pa.RecordBatch.from_arrays([ids, *_columns(rows, (*_KINDS, pa.string()))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return documents(df).mapInArrow(tidy(run), f"doc_id long, {_CUT}, output_sha256 string, restored_sha256 string")
