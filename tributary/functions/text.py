"""Text as lines, positions and characters: expressions over string columns, nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the Czech lower-case letters that sentences are made of.
LOWER_LETTERS = "aábcčdďeéěfghiíjklmnňoópqrřsštťuúůvwxyýzž"
#: Fixed value: a line that holds a tagged attribute.
TAGGED = "^<[A-Z_]+>"
WORDS = r"(?U)\s+"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def joined(rows: Column) -> Column:
    return F.array_join(rows, "\n")


def by_line(text: Column, change: Callable[[Column], Column], keep_attributes: bool = False) -> Column:
    """``change`` on the array of lines. Tagged lines are set aside and follow at the end, unless they are kept among the others."""
    rows = lines(text)
    if keep_attributes:
        return joined(change(rows))
    return joined(F.concat(change(F.filter(rows, lambda x: ~x.rlike(TAGGED))), F.filter(rows, lambda x: x.rlike(TAGGED))))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_lines_saying(text: Column, keywords: list[str], max_length: int = 75, lower: bool = True) -> Column:
    """Drops lines shorter than ``max_length`` that contain a keyword."""

    def says(x: Column) -> Column:
        found = F.lit(False)
        for k in keywords:
            found = found | F.contains(F.lower(x) if lower else x, F.lit(k.lower() if lower else k))
        return (F.length(x) < max_length) & found

    return by_line(text, lambda rows: F.filter(rows, lambda x: ~says(x)))


def without_lines_matching(text: Column, patterns: list[str]) -> Column:
    return by_line(text, lambda rows: F.filter(rows, lambda x: ~x.rlike("|".join(f"(?:{p})" for p in patterns))))


def without_short_lines(text: Column, limit: int = 5) -> Column:
    """Keeps lines that are empty, or longer than ``limit`` without the white space around them."""
    return by_line(text, lambda rows: F.filter(rows, lambda x: (F.length(x) == 0) | (F.length(stripped(x)) > limit)))


def without_numeral_lines(text: Column, share: float = 0.5) -> Column:
    """Keeps lines whose digits are less than a share of their characters other than spaces; blank lines stay."""

    def keep(x: Column) -> Column:
        digits = F.length(x) - F.length(F.regexp_replace(x, r"(?U)\d", ""))
        solid = F.length(F.replace(x, F.lit(" "), F.lit("")))
        return (solid == 0) | (digits < share * solid)

    return by_line(text, lambda rows: F.filter(rows, keep))


def with_line(text: Column, line: str = "==========") -> Column:
    return by_line(text, lambda rows: F.concat(rows, F.array(F.lit(line))))


def marks_replaced(text: Column, marks: list[str] | str, by: str) -> Column:
    """Each mark in turn; a string counts as its characters."""
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(by))
    return text


def attributes_only(text: Column) -> Column:
    """The complete tagged attributes among the lines."""
    return by_line(text, lambda rows: F.filter(rows, lambda x: x.rlike("^<[A-Z_]+>.*<[A-Z_]+/>")), keep_attributes=True)


def tagged(text: Column, tag: str) -> Column:
    """Every line but the tagged ones wrapped in a pair tag; those follow."""
    return by_line(text, lambda rows: F.transform(rows, lambda x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"<{tag}/>"))))


def tags_cleaned(text: Column) -> Column:
    """What tagged lines hold; lines without tags are dropped."""
    pattern = "<[A-Z_]+>(.*)<[A-Z_]+/>"
    return by_line(text, lambda rows: F.transform(F.filter(rows, lambda x: x.rlike(pattern)), lambda x: F.regexp_extract(x, pattern, 1)), keep_attributes=True)


def items_after_colon(rows: Column, pattern: str = r"(zboží|položk).{0,10}:") -> Column:
    """What follows the first match in each line, if it is longer than 5 characters, without tabs, spaces and dots around it."""
    after = F.transform(F.filter(rows, lambda x: x.rlike(pattern)), lambda x: F.regexp_extract(x, f"^.*?(?:{pattern})(.*)$", 2))
    return F.transform(F.filter(after, lambda x: F.length(x) > 5), lambda x: F.regexp_replace(x, r"^[\t .]+|[\t .]+$", ""))


def cpv_codes(text: Column) -> Column:
    """Codes of eight digits, a dash and a digit, with no digit beside them."""
    return F.regexp_extract_all(text, F.lit(r"(^|[^\d])([\d]{8}-\d)($|[^\d])"), F.lit(2))


def positions(text: Column, keyword: str, limit: int | None = 1002) -> Column:
    """Starts (from 0) of a keyword's occurrences from the left, in either case: the parts between them give the places.

    At most ``limit`` of them (a fixed value of the engine), all with None.

    The dotted capital I, the only character whose lower case is longer, becomes a plain i, so that places are the text's.
    """
    n = len(keyword)
    quoted = "\\Q" + keyword.lower() + "\\E"
    every = F.split(F.lower(F.translate(text, "\u0130", "i")), quoted, -1)
    parts = every if limit is None else F.slice(every, 1, limit + 1)
    lengths = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    folded = F.aggregate(lengths, start, lambda s, p: F.struct((s["at"] + p + n).alias("at"), F.array_append(s["out"], s["at"] + p).alias("out")))
    return folded["out"]


def line_at(text: Column, at: Column) -> Column:
    """The line that holds a position."""
    return F.concat(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1), F.substring_index(F.substring(text, at + 1, F.length(text)), "\n", 1))


def letter_ratio(text: Column, letters: str = LOWER_LETTERS) -> Column:
    """Share of the characters that are among ``letters``; 0 for empty texts."""
    kept = F.length(F.regexp_replace(text, f"[^{letters}]", ""))
    return F.coalesce(F.try_divide(kept, F.length(text)), F.lit(0.0))


def _counts(text: str, bins: int) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") % bins, minlength=bins)


def character_vector(text: Column, bins: int = 500) -> Column:
    """Counts of code points modulo ``bins``; bin 0 holds the length besides. A text at a time in Arrow batches: 500 counts a text would be 500 scans."""

    @F.pandas_udf("array<int>")
    def vector(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _counts(t, bins) + np.where(np.arange(bins) == 0, len(t), 0))

    return vector(F.coalesce(text, F.lit("")))


def ignore_mask(letters: str, bins: int = 500) -> Column:
    """1 for each bin that none of the ignored letters falls into, else 0. Bin 0, which counts the length, is ignored with any letter."""
    used = _counts(letters, bins) + np.where(np.arange(bins) == 0, len(letters), 0)
    return F.lit(np.where(used == 0, 1, 0).tolist()).cast("array<int>")


def merged_documents(docs: Column) -> Column:
    """Documents of an array of (doc_id, text), each behind its header."""
    return F.array_join(F.transform(docs, lambda d: F.concat(F.lit("\n<FILE id="), d["doc_id"].cast("string"), F.lit(">\n"), d["text"])), "")


def split_items(texts: Column) -> Column:
    """The lines of all texts that are not empty."""
    return F.filter(F.flatten(F.transform(texts, lambda t: F.split(t, "\n"))), lambda x: x != "")


def cpv_levels(code: Column) -> Column:
    """Division, group, class and category of a code."""
    return F.struct(*(F.substring(code, 1, n).alias(name) for name, n in (("division", 2), ("group", 3), ("class", 4), ("category", 5))))


def is_cpv(code: Column) -> Column:
    return code.rlike(r"^[\d]{8}-[\d]$")


def point_of(xml: Column) -> Column:
    """(lat, lon) from y and x attributes of a response that has an item; nulls else."""
    number = lambda name: F.expr("double(null)") if name is None else F.regexp_extract(xml, f'\\b{name}="([-0-9.]+)"', 1).try_cast("double")
    has = F.contains(xml, F.lit("item"))
    return F.struct(F.when(has, number("y")).alias("lat"), F.when(has, number("x")).alias("lon"))


def plain_namespaces(xml: Column) -> Column:
    """``xmlns:p="..."`` to ``xmlns:p="p"``."""
    return F.regexp_replace(xml, r'xmlns:([^=]*)="[^"]*"', 'xmlns:$1="$1"')


def address_of(*parts: Column) -> Column:
    """Parts joined by commas, missing ones empty."""
    return F.concat_ws(",", *(F.coalesce(p, F.lit("")) for p in parts))
