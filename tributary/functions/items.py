"""Wrapped lines, long lines, contract names and enumerated items: what turns a context into items.

All of it is expressions over a string column; loops over lines are ``aggregate`` folds. A context has a few thousand
characters, so folds over its lines stay small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Letters and digits that are no bullets, upper-case letters of headings.
NO_BULLETS = T.LOWER_LETTERS + "0123456789"
UPPER_LETTERS = "AÁBCČDĎEÉĚFGHIÍJKLMNŇOÓPQRŘSŠTŤUÚŮVWXYÝZŽ "
#: What stands before, or never in, a contract's name; first letters of lines that are no enumeration.
NAME_BEFORE, NAME_PARTS, NO_NAME = ("názvem",), ("název", "stavb", "projekt", "předmět"), ("přílo", "dále", "jen")
NO_TUPLES = ("Vy", "Př", "Za", "Pr", "Ob", "Po")
#: A colon that ends a header, as the cleaning writes it; a header of items; characters of a full line.
DELIMITER, HEADER, FULL = ":.", r"(?d)[Pp]ředmět.{0,20}je.{0,5}\z", 100
#: Stands for a place between characters; texts do not have it.
_MARK = "\u0000"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _says(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(text), F.lit(w.lower()))
    return found


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def trimmed(text: Column, marks: str = r"\t .") -> Column:
    return F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", "")


def _none() -> Column:
    return F.array().cast("array<string>")


# Lines


def _quantile(sizes: Column, q: float) -> Column:
    """Of ascending numbers, between neighbours in proportion; 0 of none."""
    at = F.lit(q) * (F.size(sizes) - 1)
    low = F.floor(at).cast("int")
    one, two, part = F.get(sizes, low), F.coalesce(F.get(sizes, low + 1), F.get(sizes, low)), at - low
    return F.when(F.size(sizes) == 0, 0.0).otherwise(F.when(part >= 0.5, two - (two - one) * (1 - part)).otherwise(one + (two - one) * part))


def _spread(sizes: Column) -> Column:
    """Standard deviation of numbers as a population."""
    mean = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x) / F.size(sizes)
    return _let(mean, lambda m: F.sqrt(F.aggregate(sizes, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(sizes)))


def _without_ends(sizes: Column) -> Column:
    """Without the last number, if there are more than three, and then without the first one, likewise."""
    cut = F.when(F.size(sizes) > 3, F.slice(sizes, 1, F.size(sizes) - 1)).otherwise(sizes)
    return _let(cut, lambda c: F.when(F.size(c) > 3, F.slice(c, 2, F.size(c))).otherwise(c))


def _rejoined(rows: Column, full: Column, letters: float) -> Column:
    """Lines with a space behind each; a line break stays only where a line seems to end a sentence."""
    pairs = F.transform(rows, lambda x, i: F.struct(x.alias("line"), F.get(rows, i + 1).alias("next")))
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("last"), F.lit("").alias("before"), F.lit(0).alias("n"), F.lit(False).alias("skip"))

    def read(s: Column, x: Column) -> Column:
        skip = s["skip"] & (F.length(x["line"]) <= 1)
        out = F.when(skip, s["out"]).otherwise(F.concat(s["out"], x["line"], F.lit(" ")))
        last, before = F.when(skip, s["last"]).otherwise(x["line"]), F.when(skip, s["before"]).otherwise(s["last"])
        n = F.when(skip, s["n"]).otherwise(s["n"] + 1)
        is_full = (F.length(last) >= full) & (T.letter_ratio(last) > letters)
        goes_on = ~F.endswith(T.stripped(last), F.lit(".")) & (n > 1) & (F.length(before) > full)
        continued = F.coalesce((F.length(x["next"]) >= full) & ~x["next"].rlike("^[A-Z]"), F.lit(False))
        glued = is_full | goes_on | continued
        return F.struct(F.when(glued, out).otherwise(F.concat(out, F.lit("\n"))).alias("out"), last.alias("last"), before.alias("before"), n.alias("n"), (skip | glued).alias("skip"))

    return F.aggregate(pairs, start, read, lambda s: s["out"])


def wrapped_lines_joined(text: Column, least: int = 70, full: float = 0.85, spread: float = 5.0, letters: float = 0.6) -> Column:
    """Joins lines that were wrapped at a page's width, where the lengths of the longest lines say that they were.

    The 0.95 quantile of lengths is the width; it must be ``least`` or more, and lines over ``full`` of it must differ by
    less than ``spread``. Then runs of blank lines become one.
    """

    def measured(rows: Column, down: Column) -> Column:
        width = _let(F.reverse(F.filter(down, lambda n: n > 0)), lambda up: _quantile(up, 0.95))

        def decided(w: Column) -> Column:
            top = F.slice(down, 1, F.greatest(F.size(F.filter(down, lambda n: n > full * w)), F.lit(2)))
            even = _let(_without_ends(top), _spread) < spread
            return F.when((w >= least) & even, _rejoined(rows, F.floor(w * full), letters)).otherwise(text)

        return _let(width, decided)

    joined = _let(T.lines(text), lambda rows: _let(F.sort_array(F.transform(rows, F.length), asc=False), lambda down: measured(rows, down)))
    return F.regexp_replace(joined, r"(?U)\n\s*\n", "\n\n")


def _commonest(values: Column) -> Column:
    """The value that is there most often, of equals the first; null of none."""

    def of(values: Column) -> Column:
        counted = F.transform(F.array_distinct(values), lambda x, i: F.struct(F.size(F.filter(values, lambda v: v == x)).alias("n"), (-i).alias("i"), x.alias("value")))
        return F.array_max(counted)["value"]

    return _let(values, of)


def _bullets(rows: Column, forbidden: str = NO_BULLETS) -> Column:
    """First characters of lines that may be bullets."""
    firsts = F.transform(rows, lambda x: F.substring(T.stripped(x), 1, 1))
    return F.filter(firsts, lambda c: (c != "") & (F.instr(F.lit(forbidden), F.lower(c)) == 0))


def _cut_at_bullets(line: Column, bullet: Column) -> Column:
    """Parts of a line that start at white space before a bullet (at a dash itself); not inside quotation marks."""
    dash = F.regexp_replace(line, r"(?U)([\s,.])(-)(\s+[^(Kč)])", f"$1{_MARK}$2$3")
    other = F.regexp_replace(line, F.concat(F.lit(r"(?U)\s+\Q"), bullet, F.lit(r"\E")), F.lit(f"{_MARK}$0"))
    parts = F.split(F.when(bullet == "-", dash).otherwise(other), _MARK)
    total = _count(line, '"')

    def glue(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))
        start = F.struct(F.array(first).alias("out"), _count(first, '"').alias("quotes"))

        def step(s: Column, x: Column) -> Column:
            inside = (s["quotes"] % 2 == 1) & (s["quotes"] < total)
            longer = F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.concat(F.element_at(s["out"], -1), x)))
            return F.struct(F.when(inside, longer).otherwise(F.array_append(s["out"], x)).alias("out"), (s["quotes"] + _count(x, '"')).alias("quotes"))

        return F.aggregate(F.slice(parts, 2, F.size(parts)), start, step, lambda s: s["out"])

    return _let(parts, glue)


def long_lines_split(text: Column, limit: int = 200, forbidden: str = NO_BULLETS) -> Column:
    """Cuts lines longer than ``limit`` at the bullet that starts most lines."""

    def change(rows: Column) -> Column:
        return _let(rows, split)

    def split(rows: Column) -> Column:
        def cut(bullet: Column) -> Column:
            return F.flatten(F.transform(rows, lambda x: F.when((F.length(x) > limit) & bullet.isNotNull(), _cut_at_bullets(x, bullet)).otherwise(F.array(x))))

        return _let(_commonest(_bullets(rows, forbidden)), cut)

    return T.by_line(text, change)


# Names


def quoted_names(line: Column, before: tuple[str, ...] = NAME_BEFORE, never: tuple[str, ...] = NO_NAME, reach: int = 50, least: int = 25) -> Column:
    """What stands between quotation marks, behind a word of naming, or long and not behind a word that tells otherwise."""

    def found(parts: Column) -> Column:
        pairs = F.when(F.size(parts) > 2, F.sequence(F.lit(1), F.floor((F.size(parts) - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
        each = F.transform(pairs, lambda k: F.struct(F.get(parts, 2 * k - 1).alias("name"), F.right(F.array_join(F.slice(parts, 1, 2 * k - 1), '"'), F.lit(reach)).alias("before")))
        named = F.filter(each, lambda x: _says(x["before"], before) | ((F.length(x["name"]) >= least) & ~_says(x["before"], never)))
        return F.transform(named, lambda x: x["name"])

    return _let(F.split(line, '"'), found)


def structured_names(line: Column, following: Column, before: tuple[str, ...] = NAME_PARTS, never: tuple[str, ...] = (*NO_NAME, '"'), reach: int = 30, least: int = 25) -> Column:
    """What follows a colon and one more character behind a word of naming; the ``following`` line instead if that is short."""

    def found(parts: Column) -> Column:
        places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        each = F.transform(places, lambda k: F.struct(F.right(F.array_join(F.slice(parts, 1, k), ""), F.lit(reach)).alias("before"), T.stripped(F.substring(F.array_join(F.slice(parts, k + 1, F.size(parts)), ""), F.lit(3), F.length(line))).alias("rest")))
        behind = F.filter(each, lambda x: _says(x["before"], before))
        names = F.transform(behind, lambda x: trimmed(F.when((F.length(x["rest"]) < least) & following.isNotNull(), following).otherwise(x["rest"])))
        return F.filter(names, lambda x: (F.length(x) > least) & ~_says(x, never))

    return _let(F.split(F.regexp_replace(line, "(?d):.", f"{_MARK}$0"), _MARK), found)


def quoted_names_of(rows: Column) -> Column:
    return F.flatten(F.transform(rows, lambda x: quoted_names(x)))


def structured_names_of(rows: Column) -> Column:
    return F.flatten(F.transform(rows, lambda x, i: structured_names(x, F.get(rows, i + 1))))


# Enumerations


def _longest(shape: Column, pattern: str) -> Column:
    """Places (from 0) of the digits 1 in the match of a pattern that has most of them, the first of equals; empty if nothing matches."""

    def best(shape: Column, found: Column) -> Column:
        between = F.split(shape, pattern)
        top = F.array_max(F.transform(found, lambda m, i: F.struct(_count(m, "1").alias("n"), (-i).alias("i"), m.alias("m"))))
        placed = lambda t: F.struct(t["m"].alias("m"), F.length(F.array_join(F.concat(F.slice(between, 1, 1 - t["i"]), F.slice(found, 1, -t["i"])), "")).alias("at"))
        ones = lambda p: F.filter(F.transform(F.split(p["m"], ""), lambda c, j: F.when(c == "1", j + p["at"])), lambda x: x.isNotNull())
        return F.when(F.size(found) > 0, _let(_let(top, placed), ones)).otherwise(F.array().cast("array<int>"))

    return _let(shape, lambda shape: _let(F.regexp_extract_all(shape, F.lit(pattern), F.lit(0)), lambda found: best(shape, found)))


def _headed(rows: Column, first: Column, delimiter: str = DELIMITER, full: int = FULL) -> Column:
    """Lines above an enumeration, up to five, that belong to it: from what follows the nearest delimiter; none if there is no such line."""
    start = F.struct(_none().alias("out"), F.lit(0).alias("state"))
    above = F.reverse(F.slice(rows, F.greatest(first - 5, F.lit(0)) + 1, F.least(first, F.lit(5))))

    def read(s: Column, x: Column) -> Column:
        closing = F.struct(F.array_append(s["out"], F.substring_index(x, delimiter, -1)).alias("out"), F.lit(1).alias("state"))
        failing = F.struct(_none().alias("out"), F.lit(2).alias("state"))
        longer = F.struct(F.when(F.length(x) > 5, F.array_append(s["out"], x)).otherwise(s["out"]).alias("out"), F.lit(0).alias("state"))
        return F.when(s["state"] != 0, s).when(F.contains(x, F.lit(delimiter)), closing).when(F.length(x) > full, failing).otherwise(longer)

    return F.aggregate(above, start, read, lambda s: F.when(s["state"] == 1, F.reverse(s["out"])).otherwise(_none()))


def _selected(rows: Column, at: Column) -> Column:
    """The lines at the given places behind their heading lines; none for no place."""
    return F.when(F.size(at) > 0, F.concat(_headed(rows, F.get(at, F.lit(0))), F.transform(at, lambda i: F.get(rows, i)))).otherwise(_none())


def _shape(rows: Column, full: int = FULL) -> Column:
    """A digit for each line by its length: 0, 1, 2 for full and 5 for longer or upper-case ones; single full lines count as 1."""
    digit = lambda x: F.when((F.length(x) > full * 1.5) | (T.letter_ratio(x, UPPER_LETTERS) > 0.95), 5).when(F.length(x) > full, 2).when(F.length(x) > 5, 1).otherwise(0)

    def smooth(shape: Column) -> Column:
        twos = F.filter(F.transform(shape, lambda d, i: F.when(d == 2, i)), lambda i: i.isNotNull())

        def step(s: Column, i: Column) -> Column:
            low = F.greatest(i - 5, F.lit(0))
            near = F.aggregate(F.slice(s, low + 1, F.least(i + 5, F.size(s)) - low), F.lit(0), lambda a, d: a + d)
            return F.when(near < 10, F.transform(s, lambda d, j: F.when(j == i, 1).otherwise(d))).otherwise(s)

        return F.aggregate(twos, shape, step)

    return F.array_join(F.transform(_let(F.transform(rows, digit), smooth), lambda d: d.cast("string")), "")


def items_by_structure(rows: Column, pattern: str = "010(10)*", delimiter: str = DELIMITER, full: int = FULL) -> Column:
    """Items as short lines that take turns with blank ones; three or more, in a table those with tabs only."""

    def chosen(lines: Column) -> Column:
        tabbed = F.when(F.exists(lines, lambda x: F.contains(x, F.lit("\t"))), F.filter(lines, lambda x: F.contains(x, F.lit("\t")))).otherwise(lines)
        plain = F.filter(tabbed, lambda x: ~F.contains(x, F.lit(delimiter)))
        return F.when(F.size(plain) > 2, F.transform(plain, lambda x: trimmed(x))).otherwise(_none())

    return _let(_selected(rows, _longest(_shape(rows, full), pattern)), chosen)


def _run(rows: Column, starts: Column, begin: Column) -> Column:
    """Lines of the longest run that starts alike, three at least, without that start; ``starts``: (start, place) of lines that have one."""
    shape = F.array_join(F.transform(starts, lambda s: F.when(s["start"] == begin, "1").otherwise("0")), "")

    def lines(at: Column) -> Column:
        items = _selected(rows, F.transform(at, lambda k: F.get(starts, k)["at"]))
        return F.when(F.size(at) > 2, F.transform(items, lambda x: trimmed(trimmed(F.replace(x, begin, F.lit("")), r"\t .,;")))).otherwise(_none())

    return _let(_longest(shape, "1+"), lines)


def _starts(rows: Column, size: int) -> Column:
    each = F.transform(rows, lambda x, i: F.struct(F.substring(T.stripped(x), 1, size).alias("start"), i.alias("at")))
    return F.filter(each, lambda s: F.length(s["start"]) == size)


def items_by_first_character(rows: Column, forbidden: str = NO_BULLETS) -> Column:
    """Items as lines behind the commonest bullet."""
    run = lambda bullet: F.when(bullet.isNull(), _none()).otherwise(_let(_starts(rows, 1), lambda s: _run(rows, s, bullet)))
    return _let(_commonest(_bullets(rows, forbidden)), run)


def items_by_two_characters(rows: Column, least: int = 4, forbidden: tuple[str, ...] = NO_TUPLES) -> Column:
    """Items as lines that start with the same two characters, for each such pair that ``least`` lines have, the commonest first."""

    def runs(starts: Column) -> Column:
        counted = F.transform(F.array_distinct(starts["start"]), lambda p, i: F.struct((-F.size(F.filter(starts["start"], lambda x: x == p))).alias("n"), i.alias("i"), p.alias("p")))
        often = F.filter(F.array_sort(counted), lambda c: (c["n"] <= -least) & ~c["p"].isin(*forbidden))
        return F.flatten(F.transform(often, lambda c: _run(rows, starts, c["p"])))

    return _let(_starts(rows, 2), runs)


def items_under_header(rows: Column, header: str = HEADER) -> Column:
    """Items as lines behind a header, until a line of fewer than five characters."""
    start = F.struct(_none().alias("out"), F.lit(False).alias("on"))

    def read(s: Column, x: Column) -> Column:
        on = s["on"] & (F.length(x) >= 5)
        return F.struct(F.when(on, F.array_append(s["out"], trimmed(x))).otherwise(s["out"]).alias("out"), (on | x.rlike(header)).alias("on"))

    return F.aggregate(rows, start, read, lambda s: s["out"])


def tagged_behind(text: Column, found: Callable[[Column], Column], tag: str) -> Column:
    """The text with what ``found`` finds in its lines behind them, each in a pair tag; empty items are left out."""
    each = lambda rows: F.filter(found(rows), lambda x: x != "") if tag == "ITEM" else found(rows)
    return T.by_line(text, lambda rows: _let(rows, lambda r: F.concat(r, F.transform(each(r), lambda x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"<{tag}/>"))))))


#: The cleaning of a context in its order; each step takes a text to a text. Patterns and marks are fixed values.
CLEANING: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("numeral lines", T.without_numeral_lines),
    ("short lines", T.without_short_lines),
    ("page lines", lambda t: T.without_lines_saying(t, ["strana", "stránka", "e-mail"])),
    ("contact lines", lambda t: T.without_lines_saying(t, ["Tel:", "Fax:", "IČ:", "IČO:", "DIČ:"], lower=False)),
    ("addresses on the net", lambda t: T.without_lines_matching(t, ["www", r"(?U)[\w\-\.]+\s*@\s*([\w\-]+\.)+[\w\-]{2,4}"])),
    ("telephone numbers", lambda t: T.without_lines_matching(t, [r"(?U)(\+\d{2,3}){0,1}(\s{0,1}\d{3}){3}"])),
    ("commas before sentences", lambda t: F.regexp_replace(t, r"(?U),([\s]+[A-Z][a-z ])", ".$1")),
    ("paragraph numbers", lambda t: F.regexp_replace(t, r"(?U)\n[ \t]*([^\d]{0,1}[\d]{1,2}[^\d])+[ \t]*", "\n")),
    ("wrapped lines", lambda t: wrapped_lines_joined(t, least=0)),
    ("quotation marks", lambda t: T.marks_replaced(t, "„“", '"')),
    ("long lines", long_lines_split),
    ("brackets", lambda t: F.regexp_replace(t, r"\([^\n()]*\)", "")),
    ("full stops at line ends", lambda t: F.regexp_replace(t, r"([^\n ])[ ]*\n", "$1.\n")),
    ("colons behind names", lambda t: F.regexp_replace(t, r'(?U)(([Nn]ázev|[Pp]opis)[^\n,.:"()]{5,})(\s[A-Z][^\n:]{10})', "$1:$3")),
    ("colons", lambda t: T.marks_replaced(t, [":"], ":.")),
    ("marks before full stops", lambda t: T.marks_replaced(t, [";.", ",."], ".")),
    ("doubled full stops", lambda t: T.marks_replaced(t, [".."], ".")),
    ("spaces before full stops", lambda t: F.regexp_replace(t, r"[ ]*\.", ".")),
    ("end", lambda t: T.with_line(t, "\n")),
)
#: What is looked for in a cleaned context, in this order.
EXTRACTION: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("ITEM", items_by_structure),
    ("ITEM", items_by_two_characters),
    ("ITEM", lambda rows: T.items_after_colon(rows, r"(?d)(zboží|položk).{0,10}:")),
    ("ITEM", items_under_header),
    ("CONTRACT_NAME", quoted_names_of),
    ("CONTRACT_NAME", structured_names_of),
)
