"""Where a document speaks of its subject: weighted keywords, their histogram, its rising edges, and where a context ends."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import keywords as K
from ..functions import text as T
from .nearest import top_k

#: Keywords of a subject context with their weights.
KEYWORDS = {
    "Předmět smlouvy": 10,
    "Předmět díla": 10,
    "Předmět plnění": 10,
    "Předmět veřejné zakázky": 10,
    "Vymezení předmětu": 10,
    "Vymezení plnění": 10,
    "Popis předmětu": 10,
    "Název veřejné zakázky": 3,
    "Veřejná zakázka": 1,
    "Veřejné zakázce": 1,
    "Předmět": 1,
    "Popis": 1,
}
#: Characters of a context, bins to a context, contexts to a document, and how far a context may reach.
RANGE, BINS, CONTEXTS, REACH = 2040, 3, 10, 3
#: Words that headings and lists of goods have.
ARTICLE, NAME, GOODS, TOPICS = "článek", "název", "Zboží", ("cena", "doba", "místo")
#: Characters of a block of text, and of those before and after it that belong to it as well.
_BLOCK, _BEHIND, _AHEAD = 512, 32, 160


def _blocks(text: Column) -> Column:
    """The text in overlapping blocks, so that what stands around a place is cut out of a block, not of the whole text."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / _BLOCK).cast("int")), lambda k: F.substring(text, F.greatest(k * _BLOCK - _BEHIND, F.lit(0)) + 1, F.lit(_BEHIND + _BLOCK + _AHEAD)))


def occurrences(docs: DataFrame, keywords: dict[str, float] = KEYWORDS, key: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """(key, keyword, occ, rat) of every occurrence of a keyword, in either case; with ``most``, of so many from the left.

    A rating is the keyword's weight times a coefficient that signs of a heading or of a defining sentence raise. Rows
    of occurrences carry the few characters around them, not the text.
    """

    weights = F.create_map(*(x for k, w in keywords.items() for x in (F.lit(k), F.lit(float(w)))))

    def around(hit: Column) -> Column:
        p = hit["occ"]
        block, off = F.get("_blocks", F.floor(p / _BLOCK).cast("int")), F.least(p, p % _BLOCK + F.when(p >= _BLOCK, _BEHIND).otherwise(0)).cast("int")
        return F.struct(hit["keyword"].alias("keyword"), p.alias("occ"), F.substring(block, F.greatest(off - 20, F.lit(0)) + 1, F.least(off, F.lit(20))).alias("behind"), F.substring(block, off + 1, F.lit(_AHEAD)).alias("ahead"))

    blocked = docs.select(key, K.hits(F.col(text), list(keywords), most).alias("_hits"), _blocks(F.col(text)).alias("_blocks"))
    each = blocked.select(key, F.inline(F.transform("_hits", around))).withColumn("weight", F.try_element_at(weights, "keyword"))
    behind, n = F.col("behind"), F.length("keyword")
    ahead = lambda size: F.substring(F.col("ahead"), F.lit(1), size)
    plus = lambda condition, by: F.when(condition, by).otherwise(0.0)
    alone = ((behind == "") | F.endswith(behind, F.lit("\n"))) & F.substring(F.col("ahead"), n + 1, F.lit(1)).isin("", "\n")
    coefficient = (
        F.lit(1.0)
        + plus(alone, 2.0)
        + plus(ahead(n) == F.col("keyword"), 1.5)
        + plus(ahead(n) == F.upper("keyword"), 1.5)
        + plus(F.contains(ahead(n * 3), F.lit("\n")), 2.0)
        + plus(behind.rlike("\n[ ]*[0-9]"), 2.0)
        + plus(F.contains(ahead(n * 2), F.lit(" je ")), 2.0)
        + plus(F.contains(F.lower(behind), F.lit(ARTICLE)), 2.0)
        + plus(F.length(behind) - F.length(F.replace(behind, F.lit("I"), F.lit(""))) > 1, 2.0)
        + T.letter_ratio(F.substring("ahead", 51, 50))
    )
    halved = F.when(F.contains(ahead(F.lit(150)), F.lit(GOODS)), 0.5).otherwise(1.0)
    return each.select(key, "keyword", "occ", (F.col("weight") * coefficient * halved).alias("rat"))


def edge_score(value: str, order: WindowSpec) -> Column:
    """How much a series rises at a place: the kernel (1, 1, 2, -2, -1, -1) from two places ahead to three behind; 0 outside."""
    out = None
    for shift, factor in zip((2, 1, 0, -1, -2, -3), (1, 1, 2, -2, -1, -1), strict=True):
        term = factor * (F.col(value) if shift == 0 else F.lead(value, shift, 0.0).over(order) if shift > 0 else F.lag(value, -shift, 0.0).over(order))
        out = term if out is None else out + term
    return out


def histogram(docs: DataFrame, keywords: dict[str, float] = KEYWORDS, key: str = "doc_id", text: str = "text", span: int = RANGE) -> DataFrame:
    """(key, bin, weight): summed ratings a bin of a third of a context, on every bin of the text."""
    width = span // BINS
    padded = docs.select(key, F.expr(f"rpad({text}, (length({text}) div {width} + 1) * {width}, ' ')").alias("text"))
    grid = docs.select(key, F.explode(F.expr(f"sequence(0, cast(length({text}) div {width} as int))")).alias("bin"))
    summed = occurrences(padded, keywords, key).groupBy(key, F.expr(f"cast(occ div {width} as int)").alias("bin")).agg(F.sum("rat").alias("weight"))
    return grid.join(summed, [key, "bin"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def starts(docs: DataFrame, keywords: dict[str, float] = KEYWORDS, key: str = "doc_id", text: str = "text", span: int = RANGE) -> DataFrame:
    """(key, start, score) of the bins whose edge score is above two thirds of the document's highest."""
    scored = histogram(docs, keywords, key, text, span).withColumn("score", edge_score("weight", Window.partitionBy(key).orderBy("bin")))
    best = scored.withColumn("best", F.max("score").over(Window.partitionBy(key)))
    # Rounded: sums of the same ratings in another order, or a score of exactly two thirds, may differ in the last bit.
    return best.where("round(score, 9) > round(best * 2 / 3, 9)").select(key, (F.col("bin") * (span // BINS)).alias("start"), "score")


def fixed_contexts(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", span: int = RANGE) -> DataFrame:
    """(key, start, end, context) of one length."""
    joined = found.join(docs.select(key, F.col(text).alias("_text")), key)
    end = F.least(F.col("start") + span, F.length("_text"))
    return joined.select(key, "start", end.alias("end"), F.substring(F.col("_text"), F.col("start") + 1, F.greatest(end - F.col("start"), F.lit(0))).alias("context"))


def refined_starts(docs: DataFrame, found: DataFrame, keywords: dict[str, float] = KEYWORDS, key: str = "doc_id", text: str = "text", span: int = RANGE, contexts: int = CONTEXTS) -> DataFrame:
    """(key, start): of the ``contexts`` best starts each moves to its best occurrence inside its window; equal ones are one."""
    few = top_k(found, F.round("score", 9).desc(), contexts, [key], ["start"])
    windows = fixed_contexts(docs, few, key, text, span).withColumn("_window", F.struct(key, "start"))
    best = occurrences(windows.select("_window", F.col("context").alias("text")), keywords, "_window").groupBy("_window").agg(F.min_by("occ", F.struct((-F.round("rat", 9)).alias("r"), "occ")).alias("occ"))
    return windows.select("_window").join(best, "_window", "left").select(F.col(f"_window.{key}").alias(key), (F.col("_window.start") + F.coalesce("occ", F.lit(0))).alias("start")).distinct()


def _line(text: str, at: int) -> str:
    end = text.find("\n", at)
    return text[text.rfind("\n", 0, at) + 1 : len(text) if end < 0 else end]


#: Patterns of numbered, Roman and capital headings, and of quotation marks.
_NUMBERED, _NUMBER_BEFORE = re.compile("\n[ \t]*\\d+[^/]"), re.compile("\n[ \t]*(\\d+)(?:(?=[^/])|(?<=\\d\\d))")
_ROMAN, _CAPITALS = re.compile(r"\s(?=[XVI])(X{0,3})(I[XV]|V?I{0,3})[\s\W]+"), re.compile("[A-ZĚŠČŘŽÝÁÍÉÚŮŇŤÓĎ ]{4,}")
_OPENING, _CLOSING = re.compile('[„"]'), re.compile('["“]')
#: Characters of a short line and of one that goes on, and how near a trigger must be.
_SHORT, _LONG, _NEAR = 50, 30, 50


def _any_case(word: str) -> re.Pattern:
    return re.compile(word, re.IGNORECASE)


def _heading(line: str) -> bool:
    m = _CAPITALS.search(line)
    return bool(m) and len(m[0]) > len(line) / 2


def _next_number(text: str, at: int, trigger: re.Match) -> bool:
    """A short line of few digits whose number is the trigger's next or the one after."""
    number, line = re.search(r"\d+", text[at : at + 10]), _line(text, at + 1)
    return bool(number) and 0 < int(number[0]) - int(trigger[1]) < 3 and len(line) < _SHORT and len(re.findall(r"\d", line)) <= 5


@dataclass(frozen=True)
class EndRule:
    """Where a context may end: at the first match of ``mark`` that ``accepts`` says yes to, from ``start`` on or from the trigger's place
    (``after_trigger``), if ``trigger`` (its last match) stands within ``behind`` and ``ahead`` characters of the start."""

    name: str
    mark: re.Pattern
    accepts: Callable[[str, int, re.Match | None], bool]
    trigger: re.Pattern | None = None
    behind: int = 0
    ahead: int = 0
    after_trigger: bool = False
    shift: int = 0

    def find(self, text: str, start: int, end: int) -> int:
        """The place, or 0."""
        said, begin = None, start
        if self.trigger is not None:
            low = max(start - self.behind, 0)
            found = list(self.trigger.finditer(text[low : start + self.ahead]))
            if not found:
                return 0
            said = found[0] if self.after_trigger else found[-1]
            begin = low + said.start() if self.after_trigger else start
        places = (begin + m.start() for m in self.mark.finditer(text[begin:end]))
        return next((at + self.shift for at in places if self.accepts(text, at, said)), 0)


@dataclass(frozen=True)
class CapitalsRule(EndRule):
    """A heading in capitals ends at the next one."""

    def find(self, text: str, start: int, end: int) -> int:
        line = _line(text, start)
        return EndRule.find(self, text, start + len(line), end) if _heading(line) else 0


def _short_line(shift: int) -> Callable[[str, int, re.Match | None], bool]:
    return lambda text, at, _: len(_line(text, at + shift)) < _SHORT


#: In this order the first that finds an end decides.
END_RULES: tuple[EndRule, ...] = (
    EndRule("numbered", _NUMBERED, _next_number, _NUMBER_BEFORE, behind=_NEAR),
    EndRule("roman", _ROMAN, _short_line(1), _ROMAN, behind=_NEAR),
    EndRule("article", _any_case(ARTICLE), _short_line(0), _any_case(ARTICLE), behind=_NEAR),
    CapitalsRule("capitals", re.compile(_CAPITALS.pattern, re.IGNORECASE), lambda text, at, _: _heading(_line(text, at))),
    EndRule("named", re.compile("\n"), lambda text, at, _: len(_line(text, at)) > _LONG, _any_case(NAME), behind=_NEAR, ahead=_NEAR),
    EndRule("quoted", _CLOSING, lambda *_: True, _OPENING, ahead=_NEAR, after_trigger=True, shift=1),
    *(EndRule(f"topic {word}", _any_case(word), _short_line(0)) for word in TOPICS),
)


def reach_end(text: str, start: int, span: int = RANGE, reach: int = REACH) -> int:
    """Where a context ends at the latest: at the next file's header, or after ``reach`` spans."""
    end = min(start + span * reach, len(text))
    mark = _any_case("<FILE").search(text[start:end])
    return start + mark.start() if mark else end


def context_end(text: str, start: int, span: int = RANGE, reach: int = REACH) -> int:
    """Where the context that starts at ``start`` ends: what the first rule with a finding says, else ``reach_end``."""
    end = reach_end(text, start, span, reach)
    return next(filter(None, (rule.find(text, start, end) for rule in END_RULES)), end)


@F.pandas_udf(IntegerType())
def context_ends(text: pd.Series, start: pd.Series) -> pd.Series:
    return pd.Series([context_end(t, int(s)) for t, s in zip(text, start, strict=True)], dtype="int32")


def contexts(docs: DataFrame, keywords: dict[str, float] = KEYWORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, context): refined starts with detected ends."""
    first = refined_starts(docs, starts(docs, keywords, key, text), keywords, key, text)
    placed = first.join(docs.select(key, F.col(text).alias("_text")), key).select(key, "start", "_text", context_ends("_text", "start").alias("end"))
    return placed.select(key, "start", "end", F.substring(F.col("_text"), F.col("start") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0))).alias("context"))
