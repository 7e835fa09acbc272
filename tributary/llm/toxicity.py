"""Operator 3: toxicity by a learned lexicon, matched also in misspelled form, and weighed by its context.

Fitting reads labelled rows only: of those whose crc32 of the id is not divisible by FOLDS a sample of about TRAIN_ROWS,
drawn by a hash of the id. All terms that toxic texts use more than chance explains make the lexicon (a log-likelihood
ratio test, corrected for the number of terms, over distinct neighbourhoods, so that copies of one text count once) where
their odds in toxic texts are over ODDS times those in clean ones, which any share of toxic labels leaves possible.
The lexicon is a trie, and a word is looked up by running its Levenshtein automaton along the trie: one edit for words
of 5 letters or more, two from 9; digits may stand in words, and where such a word is no term its runs of letters are
looked up. A term whose misspellings clean texts contain as often as toxic ones is matched
exactly only. Each match has a score from 0, abuse, to 1, quotation: 1 inside a pair of quotation marks, and otherwise
the more the nearer a word of reporting stands in its context window of CONTEXT words. A match counts by one less its
score as plain or misspelled abuse and by its score as quotation. A ridge-penalised logistic regression turns these
three sums, on a logarithmic scale in half steps, into a text's score; it is fitted to the table of their combinations.

Fitting is bounded by TRAIN_ROWS and runs as Spark jobs; scoring is one pass without a shuffle. Language,
source, ids and labels never enter a score.

Edge cases: null and empty texts score as texts without a match; repeated rows score the same; several labels of one
document count as their maximum, null labels as none; without usable labels the lexicon is empty and every score is
the prior; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, give_back, release, settle, tidy

FOLDS, TRAIN_ROWS, ODDS, CONTEXT = 5, 40_000, 3, 6
_WORD, _LETTERS = re.compile(r"(?<![^\W_])\d*+[^\W\d_][^\W_]*"), re.compile(r"[^\W\d_]+")
#: Quotation marks by family: the first mark of a family opens and the next one closes, but for those that only close.
_FAMILIES, _CLOSING = ('"“”„', "«»", "‘’", "`"), "’"
_MARK = re.compile('["“”„«»‘’`]')
#: Words of reporting that mark a quotation.
REPORTING = frozenset("said says quote quoted quotes called calling word words term wrote reported citing dit mot cite sagte wort zitat dijo palabra cita".split())
_MEMO = 200_000


class Quoted:
    """Whether a stretch of a text lies inside a quotation."""

    def __init__(self, text: str):
        pairs = sorted(quotations(text))
        self.starts = [a for a, _ in pairs]
        #: The farthest end of a quotation that begins no later.
        self.ends = list(accumulate((b for _, b in pairs), max))

    def holds(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, start)
        return k > 0 and self.ends[k - 1] >= end


def quotations(text: str) -> list[tuple[int, int]]:
    """Where quotations begin and end: marks of one family in turn within a line; a mark between letters or digits is none."""
    out, opened, last = [], {}, 0
    for m in _MARK.finditer(text):
        at, mark = m.start(), m[0]
        if text[at - 1 : at].isalnum() and text[at + 1 : at + 2].isalnum():
            continue
        if text.find("\n", last, at) >= 0:
            opened = {}
        last = at
        family = next(k for k, marks in enumerate(_FAMILIES) if mark in marks)
        if family in opened:
            out.append((opened.pop(family), at))
        elif mark not in _CLOSING:
            opened[family] = at
    return out


class Trie:
    """Lexicon as nested dictionaries; the term's number stands under the empty string."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for k, term in enumerate(terms):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = k

    def nearest(self, word: str, edits: int) -> tuple[int, int] | None:
        """(edits, term) of the closest term within ``edits`` of the word, the first of equals.

        State: one bit set of matched prefix lengths of the word for each number of edits so far. Branches whose sets are
        all empty end.
        """
        m = len(word)
        full, accept = (1 << (m + 1)) - 1, 1 << m
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        best: tuple[int, int] | None = None
        stack = [(self.root, tuple((1 << (d + 1)) - 1 for d in range(edits + 1)))]
        while stack:
            node, states = stack.pop()
            for c, below in node.items():
                if c == "":
                    d = next((d for d, s in enumerate(states) if s & accept), None)
                    if d is not None and (best is None or (d, below) < best):
                        best = (d, below)
                    continue
                mask, alive, out = masks.get(c, 0), 0, []
                for d, s in enumerate(states):
                    step = (s & mask) << 1
                    if d:
                        step |= states[d - 1] | states[d - 1] << 1 | out[-1] << 1
                    out.append(step & full)
                    alive |= out[-1]
                if alive:
                    stack.append((below, tuple(out)))
        return best


@dataclass
class Model:
    terms: list[str]
    fuzzy: list[bool]
    #: Of the constant and of plain, misspelled and quoted matches.
    weights: list[float]

    def probability(self, found: list[tuple[int, int, float]]) -> float:
        z = self.weights[0] + sum(a * b for a, b in zip(self.weights[1:], features(found), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def edits_for(n: int) -> int:
    return 0 if n < 5 else 1 if n < 9 else 2


def most_edits(n: int) -> int:
    """Edits of the words that may be misspellings of a term of ``n`` letters."""
    return max(edits_for(n + d) for d in range(3) if edits_for(n + d) >= d)


class Matcher:
    """Finds a text's matches; remembers words it has seen."""

    def __init__(self, terms: list[str], fuzzy: list[bool] | None = None):
        self.trie, self.exact = Trie(terms), {t: k for k, t in enumerate(terms)}
        self.fuzzy = fuzzy or [True] * len(terms)
        parts: dict[str, set[tuple[int, int]]] = {}
        for t, on in zip(terms, self.fuzzy, strict=True):
            pieces = most_edits(len(t)) + 1
            if on and pieces > 1:
                cut = [len(t) * k // pieces for k in range(pieces + 1)]
                for a, b in zip(cut, cut[1:]):
                    parts.setdefault(t[a:b], set()).add((a, len(t)))
        #: Some part of a term stands unchanged in every misspelling of it, moved by no more letters than there are edits.
        self.parts, self.sizes = parts, sorted({len(x) for x in parts})
        self.memo: dict[str, tuple[int, int] | None] = {}

    def _look(self, word: str) -> tuple[int, int] | None:
        found = self._look_whole(word)
        if found is None and not word.isalpha():
            found = min(filter(None, map(self._look_whole, _LETTERS.findall(word))), default=None)
        return found

    def _look_whole(self, word: str) -> tuple[int, int] | None:
        if word in self.exact:
            return 0, self.exact[word]
        edits = edits_for(len(word))
        if not edits or not self._shares_a_part(word, edits):
            return None
        found = self.trie.nearest(word, edits)
        return found if found and self.fuzzy[found[1]] else None

    def _shares_a_part(self, word: str, edits: int) -> bool:
        m, parts = len(word), self.parts
        for n in self.sizes:
            for a in range(m - n + 1):
                if (part := word[a : a + n]) in parts and any(abs(a - b) <= edits and abs(m - k) <= edits for b, k in parts[part]):
                    return True
        return False

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(edits, term, context score) of every match, in order."""
        low = text.lower()
        words = _WORD.findall(low)
        memo, hit = self.memo, {}
        for w in set(words):
            if w in memo:
                found = memo[w]
            else:
                if len(memo) >= _MEMO:
                    memo.clear()
                found = memo[w] = self._look(w)
            if found is not None:
                hit[w] = found
        if not hit:
            return []
        out = []
        places, quoted = [m.span() for m in _WORD.finditer(low)], Quoted(low)
        for k, w in enumerate(words):
            if w in hit:
                a, b = max(0, k - CONTEXT), min(len(words), k + CONTEXT + 1)
                marked = quoted.holds(*places[k])
                near = min((abs(j - k) for j in range(a, b) if words[j] in REPORTING), default=CONTEXT + 1)
                out.append((*hit[w], 1.0 if marked else 1 - max(0, near - 1) / CONTEXT))
        return out


def level(x: float) -> float:
    """A sum on a logarithmic scale, in half steps."""
    return math.floor(2 * math.log2(1 + x) + 0.5) / 2


def features(found: list[tuple[int, int, float]]) -> tuple[float, float, float]:
    """Levels of plain abuse, of misspelled abuse and of quotation."""
    return level(sum(1 - q for d, _, q in found if d == 0)), level(sum(1 - q for d, _, q in found if d > 0)), level(sum(q for *_, q in found))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _lexicon(train: DataFrame, n_toxic: int, n: int) -> list[str]:
    """Terms of toxic texts, strongest first; ``train``: (toxic, words)."""
    count = train.select("toxic", F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    tested = settle(count.where("pos > 2"))
    terms = tested.count()
    if not terms:
        return []
    near = "transform(sequence(1, size(words)), i -> struct(element_at(words, i) as term, xxhash64(try_element_at(words, i - 1 + if(i = 1, size(words), 0)), try_element_at(words, i + 1)) as near))"
    rate = math.log(n_toxic / n)
    # Before neighbourhoods are counted, only terms that could pass: those much more frequent in toxic texts.
    could = tested.where(F.expr(f"(pos + 0.5D) * ({n - n_toxic} - n + pos + 0.5D) > {ODDS} * (n - pos + 0.5D) * ({n_toxic} - pos + 0.5D)")).select("term", "n", "pos")
    around = train.where("toxic = 1 and size(words) > 0").select(F.explode(F.expr(near)).alias("w")).select("w.term", "w.near").join(could, "term")
    kinds = around.groupBy("term", "near").agg(F.max("n").alias("n"), F.max("pos").alias("pos")).groupBy("term").agg(F.count("*").alias("kinds"), F.max("n").alias("n"), F.max("pos").alias("pos"))
    least = 2 * math.log(terms) + 6
    c = F.least("kinds", "pos").cast("double")
    others = (F.col("n") - F.col("pos")).cast("double")
    share = c / (c + others)
    ratio = 2 * (c * (F.log(share) - rate) + F.when(others > 0, others * (F.log(1 - share) - math.log(max(1e-9, 1 - n_toxic / n)))).otherwise(-others))
    odds = (c + 0.5) * (n - n_toxic - others + 0.5) > ODDS * (others + 0.5) * (n_toxic - c + 0.5)
    strong = kinds.select("term", ratio.alias("g"), share.alias("share"), odds.alias("odds")).where((F.col("g") > least) & (F.col("share") > n_toxic / n) & F.col("odds")).orderBy(F.desc("g"), "term")
    return [r["term"] for r in strong.collect()]


def _regression(table: list[tuple[tuple[float, float, float], int, int]], penalty: float = 0.5) -> list[float]:
    """Newton's method on counts ((features), toxic, all); weights shrink to PRIOR, so what is never seen keeps sense."""
    prior = np.array([0.0, 2.0, 1.5, 0.3])
    x = np.array([[1, *f] for f, _, _ in table], dtype=float)
    pos, n = (np.array([t[k] for t in table], dtype=float) for k in (1, 2))
    w, ridge = prior.copy(), np.diag([1e-3, penalty, penalty, penalty])
    w[0] = math.log((pos.sum() + 0.5) / (n.sum() - pos.sum() + 1.5))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (pos - n * p) - ridge @ (w - np.array([w[0], *prior[1:]])))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Model of the labelled rows of ``df`` (doc_id, text) outside the held-out fold; ``labels``: (doc_id, toxic)."""
    marks = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = marks.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < (1_000_000 if total <= train_rows else int(1_000_000 * train_rows / total))
    # At most about TRAIN_ROWS ids of 12 bytes: broadcast.
    sample = documents(df).join(F.broadcast(marks.where(part)), "doc_id")
    train = settle(sample.select("toxic", "text", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("words")))
    n, n_toxic = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = math.log((n_toxic + 0.5) / (n - n_toxic + 1.5))
    terms = _lexicon(train, n_toxic, n) if 0 < n_toxic < n else []
    if not terms:
        return Model([], [], [prior, 0.0, 0.0, 0.0])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            found = [matcher.matches(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[t if d == 0 else -t - 1 for d, t, q in f] for f in found], pa.list_(pa.int32())), pa.array([[q for *_, q in f] for f in found], pa.list_(pa.float64()))], names=["toxic", "terms", "quoted"])

    found = settle(train.select("toxic", "text").mapInArrow(tidy(find), "toxic int, terms array<int>, quoted array<double>"))
    near = found.select("toxic", F.explode(F.array_distinct(F.filter("terms", lambda t: t < 0))).alias("t")).groupBy("t").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).collect()
    fuzzy = [True] * len(terms)
    for r in near:
        fuzzy[-r["t"] - 1] = r["pos"] * (n - n_toxic) > 3 * (r["n"] - r["pos"]) * n_toxic
    on = F.lit("".join("01"[x] for x in fuzzy))
    use = F.expr("filter(arrays_zip(terms, quoted), z -> z.terms >= 0 or substring(on, -z.terms, 1) = '1')")
    sums = ("filter(m, z -> z.terms >= 0), 0D, (s, z) -> s + 1 - z.quoted", "filter(m, z -> z.terms < 0), 0D, (s, z) -> s + 1 - z.quoted", "m, 0D, (s, z) -> s + z.quoted")
    counted = found.withColumn("on", on).select("toxic", use.alias("m")).select("toxic", *(F.expr(f"floor(2 * log2(1 + aggregate({x})) + 0.5D) / 2D").alias(f"f{i}") for i, x in enumerate(sums)))
    rows = counted.groupBy("f0", "f1", "f2").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).collect()
    release(train, found)
    return Model(terms, fuzzy, _regression([((r["f0"], r["f1"], r["f2"]), r["pos"], r["n"]) for r in rows]))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_matches) of every row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms, model.fuzzy)
        for batch in batches:
            scores, n = [], []
            for text in batch.column(1).to_pylist():
                found = matcher.matches(text) if model.terms else []
                scores.append(model.probability(found))
                n.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(n, pa.int64())], names=[id_col, "score", "n_matches"])

    return documents(df, id_col, text_col, id_col).mapInArrow(tidy(run), f"`{id_col}` long, score double, n_matches long")


def judged(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Query op3: every document's score and prediction by a model of the rows outside the held-out fold."""
    found = score(df, fit(df, labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


def without_toxic(df: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that a model of its labelled rows does not call toxic, with all their columns."""
    model = fit(df, labels)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model.terms, model.fuzzy)
        for part in texts:
            yield part.map(lambda t: model.probability(matcher.matches(t) if model.terms else []))
        del matcher
        give_back()

    return df.where(scored(F.coalesce(F.col(text_col), F.lit(""))) < 0.5)
