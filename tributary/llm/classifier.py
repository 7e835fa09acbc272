"""Operator 13: quality by histogram gradient-boosted trees over a document's statistics.

A text's statistics (STATISTICS) count characters by class, words and their lengths, sentences, lines and what repeats; all
are taken from the whole text by array operations. Fitting reads labelled rows only: of those whose crc32 of the id is not
divisible by FOLDS a sample of about TRAIN_ROWS, drawn by a hash of the id. Their statistics are computed in Spark; the
matrix, at most TRAIN_ROWS rows of a few numbers, is cut into at most BINS quantile bins for each statistic. Each tree
is grown level by level: a level's histograms of gradients and second derivatives, one for each node, statistic and bin,
give every node's best cut, and rows go left or right of it. Copies of one text weigh together as one row, so that large
groups of copies do not outvote others. Every fifth row in the order of the statistics is kept back, to
tell how many trees are worth keeping.

A model is three arrays: for each tree and inner node, in breadth-first order, a statistic and a bound, and for each leaf a
value. A batch of documents goes down all trees at once: one comparison of a matrix for each level. Scoring is one pass
without a shuffle. Language, source, ids and labels never enter a score.

Edge cases: null and empty texts have statistics like others (zeros) and get a score; repeated rows score the same; several
labels of one document count as their maximum, null labels as none; labels of one kind, or none, give every text the
same score, their smoothed share; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, tidy

FOLDS, TRAIN_ROWS = 5, 40_000
BINS, DEPTH, TREES, RATE = 64, 4, 150, 0.1
#: Least weight of a leaf, its penalty, and the trees without gain after which growing ends.
LEAST, PENALTY, PATIENCE = 4.0, 1.0, 20
#: Classes of characters, by Unicode's general categories.
CLASSES = {"other": "", "lower": "Ll", "upper": "Lu Lt", "letter": "Lo Lm", "digit": "Nd Nl No", "space": "Zs Zl Zp", "control": "Cc Cf", "punctuation": "Po Pd Ps Pe Pi Pf Pc", "symbol": "Sm Sc Sk So", "mark": "Mn Mc Me"}
_NUMBER = {name: k for k, name in enumerate(CLASSES)}

STATISTICS = (
    *("chars", "words", "lines", "sentences"),
    *(f"{name}_share" for name in CLASSES),
    *("mixed_words", "word_mean", "word_deviation", "word_longest", "short_words", "long_words", "capital_words", "upper_words", "letterless_words", "signed_words"),
    *("distinct_words", "commonest_word", "repeated_triples", "line_mean", "line_longest", "repeated_lines", "unended_lines", "bullet_lines", "sentence_mean", "entropy", "commonest_character"),
)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class number of each code point of the basic plane; white space is what ``str.split`` splits at."""
    of = {category: _NUMBER[name] for name, categories in CLASSES.items() for category in categories.split()}
    return np.array([_NUMBER["space"] if chr(c).isspace() else of.get(unicodedata.category(chr(c)), 0) for c in range(0x10000)], np.uint8)


_LETTERS, _SIGNS = (np.array([name in names for name in CLASSES]) for names in (("lower", "upper", "letter", "mark"), ("punctuation", "symbol")))
_UPPER = np.array([name == "upper" for name in CLASSES])


def _repeated(values: np.ndarray) -> float:
    """Share of values that stood before."""
    return 1 - len(np.unique(values)) / len(values) if len(values) else 0.0


def statistics(text: str) -> list[float]:
    """The numbers named in STATISTICS."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, words = len(points), text.split()
    kinds = _classes()[np.minimum(points, 0xFFFF)]
    shares = np.bincount(kinds, minlength=len(CLASSES)) / max(1, n)
    lines = [x for x in text.split("\n") if x.strip()]
    widths = [len(x) for x in lines] or [0]
    blanks = [math.log1p(n), math.log1p(len(words)), math.log1p(len(lines))]
    if not words:
        return [*blanks, 0.0, *shares.tolist(), *[0.0] * (len(STATISTICS) - 4 - len(CLASSES))]
    few, sizes = len(words), np.fromiter(map(len, words), np.int64)
    blank = kinds == _NUMBER["space"]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    first, last = kinds[starts], kinds[starts + sizes - 1]
    # Sums from one word's start to the next one's; white space between them has neither letters nor capitals.
    n_letters, n_upper = (np.add.reduceat(of[kinds], starts, dtype=np.int64) for of in (_LETTERS, _UPPER))
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64)
    triples = (ids[:-2] * len(number) + ids[1:-1]) * 0x9E3779B97F4A7C1 + ids[2:]  # as numbers, modulo 2^64
    end = points[starts + sizes - 1]
    ended = int(((end == 46) | (end == 33) | (end == 63) | (end == 0x3002)).sum())
    mean = float(sizes.sum()) / few
    seen = np.bincount(np.minimum(points, 0xFFF))
    p = seen[seen > 0] / n
    return [
        *blanks, math.log1p(ended), *shares.tolist(),
        float((n_letters < sizes).sum()) / few, mean, math.sqrt(max(0.0, float(sizes @ sizes) / few - mean * mean)), float(sizes.max()),
        float((sizes < 3).sum()) / few, float((sizes > 12).sum()) / few, float(_UPPER[first].sum()) / few, float(((n_upper == n_letters) & (n_letters > 1)).sum()) / few,
        float((n_letters == 0).sum()) / few, float(_SIGNS[last].sum()) / few,
        len(number) / few, float(np.bincount(ids).max()) / few, _repeated(triples),
        math.log1p(sum(widths) / len(widths)), math.log1p(max(widths)), 1 - len(set(lines)) / len(lines), sum(not x.rstrip().endswith((".", "!", "?", ":", "。")) for x in lines) / len(lines),
        sum(x.lstrip().startswith(("-", "*", "•", "·", "–", "#", "|")) for x in lines) / len(lines), few / max(1, ended), float(-(p * np.log2(p)).sum()), float(p.max()),
    ]


@dataclass
class Model:
    """``split`` and ``bound``: trees x inner nodes in breadth-first order; ``leaf``: trees x leaves."""

    base: float
    split: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of each row: all trees go down one level at a time."""
        trees, inner = self.split.shape
        if not trees or not len(rows):
            return np.full(len(rows), self.base)
        each = np.arange(trees)[None, :]
        node = np.zeros((len(rows), trees), np.int32)
        at = np.arange(len(rows))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (rows[at, self.split[each, node]] > self.bound[each, node])
        return self.base + self.leaf[each, node - inner].sum(axis=1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def edges(rows: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each statistic, ascending bounds between bins of about equal numbers of rows; a value goes left of a bound if it is no larger."""
    found = []
    for column in rows.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="lower"))
        found.append((values[:-1] + values[1:]) / 2)
    return found


def grow(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, kept_back: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Boosted trees of logistic loss; rows marked in ``kept_back`` only tell when to stop."""
    share = float((weights * labels).sum() + 0.5) / float(weights.sum() + 1)
    base, inner = math.log(share / (1 - share)), 2**depth - 1
    empty = Model(base, np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(np.unique(labels[~kept_back])) < 2:
        return empty
    bounds = edges(rows[~kept_back])
    width = max(len(b) for b in bounds) + 1
    binned = np.stack([np.searchsorted(b, column) for b, column in zip(bounds, rows.T, strict=True)], axis=1)
    offset = np.arange(rows.shape[1]) * width
    margin, train = np.full(len(rows), base), np.where(kept_back, 0.0, weights)
    splits, cuts, leaves, losses = [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = train * (p - labels), train * np.maximum(p * (1 - p), 1e-6)
        split, cut, bound = np.zeros(inner, np.int32), np.full(inner, width), np.full(inner, np.inf)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            cells = ((node - first)[:, None] * (width * rows.shape[1]) + offset + binned).ravel()
            shape = (n, rows.shape[1], width)
            sums = [np.bincount(cells, np.repeat(x, rows.shape[1]), math.prod(shape)).reshape(shape).cumsum(axis=2) for x in (g, h, train)]
            (gl, hl, wl), (gt, ht, wt) = sums, [x[:, :, -1:] for x in sums]
            gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
            gain[(wl < LEAST) | (wt - wl < LEAST)] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            use = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
            at = np.arange(first, first + n)[use]
            split[at], cut[at] = best[use] // width, best[use] % width
            bound[at] = [bounds[s][c] for s, c in zip(split[at], cut[at], strict=True)]
            node = 2 * node + 1 + (binned[np.arange(len(rows)), split[node]] > cut[node])
        leaf = -np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + PENALTY) * RATE
        margin += leaf[node - inner]
        splits, cuts, leaves = [*splits, split], [*cuts, bound], [*leaves, leaf]
        losses.append(float((weights * np.logaddexp(0, np.where(labels > 0, -margin, margin)))[kept_back].sum()))
        if kept_back.any() and len(losses) - int(np.argmin(losses)) > PATIENCE:
            break
    n = int(np.argmin(losses)) + 1 if kept_back.any() else len(losses)
    return Model(base, np.array(splits[:n]), np.array(cuts[:n]), np.array(leaves[:n]))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Model of the labelled rows of ``df`` (doc_id, text) outside the held-out fold; ``labels``: (doc_id, quality)."""
    marks = labels.where("quality is not null and doc_id is not null").where(~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    total = marks.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < (1_000_000 if total <= train_rows else int(1_000_000 * train_rows / total))
    # At most about TRAIN_ROWS ids of 12 bytes: broadcast.
    sample = documents(df).join(F.broadcast(marks.where(part)), "doc_id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["quality", "found"])

    # Copies and near copies have the same statistics: one row, with the share of its good labels.
    rows = sample.mapInArrow(tidy(run), "quality int, found array<double>").groupBy("found").agg(F.avg("quality").alias("quality")).orderBy("found").collect()
    if not rows:
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0), np.zeros(0), np.zeros(0, bool))
    matrix = np.array([r["found"] for r in rows])
    target = np.array([float(r["quality"] >= 0.5) for r in rows])
    back = np.arange(len(rows)) % FOLDS == 0
    return grow(matrix, target, np.ones(len(rows)), back)


def judged(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Query op13: every document's score and prediction by a model of the rows outside the held-out fold."""
    found = score(df, fit(df, labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows), pa.float64())], names=[id_col, "score"])

    return documents(df, id_col, text_col, id_col).mapInArrow(tidy(run), f"`{id_col}` long, score double")
