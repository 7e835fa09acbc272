"""Operator 9: repeated passages, found by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the least of its word pairs, in an order
of hashes that puts frequent pairs last. Consecutive windows with one minimiser travel as one packed string to the
bucket of that minimiser, where equal windows meet; there sorting tells for each window which document has it first.
Every word that a window covers which also starts in a document with a smaller id is removed.

Scale: before anything is shuffled, windows that repeat within a task's batch are resolved there, so that a passage
copied a million times leaves each task once. Buckets are as many as the text needs at ``BUCKET_CHARS`` each. Their
payloads are compressed, about 1.5 times the input in all. Overlapping spans of a document are merged and written; they
are broadcast to the texts while they are at most ``BROADCAST_SPANS`` (16 MB), and joined by the planner's choice beyond.

Windows are compared by 64-bit fingerprints of their words, and equal fingerprints word by word; should two different
windows share one, all are fingerprinted anew with another multiplier. The result does not depend on the order of
minimisers, whose frequent pairs come from a sample of about ``SAMPLE_DOCUMENTS`` documents.

Edge cases: null, empty and short texts have no window and stay whole; rows with one id count as one document, and each
row is cleaned by the spans of all (give ids that are unique); rows with a null id stay whole and take nothing from
others, as they have no place in the order of ids; an empty table gives an empty result; only the id and the text are
read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, documents, give_back, settle, tidy, unused

WINDOW = 13
BUCKET_CHARS = 2_000_000
BATCH_CHARS = 1_000_000
BROADCAST_SPANS = 1_000_000
SAMPLE_DOCUMENTS = 20_000
FREQUENT_PAIRS = 4096
_WORD = re.compile(WORD)
_MASK = (1 << 64) - 1
_LAST = np.uint64(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hashes(vocabulary: dict[str, int]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))


def _pairs(words: np.ndarray) -> np.ndarray:
    """Hash of each word with its successor, below 2**63."""
    return _mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + _mixed(words[1:])) >> np.uint64(1)


def _fingerprints(words: np.ndarray, window: int, factor: int) -> np.ndarray:
    n, power, out = len(words) - window + 1, 1, np.zeros(max(0, len(words) - window + 1), dtype=np.uint64)
    for k in range(window):
        out += words[k : k + n] * np.uint64(power)
        power = power * factor & _MASK
    return _mixed(out)


def repeated(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, docs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For windows that start at ``starts`` in the words ``ids``: whether a smaller document among ``docs`` has the same."""
    out = np.zeros(len(starts), dtype=bool)
    factor = 0x2545F4914F6CDD1D
    while len(starts):
        prints = _fingerprints(hashes[ids], window, factor)[starts]
        order = np.lexsort((docs, prints))
        same = prints[order[1:]] == prints[order[:-1]]
        a, b = starts[order[:-1][same]], starts[order[1:][same]]
        if all(np.array_equal(ids[a + k], ids[b + k]) for k in range(window)):
            first = np.concatenate([[True], ~same])
            least = docs[order][np.flatnonzero(first)][np.cumsum(first) - 1]
            out[order] = docs[order] > least
            break
        factor = factor * 0x9E3779B97F4A7C15 & _MASK | 1
    return out


def _spans(starts: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) that cover windows given in order of documents and starts; runs of windows become one span."""
    if not len(starts):
        return docs, starts, starts
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at = np.flatnonzero(new)
    return docs[at], starts[at], starts[np.concatenate([at[1:], [len(starts)]]) - 1] + window


@cache
def _tools() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One pair for each worker."""
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _packed(arrays: list[np.ndarray], strings: list[str]) -> bytes:
    head = np.array([len(strings), len(arrays[0])], dtype=np.int64).tobytes()
    body = head + b"".join(a.astype(np.int64).tobytes() for a in arrays) + "\n".join(strings).encode("utf-8", "surrogatepass")
    return _tools()[0].compress(body)


def _unpacked(blob: bytes, n: int) -> tuple[list[np.ndarray], list[str]]:
    body = _tools()[1].decompress(blob)
    strings, size = np.frombuffer(body, dtype=np.int64, count=2)
    numbers = np.frombuffer(body, dtype=np.int64, offset=16, count=n * size).reshape(n, size)
    return list(numbers), body[16 + 8 * n * int(size) :].decode("utf-8", "surrogatepass").split("\n") if strings else []


class Batch:
    """Documents of one task, a few million characters at a time."""

    def __init__(self, buckets: int, frequent: np.ndarray, window: int):
        self.buckets, self.frequent, self.window = buckets, frequent, window
        self.clear()

    def clear(self) -> None:
        self.vocabulary: dict[str, int] = {}
        self.words: list[str] = []
        self.docs: list[int] = []
        self.sizes: list[int] = []
        self.chars = 0

    def add(self, doc: int, text: str) -> None:
        words = _WORD.findall(text)
        if len(words) >= self.window:
            self.words += words
            self.docs.append(doc)
            self.sizes.append(len(words))
            self.chars += len(text)

    def flush(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, super-k-mers, spans that are settled already)."""
        if not self.docs:
            return
        vocabulary, window = self.vocabulary, self.window
        ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in self.words), dtype=np.int32, count=len(self.words))
        hashes = _hashes(vocabulary)
        sizes = np.array(self.sizes)
        base = np.cumsum(sizes) - sizes
        doc_of = np.repeat(np.arange(len(sizes)), sizes - window + 1)
        starts = np.arange(len(doc_of)) - np.repeat(np.cumsum(sizes - window + 1) - (sizes - window + 1), sizes - window + 1) + base[doc_of]
        docs = np.array(self.docs, dtype=np.int64)[doc_of]
        later = repeated(ids, hashes, starts, docs, window)
        done = np.array(_spans((starts - base[doc_of])[later], docs[later], window))
        starts, docs, doc_of = starts[~later], docs[~later], doc_of[~later]
        pairs = _pairs(hashes[ids])
        del ids, hashes, later
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, pairs), len(self.frequent) - 1)
            pairs = np.where(self.frequent[at] == pairs, pairs | _LAST, pairs)
        least, width = pairs, 1
        while width < window - 1:
            step = min(width, window - 1 - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        least = least[starts]
        del pairs
        new = np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (least[1:] != least[:-1]) | (doc_of[1:] != doc_of[:-1])]) if len(starts) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(new)
        ends = starts[np.concatenate([at[1:], [len(starts)]]).astype(np.int64) - 1] + window if len(at) else at
        key = least[at]
        bucket = (_mixed(key) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        begin, run_docs, place = starts[at], docs[at], (starts - base[doc_of])[at]
        cut = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(order) else []
        words = self.words
        for part in np.split(order, cut[1:]) if len(order) else []:
            strings = [" ".join(words[a:b]) for a, b in zip(begin[part].tolist(), ends[part].tolist(), strict=True)]
            yield int(bucket[part[0]]), _packed([run_docs[part], place[part]], strings), b""
        if done.shape[1]:
            yield int(done[0][0]) % self.buckets, b"", _packed(list(done), [])
        self.clear()


def _frequent_pairs(rows: DataFrame, n_documents: int) -> np.ndarray:
    """Hashes of the word pairs that a sample of about SAMPLE_DOCUMENTS documents has most often, FREQUENT_PAIRS at most, sorted."""
    parts = max(1, n_documents // SAMPLE_DOCUMENTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: list[str] = []
            for text in batch.column(1).to_pylist():
                words += _WORD.findall(text)
            vocabulary: dict[str, int] = {}
            ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), dtype=np.int32, count=len(words))
            found, n = np.unique(_pairs(_hashes(vocabulary)[ids]), return_counts=True)
            keep = n >= 4
            yield pa.RecordBatch.from_arrays([pa.array(found[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64))], names=["pair", "n"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)
    top = sample.mapInArrow(tidy(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(FREQUENT_PAIRS)
    return np.array(sorted(r["pair"] for r in top.collect()), dtype=np.uint64)


def spans(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end): stretches of words of a document that windows cover which start in a smaller document too."""
    rows = documents(df, id_col, text_col).where("doc_id is not null")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    buckets = max(8, math.ceil(chars / BUCKET_CHARS))
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent_pairs(rows, n))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Batch(buckets, frequent.value, window)

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(kept.flush())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "super_kmers", "settled"])

        for batch in batches:
            for k in range(batch.num_rows):
                kept.add(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                if kept.chars >= BATCH_CHARS:
                    yield from out()
        yield from out()

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        found = [_unpacked(b, 3)[0] for b in rows["settled"] if b]
        vocabulary: dict[str, int] = {}
        runs, docs, places, sizes = [], [], [], []
        for blob in rows["super_kmers"]:
            if blob:
                (doc, place), strings = _unpacked(blob, 2)
                split = [s.split(" ") for s in strings]
                sizes.append(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
                runs.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for words in split for w in words), dtype=np.int32, count=int(sizes[-1].sum())))
                docs.append(doc)
                places.append(place)
        if runs:
            ids, size, doc, place = map(np.concatenate, (runs, sizes, docs, places))
            windows = size - window + 1
            run_of = np.repeat(np.arange(len(size)), windows)
            offset = np.arange(len(run_of)) - np.repeat(np.cumsum(windows) - windows, windows)
            starts = (np.cumsum(size) - size)[run_of] + offset
            later = repeated(ids, _hashes(vocabulary), starts, doc[run_of], window)
            where, which = (place[run_of] + offset)[later], doc[run_of][later]
            order = np.lexsort((where, which))
            found.append(_spans(where[order], which[order], window))
        d, s, e = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3))
        give_back()
        return pd.DataFrame({id_col: d, "start": s, "end": e})

    travelling = rows.mapInArrow(tidy(cut), "bucket int, super_kmers binary, settled binary")
    return travelling.groupBy("bucket").applyInPandas(count, f"`{id_col}` long, start long, end long")


def _kept(words: list[str], starts: list[int], ends: list[int]) -> list[str]:
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.asarray(starts, dtype=np.int64), 1)
    np.add.at(edge, np.asarray(ends, dtype=np.int64), -1)
    return [w for w, gone in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not gone]


#: SQL that merges sorted, overlapping spans ``s`` of structs (start, end).
_MERGED = (
    "aggregate(slice(s, 2, size(s)), slice(s, 1, 1), (m, x) -> if(x.start <= element_at(m, -1).end, "
    "array_append(slice(m, 1, size(m) - 1), named_struct('start', element_at(m, -1).start, 'end', greatest(element_at(m, -1).end, x.end))), array_append(m, x)))"
)


def _with_spans(df: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, str, str, str]:
    """``df`` with three more columns, and their names: id, starts and ends of its spans, null where nothing goes."""
    of, starts, ends = (unused(df, name) for name in ("span_of", "span_starts", "span_ends"))
    found = spans(df, window, id_col, text_col).groupBy(F.col(id_col).alias(of)).agg(F.collect_list(F.struct("start", "end")).alias("s"))
    gone = settle(found.select(of, F.array_sort("s").alias("s")).select(of, F.expr(_MERGED).alias("s")).select(of, F.col("s.start").alias(starts), F.col("s.end").alias(ends)))
    size = gone.agg(F.count("*") + F.coalesce(F.sum(F.size(starts)), F.lit(0))).first()[0]
    return df.join(F.broadcast(gone) if size <= BROADCAST_SPANS else gone, F.col(id_col) == F.col(of), "left"), of, starts, ends


def cleaned(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, text): the words that stay, joined by one space."""
    source, _, starts, ends = _with_spans(documents(df, id_col, text_col, id_col), window, id_col, "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for text, starts, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = _WORD.findall(text)
                kept = _kept(words, starts, ends) if starts else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                texts.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], names=[id_col, "n_words", "n_removed", "text"])

    return source.select(id_col, "text", starts, ends).mapInArrow(tidy(keep), f"`{id_col}` long, n_words long, n_removed long, text string")


def without_repeats(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the repeated words: texts that lose words become the rest, joined by one space; those that lose all go."""

    def rest(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([" ".join(_kept(_WORD.findall(t), s, e)) if len(s) else t for t, s, e in zip(texts, starts, ends, strict=True)], dtype=object)

    # Said to be nondeterministic, so that the filter on its result does not make it run twice.
    rest = F.pandas_udf(rest, "string").asNondeterministic()
    joined, of, starts, ends = _with_spans(df, window, id_col, text_col)
    none = F.array().cast("array<long>")
    after = F.when(F.col(of).isNotNull(), rest(F.coalesce(F.col(text_col), F.lit("")), F.coalesce(starts, none), F.coalesce(ends, none))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, after).where(F.col(of).isNull() | (F.col(text_col) != "")).select(*df.columns)


def digests(df: DataFrame) -> DataFrame:
    """Query op9: for each document its words, how many go, and the digest of those that stay."""
    return cleaned(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
