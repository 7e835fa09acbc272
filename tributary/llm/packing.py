"""Operator 4: best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised in place and only their pieces (a few numbers each) are shuffled. Groups of pieces, of
bounded size and drawn by a hash of the document id, are packed independently by best-fit decreasing: a segment
tree over the remaining capacities 0..limit finds the tightest open bin in log(limit) steps. Groups hold about
8,192 documents at any input size, so each group leaves at most about one bin unfilled.

Edge cases: null and empty texts give one piece (the closing id alone); ties in length go by document id and piece;
repeated rows with one id are all packed; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import loaded
from .shared import documents, file_bytes, tidy, widened

LIMIT = 2048
GROUP_DOCUMENTS = 8192


class Bins:
    """Open bins by remaining capacity: a segment tree of counts over 0..limit, with a stack of bins at each leaf."""

    def __init__(self, limit: int):
        self.size = 1 << max(1, limit).bit_length()
        self.count = [0] * (2 * self.size)
        self.stack: list[list[int]] = [[] for _ in range(limit + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, which: int) -> None:
        self.stack[capacity].append(which)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest bin with at least ``need`` left: climb from its leaf to the first ancestor with open bins to the right, then descend leftmost."""
        node, count = need + self.size, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.stack[capacity].pop()


def best_fit(lengths: list[int], limit: int = LIMIT) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length; lengths must come in descending order."""
    bins, n, which, offset = Bins(limit), 0, [], []
    for length in lengths:
        found = bins.take(length) if length < limit else None
        if found is None:
            found, n = (limit, n), n + 1
        left, b = found
        which.append(b)
        offset.append(limit - left)
        if left > length:
            bins.put(left - length, b)
    return which, offset


def pieces(df: DataFrame, vocabulary: str, limit: int = LIMIT, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, tokens) of each document's ids plus the closing id; tokens: little-endian unsigned 32-bit.

    Only documents longer than ``limit`` are cut, into full pieces after a first piece that may be shorter.
    """
    spec = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))
    end = np.array([closing], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = bpe.encode(text) + end
                    n = len(ids) // 4
                    stops = range(n % limit or limit, n + 1, limit) if n > limit else (n,)
                    start = 0
                    for k, stop in enumerate(stops):
                        rows.append((doc, k, start, stop - start, ids[4 * start : 4 * stop]))
                        start = stop
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=[id_col, "piece", "start", "length", "tokens"])

    return documents(df, id_col, text_col, id_col).mapInArrow(tidy(run), f"`{id_col}` long, piece int, start long, length long, tokens binary")


def pack(df: DataFrame, n_documents: int, limit: int = LIMIT, group_documents: int = GROUP_DOCUMENTS, id_col: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have an id, ``piece`` and ``length``.

    ``n_documents`` sets the number of groups; each group goes through one task, of about ``group_documents`` documents.
    """
    groups = max(1, math.ceil(n_documents / group_documents))
    schema = widened(df, sequence_id="long", offset="long")
    names = schema.fieldNames()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable")
        which, offset = best_fit(rows["length"].tolist(), limit)
        return rows.assign(sequence_id=np.asarray(which, dtype=np.int64) + (int(key[0]) << 40), offset=np.asarray(offset, dtype=np.int64))[names]

    return df.groupBy(F.pmod(F.xxhash64(id_col), F.lit(groups)).alias("packing_group")).applyInPandas(run, schema)


def packed(df: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """Query op4 and the last stage of the pipeline: one row for each piece with its place."""
    cut = pieces(df, vocabulary, limit)
    slim = cut.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"))
    return pack(slim, df.count(), limit).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
