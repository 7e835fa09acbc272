"""Operator 6: chroma audio fingerprints, and the alignment of recordings by them.

Sound becomes overlapping frames, each frame's spectrum twelve pitch classes. An integral image over frames and pitch
classes gives any rectangle's sum in four look-ups; FILTERS compare rectangles and quantise the difference to two bits,
so each place in time has one packed 32-bit integer. A histogram of offsets counts the places at which two recordings have
16 equal bits (those of one of BANDS). Offsets with one hit or more, and with a share of HITS of their overlap, are tried:
chance gives hits at 1 in 13,000 places, recordings that differ in a quarter of their bits at 1 in 20. The least share of
bits that differ along one of them decides. Runs of one value, as silence has, are counted as runs, and where no bit
differs no further offset is tried, so an hour of silence takes no longer than its length.

Recordings of at most SHORT places are not looked up: the spectra of their bits, multiplied as matrices, give the differing
bits of every offset at once, and only offsets with few enough are tested for hits. The result is that of the look-up, every
pair is still compared, but at a fraction of its cost.

A stated set of queries is matched against all recordings, in blocks: a block of at most BLOCK bytes of fingerprints is
indexed and broadcast, each task looks its recordings up and returns one row for each, so pairs never multiply between
tasks. With several blocks each one's rows are written before the next is broadcast. Equal fingerprints are one query.

Edge cases: null and empty sound, and sound shorter than the filters, have an empty fingerprint and match nothing;
silence has equal integers everywhere and matches silence; repeated rows get a row each; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle, small_batches, table, tidy

RATE, FRAME, HOP = 4000, 1024, 256
#: (rows of pitch classes, first pitch class, frames, kind): kinds compare halves in pitch, in time, diagonals, and the
#: middle third with the rest. Made by rule: each kind at several widths and places.
FILTERS = [(h, (5 * k + h) % (13 - h), w, k % 4) for k, (h, w) in enumerate([(4, 4), (6, 8), (12, 8), (3, 12), (2, 8), (8, 4), (6, 12), (9, 16), (12, 4), (4, 16), (6, 4), (3, 8), (10, 12), (8, 16), (12, 16), (6, 16)])]
WIDTH = max(w for _, _, w, _ in FILTERS)
#: Quantiser limits on log ratios of areas; first bits of the bands of 16 that are looked up; most differing bits; least
#: share of hits in an overlap; bytes of a block.
LIMITS, BANDS, BIT_ERRORS, HITS, BLOCK = (-0.25, 0.0, 0.25), (0, 4, 8, 12, 16), 0.25, 0.004, 2 << 20
#: Numbers that are compared at once.
_AT_ONCE = 1_000_000
#: Most places of a recording that is compared by spectra (half a minute); places whose spectra are held, of each side;
#: recordings and queries of a tile of products, small enough for a core's cache.
SHORT, _PLACES, _TILE = 512, 1 << 17, (64, 256)
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


def _classes() -> np.ndarray:
    """Which pitch class each bin of a frame's spectrum adds to, as a matrix; bins outside 55 to 1760 Hz add to none."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hertz), 12), dtype=np.float32)
    inside = (hertz >= 55) & (hertz <= 1760)
    out[np.flatnonzero(inside), np.round(12 * np.log2(hertz[inside] / 440)).astype(int) % 12] = 1
    return out


_MATRIX, _SHAPE = _classes(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12, each frame scaled to length 1."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), dtype=np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    energy = (np.abs(np.fft.rfft(frames * _SHAPE, axis=1)) ** 2).astype(np.float32) @ _MATRIX
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-3, energy / np.maximum(norm, 1e-9), 0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed integers of a recording, one for each place where the widest filter fits."""
    image = chroma(samples)
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(t: int, dt: int, p: int, dp: int) -> np.ndarray:
        return total[t + dt : t + dt + n, p + dp] - total[t : t + n, p + dp] - total[t + dt : t + dt + n, p] + total[t : t + n, p]

    one, whole = np.zeros((len(FILTERS), n)), np.zeros((len(FILTERS), n))
    for k, (h, p, w, kind) in enumerate(FILTERS):
        whole[k] = area(0, w, p, h)
        if kind == 0:
            one[k] = area(0, w, p, h // 2)
        elif kind == 1:
            one[k] = area(0, w // 2, p, h)
        elif kind == 2:
            one[k] = area(0, w // 2, p, h // 2) + area(w // 2, w - w // 2, p + h // 2, h - h // 2)
        else:
            one[k] = area(w // 4, w // 2, p, h)
    out = np.zeros(n, dtype=np.uint32)
    for level in np.digitize(np.log((one + 0.01) / (np.maximum(whole - one, 0) + 0.01)), LIMITS):
        out = out << np.uint32(2) | _GRAY[level]
    return out


def fingerprints(df: DataFrame, id_col: str = "rec_id", pcm_col: str = "pcm") -> DataFrame:
    """(rec_id, fingerprint) of recordings as 16-bit little-endian samples at RATE; fingerprint: little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                prints = [fingerprint(np.frombuffer(x.as_py()[: len(x.as_py()) // 2 * 2], dtype="<i2")).astype("<u4").tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.binary())], names=["rec_id", "fingerprint"])

    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("rec_id"), F.coalesce(F.col(pcm_col), F.lit(b"")).alias("pcm"))
    return source.mapInArrow(tidy(run), "rec_id long, fingerprint binary")


def _runs(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Slices of ``sizes`` whose sums are about _AT_ONCE at most, or that are single."""
    if not len(sizes):
        return []
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // _AT_ONCE)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(sizes)], strict=True))


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of ``sizes``, one after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _run_lengths(word: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of each run of one value; ``apart``: where runs must not go on."""
    if not len(word):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.concatenate([[True], word[1:] != word[:-1]])
    if apart is not None:
        new[apart] = True
    at = np.flatnonzero(new)
    return at, np.diff(np.concatenate([at, [len(word)]]))


class Index:
    """Inverted index over a block of queries: for each band the runs of equal words, by word."""

    def __init__(self, queries: list[tuple[int | None, bytes]]):
        self.ids = [q for q, _ in queries]
        prints = [np.frombuffer(x, dtype="<u4") for _, x in queries]
        self.sizes = np.array([len(x) for x in prints], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.values = np.concatenate([*prints, np.zeros(0, dtype=np.uint32)])
        owner = np.repeat(np.arange(len(prints)), self.sizes)
        self.bands = []
        for bit in BANDS:
            word = self.values >> np.uint32(bit) & np.uint32(0xFFFF)
            at, length = _run_lengths(word, self.starts[self.sizes > 0])
            order = np.argsort(word[at], kind="stable")
            at, length = at[order], length[order]
            self.bands.append((bit, owner[at], at - self.starts[owner[at]], length, np.searchsorted(word[at], np.arange(65537))))

    def _histogram(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query << 32 | offset + 2 ** 31, places with an equal band) of every offset that has some."""
        key, hits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for bit, owner, place, length, first in self.bands:
            word = (x >> np.uint32(bit) & np.uint32(0xFFFF)).astype(np.int64)
            here, size = _run_lengths(word)
            low = first[word[here]]
            n = first[word[here] + 1] - low
            for a, b in _runs(n):
                there, mine = _spread(low[a:b], n[a:b]), np.repeat(np.arange(a, b), n[a:b])
                # Runs of r and s places meet at r + s - 1 offsets, at min(r, s) places at most.
                r, s = size[mine], length[there]
                begin = here[mine] - (place[there] + s - 1)
                for c, d in _runs(r + s - 1):
                    wide = (r + s - 1)[c:d]
                    step = _spread(np.zeros(d - c, dtype=np.int64), wide)
                    more = (owner[there][c:d] << 32).repeat(wide) | begin[c:d].repeat(wide) + step + (1 << 31)
                    n_more = np.minimum(np.minimum(step + 1, wide.repeat(wide) - step), np.minimum(r, s)[c:d].repeat(wide))
                    # Added up after each portion, so memory follows the number of offsets, not of hits.
                    key, which = np.unique(np.concatenate([key, more]), return_inverse=True)
                    hits = np.bincount(which, np.concatenate([hits, n_more]), len(key)).astype(np.int64)
        return key, hits

    def align(self, x: np.ndarray) -> list[tuple[int | None, int, float]]:
        """(query, offset, share of differing bits) of every query that aligns; offset: place here minus place there."""
        key, hits = self._histogram(x)
        query, shift = key >> 32, (key & 0xFFFFFFFF) - (1 << 31)
        first = np.maximum(0, shift)
        n = np.minimum(len(x), self.sizes[query] + shift) - first
        enough = (2 * n >= np.minimum(len(x), self.sizes[query])) & (hits >= HITS * n)
        order = np.flatnonzero(enough)
        order = order[np.argsort(np.abs(shift[order]), kind="stable")]
        query, shift, first, n = query[order], shift[order], first[order], n[order]
        best: dict[int, tuple[float, int, int]] = {}
        done = np.zeros(len(self.ids), dtype=bool)
        for a, b in _runs(n):
            # Offsets come by size, so the first one without a differing bit is the best of its query.
            at = np.arange(a, b)[~done[query[a:b]]]
            if not len(at):
                continue
            here = _spread(first[at], n[at])
            there = _spread(self.starts[query[at]] + first[at] - shift[at], n[at])
            bits = np.add.reduceat(np.bitwise_count(x[here] ^ self.values[there]).astype(np.int64), np.cumsum(n[at]) - n[at])
            errors = bits / (32 * n[at])
            for k in np.flatnonzero(errors <= BIT_ERRORS).tolist():
                q, where = int(query[at[k]]), int(shift[at[k]])
                best[q] = min(best.get(q, (2.0, 0, 0)), (float(errors[k]), abs(where), where))
            done[query[at[bits == 0]]] = True
        return [(self.ids[q], at, e) for q, (e, _, at) in sorted(best.items())]


def _spectra(prints: list[np.ndarray], forth: np.ndarray) -> np.ndarray:
    """Frequencies x (32 real, 32 imaginary parts) x recordings, of the bits as 1 and -1 with zeros behind a recording's end."""
    words, inside = (np.zeros((forth.shape[1], len(prints)), dtype=t) for t in (np.uint32, np.float32))
    for k, x in enumerate(prints):
        words[: len(x), k], inside[: len(x), k] = x, 1
    signs = (words[:, None, :] >> np.arange(32, dtype=np.uint32)[:, None] & np.uint32(1)).astype(np.float32)
    signs *= -2
    signs += 1
    signs *= inside[:, None, :]
    return (forth @ signs.reshape(len(words), -1)).reshape(len(forth) // 2, 64, -1)


def _alike(sizes: np.ndarray, places: int) -> list[np.ndarray]:
    """Numbers of recordings that are compared together: of at most SHORT places, lengths that differ by less than twice, about ``places`` in all."""
    out = []
    for low in (1 << k for k in range(SHORT.bit_length())):
        at = np.flatnonzero((sizes >= low) & (sizes < 2 * low) & (sizes <= SHORT))
        step = max(1, places // (2 * low))
        out += [at[a : a + step] for a in range(0, len(at), step)]
    return out


def _few_errors(xs: list[np.ndarray], queries: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(recording, query, offset), as numbers in the lists, where both are short, overlap by half and differ in few bits, portion by portion."""
    m_all, n_all = (np.array([len(x) for x in rows], dtype=np.int64) for rows in (xs, queries))
    for theirs in _alike(n_all, _PLACES):
        for mine in _alike(m_all, _PLACES):
            m, n = m_all[mine], n_all[theirs]
            least = (min(m.min(), n.min()) + 1) // 2
            # As large as offsets get in either direction; those that overlap less than by half are left out below.
            shifts = np.arange(max(m.max(), n.max()) - least + 1)
            # Long enough that no offset of interest meets another one that wraps around.
            size = -(-int(m.max() + n.max() - least + 1) // 2) * 2
            f = np.arange(size // 2 + 1)
            angle = lambda at: 2 * np.pi / size * (f[:, None] * at % size)
            there, weight = angle(np.arange(max(m.max(), n.max()))), np.where(f % (size // 2), 2, 1) / size
            forth = np.stack([np.cos(there), -np.sin(there)], axis=1).reshape(-1, there.shape[1]).astype(np.float32)
            even, odd = ((weight * wave(angle(shifts)).T).astype(np.float32) for wave in (np.cos, np.sin))
            others, ones = _spectra([queries[k] for k in theirs], forth), _spectra([xs[k] for k in mine], forth).transpose(0, 2, 1)
            tiles = [(mine[a : a + _TILE[0]], np.ascontiguousarray(ones[:, a : a + _TILE[0]])) for a in range(0, len(mine), _TILE[0])]
            for b, (own, one) in ((b, tile) for b in range(0, len(theirs), _TILE[1]) for tile in tiles):
                if one is tiles[0][1]:
                    their, other = theirs[b : b + _TILE[1]], np.ascontiguousarray(others[:, :, b : b + _TILE[1]])
                turned = np.concatenate([one[:, :, 32:], -one[:, :, :32]], axis=2)
                # Bits that agree less bits that differ, at an offset and the opposite one: the same sum and difference.
                half, rest = even @ (one @ other).reshape(len(f), -1), odd @ (turned @ other).reshape(len(f), -1)
                # Lengths of one kind need no cube of overlaps.
                r, q = (x[:1] if (x == x[0]).all() else x for x in (m_all[own], n_all[their]))
                for product, s in ((half - rest, shifts), (half + rest, -shifts)):
                    away = s[:, None, None]
                    overlap = np.minimum(r[:, None], q + away) - np.maximum(0, away)
                    limit = np.where((overlap > 0) & (2 * overlap >= np.minimum(r[:, None], q)), 32 * (1 - 2 * BIT_ERRORS) * overlap - 0.5, np.inf).astype(np.float32)
                    product = product.reshape(len(s), len(own), len(their))
                    shift, x, y = np.unravel_index(np.flatnonzero(product >= limit), product.shape)
                    if len(x):
                        yield own[x], their[y], s[shift]


def align_short(xs: list[np.ndarray], queries: list[np.ndarray]) -> list[list[tuple[int, int, float]]]:
    """For each recording what ``Index.align`` finds (queries by their place in the list), among pairs of recordings of at most SHORT places."""
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in xs]
    m_all, n_all = (np.array([len(x) for x in rows], dtype=np.int64) for rows in (xs, queries))
    own, other = (np.concatenate([*rows, np.zeros(0, dtype=np.uint32)]) for rows in (xs, queries))
    at_x, at_q = np.cumsum(m_all) - m_all, np.cumsum(n_all) - n_all
    for mine, theirs, shift in _few_errors(xs, queries):
        first = np.maximum(0, shift)
        n = np.minimum(m_all[mine], n_all[theirs] + shift) - first
        for a, b in _runs(n):
            cut = np.cumsum(n[a:b]) - n[a:b]
            gap = own[_spread((at_x[mine] + first)[a:b], n[a:b])] ^ other[_spread((at_q[theirs] + first - shift)[a:b], n[a:b])]
            errors = np.add.reduceat(np.bitwise_count(gap).astype(np.int64), cut) / (32 * n[a:b])
            hits = sum(np.add.reduceat((gap >> np.uint32(bit) & np.uint32(0xFFFF) == 0).astype(np.int64), cut) for bit in BANDS)
            for k in np.flatnonzero((errors <= BIT_ERRORS) & (hits > 0) & (hits >= HITS * n[a:b])).tolist():
                q, where = int(theirs[a + k]), int(shift[a + k])
                found = best[mine[a + k]]
                found[q] = min(found.get(q, (2.0, 0, 0)), (float(errors[k]), abs(where), where))
    return [[(q, at, e) for q, (e, _, at) in sorted(found.items())] for found in best]


class Block:
    """A block of queries: short ones by spectra, long ones and what long recordings meet by the inverted index."""

    def __init__(self, queries: list[tuple[int | None, bytes]]):
        self.queries = queries
        self.ids = [q for q, _ in queries]
        self.prints = [np.frombuffer(x, dtype="<u4") for _, x in queries]

    @cached_property
    def whole(self) -> Index:
        return Index(self.queries)

    @cached_property
    def long(self) -> Index:
        return Index([(q, x) for q, x in self.queries if len(x) > 4 * SHORT])

    def align(self, xs: list[np.ndarray]) -> list[list[tuple[int | None, int, float]]]:
        """``Index.align`` of each recording."""
        out = [[(self.ids[q], at, e) for q, at, e in found] for found in align_short(xs, self.prints)]
        for found, x in zip(out, xs, strict=True):
            if len(x) > SHORT:
                found += self.whole.align(x)
            elif len(x) and self.long.ids:
                found += self.long.align(x)
        return out


def align(prints: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rec_id, matches) for every recording of ``prints``; matches: (query, offset, bit_errors) with each distinct query."""
    context = prints.sparkSession.sparkContext
    distinct = settle(queries.groupBy("fingerprint").agg(F.min("rec_id").alias("rec_id")).where(F.length("fingerprint") > 0))
    size, most = distinct.agg(F.coalesce(F.sum(F.length("fingerprint")), F.lit(0)), F.count("*")).first()
    # A query is a block's least part; a hash deals them out evenly.
    parts = max(1, min(most, -(-size // block)))
    # Ids may repeat or be null, so blocks' rows meet by a key of their own.
    keyed = prints.select("rec_id", "fingerprint", (F.lit(0) if parts == 1 else F.monotonically_increasing_id()).cast("long").alias("row"))
    if parts > 1:
        keyed = settle(keyed)
    out = None
    for part in range(parts):
        rows = distinct.where(F.pmod(F.xxhash64("fingerprint"), F.lit(parts)) == part).orderBy("rec_id").collect()
        index = context.broadcast([(r["rec_id"], bytes(r["fingerprint"])) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            lookup = Block(index.value)
            kind = pa.list_(pa.struct([("query", pa.int64()), ("offset", pa.int32()), ("bit_errors", pa.float64())]))
            for batch in batches:
                texts = batch.column(1).to_pylist()
                once = list(dict.fromkeys(texts))
                memo = dict(zip(once, lookup.align([np.frombuffer(x, dtype="<u4") for x in once]), strict=True))
                found = [[{"query": q, "offset": o, "bit_errors": e} for q, o, e in memo[x]] for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, kind)], names=["rec_id", "row", "matches"])

        each = keyed.mapInArrow(tidy(run), "rec_id long, row long, matches array<struct<query: long, offset: int, bit_errors: double>>")
        if parts > 1:
            each = settle(each)
            index.destroy()
        out = each if out is None else out.union(each)
    return out.select("rec_id", "matches") if parts == 1 else out.groupBy("row").agg(F.first("rec_id").alias("rec_id"), F.flatten(F.collect_list("matches")).alias("matches")).drop("row")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings (rec_id, pcm) for the test tables, which have no sound: each embedding is played, a note for each number."""
    note = 512
    time = np.arange(note) / RATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tones = {}
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                out = []
                for vector in part.column(1).to_pylist():
                    sound = []
                    for v in vector:
                        pitch = int(np.clip((0.0 if v is None or v != v else v) * 24, -12, 12))
                        if pitch not in tones:
                            tones[pitch] = (8000 * np.sin(2 * np.pi * 440 * 2 ** (pitch / 12) * time)).astype("<i2").tobytes()
                        sound.append(tones[pitch])
                    out.append(b"".join(sound))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["rec_id", "pcm"])

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("rec_id"), F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")).alias("embedding"))
    return vectors.mapInArrow(tidy(run), "rec_id long, pcm binary")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6: every recording's fingerprint, and the queries (ids divisible by 50) that it aligns with."""
    prints = settle(fingerprints(rendered(spark, sf_dir)))
    found = align(prints, prints.where("rec_id % 50 = 0"))
    listed = F.array_join(F.transform(F.array_sort("matches"), lambda m: F.concat_ws(":", m["query"], m["offset"])), ",")
    return found.select("rec_id", F.size("matches").cast("long").alias("n_matches"), F.round(F.array_min(F.transform("matches", lambda m: m["bit_errors"])), 6).alias("least_bit_errors"), listed.alias("matches"))
