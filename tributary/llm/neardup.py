"""Operator 8: near duplicates by a signature-coordinate inverted join.

Every distinct set of word shingles has a MinHash signature of COORDINATES values, and is posted under each pair of
coordinate and value. Two sets of Jaccard similarity 0.8 agree in MATCHES or more coordinates but for about one pair in
a million, so:

* skip: values that one set alone has can match nothing; sets with fewer than MATCHES other values link with nothing;
* prefix: of the m values that are left, the m - MATCHES + 1 rarest are posted; two sets with MATCHES matches share one
  of these, as both order them alike;
* merge: sets that meet count the matches of their whole signatures, those with MATCHES or more are confirmed on the
  full sets of shingles.

Only components are asked for, so lists are not expanded into all pairs. First each list's members meet its leader (the
member with the most shared values) alone; what links to it needs no other link in that list. Then, in lists whose
members lie in several components, each member meets DRAWS others, drawn by a hash for each list; a set has many lists,
so where links are common nearly all of a group joins here. Last, in lists that still have several components, the pairs
across components that agree often enough are formed, each pair in one list alone: that of the first coordinate in which
both agree and are posted, which a 64-bit mask of posted coordinates tells. So a pair that meets in thirty lists is made
once. All these pairs must be admitted by an exact bound: two sets link
only if each has 4/9 of their joint size in shingles that the other can have. Shingles that at most RARE sets hold are
listed with their holders, whose pairs are formed there; all other pairs can have only the more common ones in common,
so a set that was edited in many places meets few others.

Copies are one row from the start: sets are grouped by size and digest, and the smallest id stands for them.

Edge cases: null, empty and blank texts have an empty set, link with nothing and are kept; texts of fewer words than a
shingle have their whole sequence as the only one; rows with one id count as one document with the sets of each; rows
with a null id have a size, link with nothing (component null) and are kept, as nothing can refer to them; an empty
table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import WORD, documents, settle, settled_alone, sized, tidy, unused

COORDINATES, MATCHES, SHINGLE, DRAWS, RARE = 64, 35, 5, 6, 16
#: Ids are broadcast up to this number (8 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SLICE = 1_000_000
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, size=2 * 1024, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


def shingle_sets(texts: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, hashes): the distinct shingles of each text as sorted 64-bit hashes, one after another."""
    vocabulary: dict[str, int] = {}
    ids: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        words = _words(text)
        sizes[k] = len(words)
        ids += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))
    words = hashes[np.array(ids, dtype=np.int64)] if ids else np.zeros(0, dtype=np.uint64)
    counts = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
    begins = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), counts)
    at = begins[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    width = np.minimum(sizes, shingle)[doc]
    out = width.astype(np.uint64)
    for k in range(shingle):
        inside = width > k
        out = np.where(inside, _mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[np.where(inside, at + k, 0)] if len(words) else out), out)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.concatenate([[True], (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])]) if len(out) else np.zeros(0, dtype=bool)
    return np.bincount(doc[new], minlength=len(texts)), out[new]


def signature(sizes: np.ndarray, hashes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """MinHash values of each set, as 32-bit integers; rows of empty sets mean nothing."""
    out = np.zeros((len(sizes), coordinates), dtype=np.int32)
    full = np.flatnonzero(sizes)
    if len(full):
        begins = (np.cumsum(sizes) - sizes)[full]
        for k in range(coordinates):
            x = hashes * (_SEEDS[2 * k] | np.uint64(1)) + _SEEDS[2 * k + 1]
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xD6E8FEB86659FD93)
            out[full, k] = (np.minimum.reduceat(x, begins) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about _SLICE characters, one row at least."""
    for batch in batches:
        sizes = np.cumsum([len(t) for t in batch.column(1).to_pylist()])
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + _SLICE)))
            yield batch.slice(start, stop - start)
            start = stop


def signatures(df: DataFrame, shingle: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, digest_a, digest_b, signature) of rows (doc_id, text); equal sets have equal sizes and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches):
            sizes, hashes = shingle_sets(part.column(1).to_pylist(), shingle)
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(hashes))])
            other = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(hashes * np.uint64(0xC2B2AE3D27D4EB4F)))])
            stop = np.cumsum(sizes)
            digests = [pa.array((t[stop] - t[stop - sizes]).view(np.int64)) for t in (total, other)]
            values = signature(sizes, hashes, coordinates)
            offsets = pa.array(np.arange(0, (len(sizes) + 1) * coordinates, coordinates, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *digests, pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=["doc_id", "n_shingles", "digest_a", "digest_b", "signature"])

    return df.mapInArrow(tidy(run), "doc_id long, n_shingles long, digest_a long, digest_b long, signature array<int>")


def postings(sets: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(doc_id, m, key) for the prefix of each set of ``sets`` (doc_id, signature): its rarest shared values, rarest first."""
    each = sets.select("doc_id", F.posexplode("signature").alias("at", "value")).select("doc_id", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value") + F.lit(1 << 31)).alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    of_set = each.join(shared, "key").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("values"))
    enough = of_set.select("doc_id", F.size("values").alias("m"), "values").where(F.col("m") >= matches)
    return enough.select("doc_id", "m", F.explode(F.expr(f"slice(values, 1, m - {matches} + 1)")).alias("v")).select("doc_id", "m", F.col("v.key").alias("key"))


def _agreeing(a: str, b: str) -> str:
    """SQL for the number of coordinates in which two signatures agree."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)"


def _open(lists: DataFrame, component: DataFrame) -> DataFrame:
    """(key, doc_id, component) of the lists whose members lie in several components."""
    placed = lists.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return placed.join(mixed.select("key"), "key")


def _matching(pairs: DataFrame, sets: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures match often enough."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("signature").alias(f"signature_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.expr(f"{_agreeing('signature_a', 'signature_b')} >= {matches}")).select("a", "b")


def _texts_of(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the given ids: by a broadcast while that is at most BROADCAST_IDS, by a shuffle beyond."""
    return rows.join(sized(settle(ids.select("doc_id").distinct()), BROADCAST_IDS), "doc_id", "left_semi")


def confirmed(pairs: DataFrame, rows: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """The pairs (a, b) whose full sets of shingles have ``100 * intersection >= percent * union``."""
    texts = settle(_texts_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), rows))
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, frozenset] = {}

        def shingles(text: str) -> frozenset:
            if text not in memo:
                if len(memo) > 200:
                    memo.clear()
                w = _words(text)
                memo[text] = frozenset(zip(*(w[k:] for k in range(shingle)), strict=False)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])
            return memo[text]

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one, two = shingles(x), shingles(y)
                common = len(one & two)
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long")


def _shingles_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingle): the set of each row of ``texts`` as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches):
            sizes, hashes = shingle_sets(part.column(1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(hashes.view(np.int64))], names=["doc_id", "shingle"])

    return texts.mapInArrow(tidy(run), "doc_id long, shingle long")


def _rare_shingles(each: DataFrame) -> DataFrame:
    """(shingle, docs): the sets that hold each shingle of ``each`` which at most RARE of them hold."""
    popular = settle(each.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > RARE).select("shingle"))
    return settle(each.join(sized(popular), "shingle", "left_anti").groupBy("shingle").agg(F.collect_list("doc_id").alias("docs")))


def _sharing_rare(rare: DataFrame, member: DataFrame, able: DataFrame, bound: str) -> DataFrame:
    """Pairs (a, b) across components that hold a rare shingle both; a shingle makes at most RARE * (RARE - 1) / 2."""
    known = able.join(member.select("doc_id", "component").distinct(), "doc_id").select("doc_id", F.struct("doc_id", "component", "n", "shared").alias("set"))
    held = rare.where(F.size("docs") > 1).select("shingle", F.explode("docs").alias("doc_id")).join(known, "doc_id")
    mixed = held.groupBy("shingle").agg(F.collect_list("set").alias("sets")).where("size(array_distinct(sets.component)) > 1")
    both = mixed.select(F.explode("sets").alias("x"), "sets").select("x", F.explode("sets").alias("y"))
    return both.where(F.expr(bound)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def links(sets: DataFrame, rows: DataFrame, shingle: int = SHINGLE, matches: int = MATCHES, percent: int = 80, repeated: bool = False) -> DataFrame:
    """Edges (a, b) that connect what all links of ``sets`` (doc_id, n_shingles, signature) connect; ``rows`` has the texts, ``repeated``: with ids that repeat."""
    lists = settle(postings(sets, matches))
    leaders = lists.groupBy("key").agg(F.max(F.struct("m", (-F.col("doc_id")).alias("id"))).alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", (-F.col("leader.id")).alias("b"))
    stars = lists.join(leaders, "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    first = settle(confirmed(settle(_matching(stars, sets, matches)), rows, shingle, percent=percent))

    member = settle(_open(lists, components(first)))
    each = _shingles_of(_texts_of(member, rows), shingle)
    rare = _rare_shingles(settle(each.distinct() if repeated else each))
    own = rare.select(F.explode("docs").alias("doc_id"), (F.size("docs") == 1).cast("long").alias("lone")).groupBy("doc_id").agg(F.count("*").alias("rare"), F.sum("lone").alias("lone"))
    sizes = member.select("doc_id").distinct().join(sets.select("doc_id", "n_shingles"), "doc_id").join(own, "doc_id", "left").na.fill(0)
    able = settle(sizes.select("doc_id", F.col("n_shingles").alias("n"), F.expr("n_shingles - lone").alias("shared"), F.expr("n_shingles - rare").alias("common")).where(f"100 * shared >= {percent} * n"))
    admits = f"(100 + {percent}) * least({{0}}, {{1}}) >= {percent} * ({{2}} + {{3}})"
    near = _sharing_rare(rare, member, able, "x.doc_id < y.doc_id and x.component <> y.component and " + admits.format("x.shared", "y.shared", "x.n", "y.n"))

    # What follows are pairs without a common rare shingle.
    able = able.where(f"100 * common >= {percent} * n")
    bound = "component_1 <> component_2 and " + admits.format("common_1", "common_2", "n_1", "n_2")

    def sides(rows: DataFrame, *columns: str) -> list[DataFrame]:
        return [rows.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "component", "n", "common", *columns))) for k in (1, 2)]

    one, two = sides(member.join(able, "doc_id"))
    drawn = two.groupBy("key").agg(*(F.min_by(F.struct(*two.columns[1:]), F.xxhash64("doc_id_2", "key", F.lit(k))).alias(f"draw_{k}") for k in range(DRAWS)))
    drawn = drawn.select("key", F.explode(F.array_distinct(F.array(*drawn.columns[1:]))).alias("d")).select("key", "d.*")
    some = one.join(drawn, "key").where(F.expr(bound)).select(F.least("doc_id_1", "doc_id_2").alias("a"), F.greatest("doc_id_1", "doc_id_2").alias("b"))
    second = settle(confirmed(settle(_matching(near.union(some).distinct(), sets, matches)), rows, shingle, percent=percent))

    left = _open(lists, components(first.union(second))).join(able, "doc_id")
    head = left.groupBy("key").agg(F.min_by("component", F.xxhash64("doc_id", "key")).alias("head"))
    posted = lists.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.shiftright("key", 32).cast("int"))).alias("posted"))
    one, two = sides(settle(left.join(sets.select("doc_id", "signature"), "doc_id").join(posted, "doc_id")), "signature", "posted")
    each = one.join(head, "key").where("component_1 <> head").join(two, "key")
    agree = "filter(array_intersect(posted_1, posted_2), i -> signature_1[i] = signature_2[i])"
    here = f"shiftright(key, 32) = try_element_at({agree}, 1)"
    across = each.where(F.expr(f"{bound} and (component_2 = head or doc_id_1 < doc_id_2) and {_agreeing('signature_1', 'signature_2')} >= {matches} and {here}"))
    third = confirmed(settle(across.select(F.least("doc_id_1", "doc_id_2").alias("a"), F.greatest("doc_id_1", "doc_id_2").alias("b")).distinct()), rows, shingle, percent=percent)
    return settle(first.union(second).union(third))


@settled_alone
def near_duplicates(df: DataFrame, shingle: int = SHINGLE, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    rows = documents(df, id_col, text_col)
    all_sets = settle(signatures(rows, shingle, coordinates))
    rows = rows.where("doc_id is not null")
    key = ["n_shingles", "digest_a", "digest_b"]
    classes = settle(all_sets.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("class_id")))
    sets = all_sets.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n_shingles", "signature")
    repeated = not all_sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    sets = settle(sets.distinct() if repeated else sets)
    found = components(links(sets, rows, shingle, matches, percent, repeated))
    labelled = classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select(*key, F.coalesce("component", "class_id").alias("component"))
    each = all_sets.select("doc_id", *key).join(labelled, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return each.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_copies(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` but for those that link to a document with a smaller id; rows with a null id stay."""
    copy = unused(df, "copy_id")
    gone = settle(near_duplicates(df, shingle, id_col=id_col, text_col=text_col).where("not kept").select(F.col("doc_id").alias(copy)).distinct())
    return df.join(sized(gone, BROADCAST_IDS), F.col(id_col) == F.col(copy), "left_anti")
