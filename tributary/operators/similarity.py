"""From distances to similarities of contracts, their weighted fusion, and the top results.

Item similarity needs every pair, as all of a contract's items count. ``item_sums`` forms no pair rows for it: each task
multiplies its items with a broadcast block of query vectors and adds up, for each query and contract, the two sums
that the self-weighted mean is made of; only these meet in the shuffle.

``fused_top`` goes further: what all components hold of a contract meets in one task, which can then say its whole
similarity to every query and keeps the k best contracts of each; k rows for each query and task are shuffled. Only
contracts of more than PACK rows are dealt to several tasks, whose sums are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, standardize, vectors
from . import nearest, spatial

#: Weights of the engine's components.
WEIGHTS = {"subject": 1.0, "locality": 0.1, "entity_subject": 0.1}
#: Rows of a contract that one task takes, and query rows that are broadcast at once.
PACK, BLOCK = 1024, 4096
#: Pairs of a contract's and a query's place beyond which the spatial index is worth its own jobs.
PAIRS = 100_000_000


def item_similarities(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Every (query item, contract item) pair with its cosine similarity scaled to 0..1."""
    return nearest.vector_distances(items, queries).withColumn("similarity", standardize.cosine(F.col("distance")))


def self_weighted_mean(pairs: DataFrame, keys: tuple[str, ...] = ("query_id", "contract_id"), value: str = "similarity", weight: str | None = None) -> DataFrame:
    """sum(value * weight) / sum(weight) of each group, the weight being the value itself unless given; null values are left out, 0 / 0 too."""
    w = F.when(F.col(value).isNotNull(), F.col(weight or value))
    mean = pairs.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("similarity"))
    return mean.where(F.col("similarity").isNotNull() & ~F.isnan("similarity"))


def item_sums(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, contract_id, s2, s1): sums over all pairs of items of squared similarities and of similarities.

    A contract's items meet in one task, which says its sums; only those of contracts of more than PACK items are added up
    in a shuffle.
    """
    context = items.sparkSession.sparkContext
    source = items.where(vectors.usable(F.col("embedding"))).select("contract_id", F.col("embedding").cast("array<double>").alias("embedding"))
    many = source.groupBy("contract_id").agg(F.count("*").alias("n")).where(F.col("n") > PACK).select("contract_id")
    few = source.join(many, "contract_id", "left_anti").repartition("contract_id").sortWithinPartitions("contract_id")

    def sums(rows: DataFrame) -> DataFrame:
        def run(block: DataFrame) -> DataFrame:
            asked = block.where(vectors.usable(F.col("embedding"))).select("query_id", "embedding").orderBy("query_id").collect()
            sent = context.broadcast((np.array([r[0] for r in asked], dtype=np.int64), nearest.matrix([r[1] for r in asked])))

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, q = sent.value
                if not len(ids):
                    return
                q = q / np.linalg.norm(q, axis=1, keepdims=True)
                names, at = np.unique(ids, return_index=True)
                step = max(1, nearest.CELLS // len(ids))
                for contracts, v in _runs(batches, step):
                    s = (1 + (v / np.linalg.norm(v, axis=1, keepdims=True)) @ q.T) / 2
                    first = np.flatnonzero(np.append(True, contracts[1:] != contracts[:-1]))
                    both = [np.add.reduceat(np.add.reduceat(x, at, axis=1), first, axis=0) for x in (s * s, s)]
                    columns = np.tile(names, len(first)), np.repeat(contracts[first], len(names)), both[0].ravel(), both[1].ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "contract_id", "s2", "s1"])

            return rows.mapInArrow(add, "query_id long, contract_id long, s2 double, s1 double")

        return nearest.in_blocks(queries.select("query_id", "embedding"), ["query_id"], run, rows=4096)

    parts = sums(source.join(many, "contract_id", "left_semi").sortWithinPartitions("contract_id"))
    return sums(few).unionByName(parts.groupBy("query_id", "contract_id").agg(F.sum("s2").alias("s2"), F.sum("s1").alias("s1")))


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contracts and vectors of at most ``size`` + PACK rows; only contracts of more than PACK rows are cut."""
    names, rest, most = np.zeros(0, dtype=np.int64), None, size + PACK
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        names = np.concatenate((names, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
        rest = v if rest is None else np.concatenate((rest, v))
        while len(names) > most:
            starts = np.flatnonzero(names[1 : most + 1] != names[:most]) + 1
            end = int(starts[-1]) if len(starts) else most
            yield names[:end], rest[:end]
            names, rest = names[end:], rest[end:]
    if len(names):
        yield names, rest


def by_items(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, contract_id, similarity) of every contract with a usable item: the self-weighted mean over all pairs."""
    mean = item_sums(items, queries).select("query_id", "contract_id", F.try_divide("s2", "s1").alias("similarity"))
    return mean.where(F.col("similarity").isNotNull() & ~F.isnan("similarity"))


def first_places(queries: DataFrame) -> DataFrame:
    """A query's first address only: rows (query_id, pos, lat, lon) to (query_id, lat, lon)."""
    first = queries.groupBy("query_id").agg(F.min_by(F.struct("lat", "lon"), "pos").alias("p"))
    return first.select("query_id", "p.lat", "p.lon")


def by_place(places: DataFrame, queries: DataFrame, kind: str = "planar") -> DataFrame:
    """(query_id, contract_id, similarity) by distance; a contract with several places counts with its nearest."""
    near = nearest.location_distances(places, queries, kind).groupBy("query_id", "contract_id").agg(F.min("distance").alias("distance"))
    return near.select("query_id", "contract_id", standardize.log1p(F.col("distance")).alias("similarity"))


def top_by_place(places: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    """``top(by_place(places, queries), k)``, measuring only places that the spatial index leaves."""
    return top(_near_places(places, queries, k), k)


def fused(components: dict[str, DataFrame], weights: dict[str, float] = WEIGHTS, bias: float = 0.0, seed: int = 0) -> DataFrame:
    """(query_id, contract_id, similarity): sum of weight * similarity over the sum of all weights used.

    A contract that a component does not have gets 0 from it, while the denominator stays. Weights are those of the
    components given, so a subset is normalised by its own sum.
    """
    total = sum(weights[name] for name in components)
    parts = [rows.select("query_id", "contract_id", (F.col("similarity") * (weights[name] / total)).alias("share")) for name, rows in components.items()]
    score = reduce(DataFrame.unionByName, parts).groupBy("query_id", "contract_id").agg(F.sum("share").alias("similarity"))
    return score.withColumn("similarity", standardize.random_bias(F.col("similarity"), bias, seed))


class _Block:
    """Queries of one block: for each component, where its query rows lie among all queries of the block."""

    def __init__(self, rows: list[list[tuple]], weights: list[float], places: list[bool], k: int):
        self.names = np.unique(np.array([r[0] for part in rows for r in part], dtype=np.int64))
        self.weights, self.places, self.k = weights, places, k
        self.at, self.first, self.vectors = [], [], []
        for part, place in zip(rows, places, strict=True):
            ids = np.array([r[0] for r in part], dtype=np.int64)
            own, first = np.unique(ids, return_index=True)
            vectors = nearest.matrix([r[1] for r in part])
            self.at.append(np.searchsorted(self.names, own))
            self.first.append(first)
            self.vectors.append(vectors if place or not len(part) else vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
        self.width = max(1, *(len(v) for v in self.vectors))

    def sums(self, no: int, rows: np.ndarray, times: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """2 x groups x queries: sums of squared and of plain similarities, or twice the least distance; a row counts ``times``."""
        v, first = self.vectors[no], self.first[no]
        if self.places[no]:
            d = np.sqrt(((rows[:, None, 0] - v[None, :, 0]) * geo.KM_LATITUDE) ** 2 + ((rows[:, None, 1] - v[None, :, 1]) * geo.KM_LONGITUDE) ** 2)
            least = np.minimum.reduceat(np.minimum.reduceat(d, first, axis=1), starts, axis=0)
            return np.stack([least, least])
        s = (1 + (rows / np.linalg.norm(rows, axis=1, keepdims=True)) @ v.T) / 2
        return np.stack([np.add.reduceat(np.add.reduceat(x, first, axis=1) * times[:, None], starts, axis=0) for x in (s * s, s)])

    def merged(self, no: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return np.minimum(one, two) if self.places[no] else one + two

    def shares(self, no: int, sums: np.ndarray) -> np.ndarray:
        """A component's part of the similarity; NaN where it says nothing."""
        with np.errstate(all="ignore"):
            if self.places[no]:
                value = np.where(sums[0] <= 0, 1.0, np.minimum(1.0, 1 / np.log1p(np.maximum(sums[0], 1e-12))))
            else:
                value = np.where(sums[1] == 0, np.nan, sums[0] / sums[1])
        return value * (self.weights[no] / sum(self.weights))


class _Scorer:
    """Scores the contracts of a task, whose rows come sorted by contract and part."""

    def __init__(self, block: _Block):
        self.block, n = block, len(block.names)
        self.best, self.ids = np.zeros((n, 0)), np.zeros((n, 0), dtype=np.int64)
        #: The last group, which may go on: its name, and its sums by component.
        self.open: tuple | None = None
        self.sums: dict[int, np.ndarray] = {}
        self.out: list[tuple] = []

    def add(self, names: np.ndarray, whole: np.ndarray, no: np.ndarray, times: np.ndarray, rows: list[np.ndarray]) -> None:
        """``names``: contract and part of each row; ``rows``: for each component the vectors of its rows."""
        cuts = np.flatnonzero(np.any(names[1:] != names[:-1], axis=1)) + 1
        starts = np.concatenate(([0], cuts))
        group = np.zeros(len(names), dtype=np.int64)
        group[cuts] = 1
        group = np.cumsum(group)
        heads = [(int(names[a, 0]), int(names[a, 1]), bool(whole[a])) for a in starts]
        every: list[dict[int, np.ndarray]] = [{} for _ in heads]
        for c, part in enumerate(rows):
            if len(part) and len(self.block.first[c]):
                own, first = np.unique(group[no == c], return_index=True)
                made = self.block.sums(c, part, times[no == c], first)
                for i, g in enumerate(own):
                    every[g][c] = made[:, i]
        for head, sums in zip(heads, every, strict=True):
            if self.open == head:
                for c, x in sums.items():
                    self.sums[c] = self.block.merged(c, self.sums[c], x) if c in self.sums else x
            else:
                self.close()
                self.open, self.sums = head, sums
        if len(self.out) > 256:
            self.settle()

    def close(self) -> None:
        if self.open is not None:
            self.out.append((self.open, self.sums))
        self.open, self.sums = None, {}

    def settle(self) -> None:
        """Take the whole contracts that are waiting into the best so far."""
        done = [(head[0], sums) for head, sums in self.out if head[2]]
        self.out = [x for x in self.out if not x[0][2]]
        if not done:
            return
        n = len(self.block.names)
        score, known = np.zeros((n, len(done))), np.zeros((n, len(done)), dtype=bool)
        for g, (_, sums) in enumerate(done):
            for c, x in sums.items():
                share = self.block.shares(c, x)
                sound, at = ~np.isnan(share), self.block.at[c]
                score[at[sound], g] += share[sound]
                known[at[sound], g] = True
        score = np.hstack([self.best, np.where(known, score, np.nan)])
        ids = np.hstack([self.ids, np.broadcast_to(np.array([d[0] for d in done], dtype=np.int64), (n, len(done)))])
        order = np.lexsort((ids, -np.round(score, 9)), axis=1)[:, : self.block.k]
        self.best, self.ids = (np.take_along_axis(x, order, axis=1) for x in (score, ids))

    def parts(self) -> Iterator[pd.DataFrame]:
        """Sums of contracts that other tasks have parts of, too."""
        out, self.out = self.out, [x for x in self.out if x[0][2]]
        for head, sums in (x for x in out if not x[0][2]):
            for c, x in sums.items():
                yield pd.DataFrame({"query_id": self.block.names[self.block.at[c]], "contract_id": head[0], "no": c, "a": x[0], "b": x[1]})

    def top(self) -> pd.DataFrame:
        sound = ~np.isnan(self.best)
        q = np.broadcast_to(self.block.names[:, None], self.best.shape)[sound]
        return pd.DataFrame({"query_id": q, "contract_id": self.ids[sound], "no": -1, "a": self.best[sound], "b": 0.0})


def fused_top(components: dict[str, tuple[DataFrame, DataFrame]], k: int = 1, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``top(fused(...), k)`` of components given as their (contract) rows and query rows, without a row for each pair.

    Rows with an embedding are items, rows with lat and lon places; contracts have a contract_id, queries a query_id.
    Where a contract or a query has places only, its similarity is one of distance: beyond PAIRS pairs of places these come
    from the spatial index, and only contracts and queries that both have items are scored with each other.
    """
    located = [name for name, (rows, _) in components.items() if "embedding" not in rows.columns]
    if len(located) != 1 or components[located[0]][0].count() * components[located[0]][1].count() <= PAIRS:
        return _scored_top(components, k, weights)
    name = located[0]
    places, asked = components[name]
    share = weights[name] / sum(weights[c] for c in components)
    others = [sides for c, sides in components.items() if c != name]
    if not others:
        return top(_near_places(places, asked, k, share), k)

    def known(no: int, key: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [sides[no].where(vectors.usable(F.col("embedding"))).select(key) for sides in others]).distinct()

    contracts, queries = known(0, "contract_id"), known(1, "query_id")
    theirs = asked.join(queries, "query_id", "left_semi")
    scored = _scored_top({**components, name: (places.join(contracts, "contract_id", "left_semi"), theirs)}, k, weights).drop("rank")
    parts = [_near_places(places, asked.join(queries, "query_id", "left_anti"), k, share), _near_places(places.join(contracts, "contract_id", "left_anti"), theirs, k, share)]
    alike = [part.select(*(F.col(c).cast(scored.schema[c].dataType).alias(c) for c in scored.columns)) for part in parts]
    return top(reduce(DataFrame.unionByName, alike, scored), k)


def _near_places(places: DataFrame, queries: DataFrame, k: int, share: float = 1.0) -> DataFrame:
    """(query_id, contract_id, similarity): ``share`` of the similarity by distance, of all contracts that can be among the k best
    of a query, measuring only places that the spatial index leaves.

    A contract may have several places: with at most m of them for each, the k best are among the (k - 1) m + 1 nearest.
    """
    most = places.groupBy("contract_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    near = spatial.candidates(places, queries, (k - 1) * most + 1, level=standardize.LOG1P_LEVEL, share=share)
    km = geo.planar_km(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon"))
    nearest_of_each = near.groupBy("query_id", "contract_id").agg(F.min(km).alias("distance"))
    return nearest_of_each.select("query_id", "contract_id", (standardize.log1p(F.col("distance")) * share).alias("similarity"))


def _scored_top(components: dict[str, tuple[DataFrame, DataFrame]], k: int, weights: dict[str, float]) -> DataFrame:
    """``fused_top`` by scoring every contract with every query."""
    spark = next(iter(components.values()))[0].sparkSession
    places = ["embedding" not in rows.columns for rows, _ in components.values()]

    def plain(rows: DataFrame, key: str, place: bool) -> DataFrame:
        if place:
            return rows.where(geo.located(F.col("lat"), F.col("lon"))).select(F.col(key).cast("long").alias(key), F.array(F.col("lat").cast("double"), F.col("lon").cast("double")).alias("v"))
        return rows.where(vectors.usable(F.col("embedding"))).select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("v"))

    sides = list(components.values())
    rows = reduce(DataFrame.unionByName, [plain(side[0], "contract_id", p).withColumn("no", F.lit(c)) for c, (side, p) in enumerate(zip(sides, places, strict=True))])
    asked = [plain(side[1], "query_id", p) for side, p in zip(sides, places, strict=True)]
    # Contracts of many rows: at most a PACK-th of all rows.
    many = rows.groupBy("contract_id").agg(F.count("*").alias("n")).where(F.col("n") > PACK).select("contract_id", F.expr(f"cast(n div {PACK} + 1 as int)").alias("parts"))
    few = rows.join(many, "contract_id", "left_anti").select("contract_id", F.lit(0).cast("long").alias("part"), F.lit(True).alias("whole"), "no", F.lit(1).cast("long").alias("times"), "v")
    # Equal rows of a large contract are counted first: they have one hash and would meet in one part.
    counted = rows.join(many, "contract_id").groupBy("contract_id", "parts", "no", "v").agg(F.count("*").alias("times"))
    much = counted.select("contract_id", F.pmod(F.xxhash64("v"), F.col("parts")).cast("long").alias("part"), F.lit(False).alias("whole"), "no", "times", "v")
    dealt = few.unionByName(much).repartition("contract_id", "part").sortWithinPartitions("contract_id", "part")
    n = reduce(DataFrame.unionByName, [q.select("query_id") for q in asked]).count()
    blocks = max(1, -(-n // BLOCK))
    listed = [weights[name] for name in components]

    def run(no: int) -> DataFrame:
        own = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == no
        block = _Block([[tuple(r) for r in q.where(own).orderBy("query_id").collect()] for q in asked], listed, places, k)
        sent = spark.sparkContext.broadcast(block)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            scorer = _Scorer(sent.value)
            step = max(1, 1_000_000 // sent.value.width)
            for batch in batches:
                for a in range(0, batch.num_rows if len(sent.value.names) else 0, step):
                    cut = batch.slice(a, step)
                    contract, part, whole, number, times = (cut.column(c).to_numpy(zero_copy_only=False) for c in range(5))
                    vs = [cut.column(5).filter(pa.array(number == c)) for c in range(len(listed))]
                    scorer.add(np.stack([contract, part], axis=1), whole, number, times, [v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0)) for v in vs])
                    yield from map(pa.RecordBatch.from_pandas, scorer.parts())
            scorer.close()
            yield from map(pa.RecordBatch.from_pandas, scorer.parts())
            scorer.settle()
            yield pa.RecordBatch.from_pandas(scorer.top(), preserve_index=False)

        return dealt.mapInArrow(score, "query_id long, contract_id long, no long, a double, b double")

    found = reduce(DataFrame.unionByName, [run(no) for no in range(blocks)])
    sums = [F.max(F.when(F.col("no") == -1, F.col("a"))).alias("all")]
    shares = []
    for c, place in enumerate(places):
        of = F.col("no") == c
        sums += [F.min(F.when(of, F.col("a"))).alias(f"a{c}")] if place else [F.sum(F.when(of, F.col("a"))).alias(f"a{c}"), F.sum(F.when(of, F.col("b"))).alias(f"b{c}")]
        value = standardize.log1p(F.col(f"a{c}")) if place else F.try_divide(f"a{c}", f"b{c}")
        shares.append(F.when(F.col(f"a{c}").isNotNull(), value) * (listed[c] / sum(listed)))
    parts = F.when(F.coalesce(*shares).isNotNull(), reduce(lambda x, y: x + y, [F.coalesce(x, F.lit(0.0)) for x in shares]))
    scored = found.groupBy("query_id", "contract_id").agg(*sums).select("query_id", "contract_id", F.coalesce("all", parts).alias("similarity"))
    types = {key: sides[0][i].schema[key].dataType for i, key in enumerate(("contract_id", "query_id"))}
    return top(scored.select(*(F.col(key).cast(types[key]).alias(key) for key in ("query_id", "contract_id")), "similarity"), k)


def top(rows: DataFrame, k: int = 1, digits: int | None = 9) -> DataFrame:
    """The k best contracts of each query with their rank; equal similarities (to ``digits``) go by contract."""
    by = F.col("similarity") if digits is None else F.round("similarity", digits)
    usable = rows.where(F.col("similarity").isNotNull() & ~F.isnan("similarity"))
    return nearest.top_k(usable, by.desc(), k, ["query_id"], ["contract_id"])
