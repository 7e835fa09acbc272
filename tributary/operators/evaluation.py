"""Comparisons of texts and of scores: token overlap, correlations and their averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import text as T
from ..functions import vectors as V
from . import relational

#: Parts in which the values of groups are ranked.
PARTS = 64


def tokens(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, n) of each text's words, split at white space."""
    words = F.filter(F.split(F.col(text), T.WORDS), lambda w: w != "")
    return rows.select(key, F.explode(words).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def overlap(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, common, either, total): multiset intersection, union and sum of the tokens of each pair.

    ``left`` and ``right``: (a, token, n) and (b, token, n). Only common tokens are joined; the rest follows from the sizes.
    """
    size = lambda rows, key, name: rows.groupBy(key).agg(F.sum("n").alias(name))
    common = pairs.join(left.withColumnRenamed("n", "na"), a).join(right.withColumnRenamed("n", "nb"), [b, "token"]).groupBy(a, b).agg(F.sum(F.least("na", "nb")).alias("common"))
    sized = pairs.join(size(left, a, "sa"), a, "left").join(size(right, b, "sb"), b, "left").join(common, [a, b], "left").na.fill(0, ["sa", "sb", "common"])
    return sized.select(a, b, "common", (F.col("sa") + F.col("sb") - F.col("common")).alias("either"), (F.col("sa") + F.col("sb")).alias("total"))


def jaccard(common: Column, either: Column) -> Column:
    return F.coalesce(F.try_divide(common, either), F.lit(0.0))


def dice(common: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(2 * common, total), F.lit(0.0))


def average_ranks(rows: DataFrame, by: str, value: str, rank: str, parts: int = PARTS) -> DataFrame:
    """(by, value, rank) of each group's distinct values, equal ones at the mean of their places.

    A group is not sorted in one task: its counted values are cut at quantiles, and a part begins where the ones before end.
    """
    counted = rows.groupBy(by, value).agg(F.count("*").alias("_n"))
    cuts = sorted(set(counted.approxQuantile(value, [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    part = sum(((F.col(value) > cut).cast("int") for cut in cuts), F.lit(0))
    placed = counted.withColumn("_part", part)
    inside = Window.partitionBy(by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each group and part.
    sizes = placed.groupBy(F.col(by).alias("_by"), "_part").agg(F.sum("_n").alias("_n"))
    starts = sizes.select("_by", F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    numbered = placed.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    joined = numbered.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")))
    return joined.select(F.col(by).alias("_by"), F.col(value).alias("_value"), (F.col("_start") + F.col("_before") + (F.col("_n") + 1) / 2).alias(rank))


def correlations(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, pearson, spearman, n); NaN and null count as 0, as missing similarities do."""
    clean = rows.select(by, *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in (x, y)))
    ranked = clean
    for value, rank in ((x, "rx"), (y, "ry")):
        ranks = average_ranks(clean, by, value, rank)
        ranked = ranked.join(ranks, F.col(by).eqNullSafe(F.col("_by")) & (F.col(value) == F.col("_value"))).drop("_by", "_value")
    return ranked.groupBy(by).agg(F.corr(x, y).alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.count("*").alias("n"))


def mean_correlations(each: DataFrame) -> DataFrame:
    """One row: plain means, and means weighted by sample size."""
    weighted = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return each.agg(F.avg("pearson").alias("pearson"), F.avg("spearman").alias("spearman"), weighted("pearson").alias("pearson_weighted"), weighted("spearman").alias("spearman_weighted"))


def score_100(rows: DataFrame, score: str) -> DataFrame:
    return rows.agg((F.avg(score) * 100).alias("score"))


def word_means(rows: DataFrame, vectors: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, vector): mean of the vectors (word, embedding) of a text's words; the zero vector where none is known."""
    words = F.filter(F.split(F.col(text), T.WORDS), lambda w: w != "")
    each = rows.select(key, F.explode(words).alias("word")).join(vectors, "word").select(key, F.posexplode("embedding").alias("at", "x"))
    mean = each.groupBy(key, "at").agg(F.avg("x").alias("x")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select(key, F.col("v.x").alias("vector"))
    return rows.select(key).join(mean, key, "left").select(key, F.coalesce("vector", F.array_repeat(F.lit(0.0), dims)).alias("vector"))


def dictionary(rows: DataFrame, text: str, least: int = 1) -> DataFrame:
    """(word, n) of words that occur at least a number of times."""
    words = F.filter(F.split(F.col(text), T.WORDS), lambda w: w != "")
    return rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def validated(found: DataFrame, references: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, score): multiset Jaccard of each found text with its reference; 0 without common words."""
    pairs = found.join(references.select(key), key, "left_semi").select(F.col(key).alias("a"), F.col(key).alias("b"))
    side = lambda rows, name: tokens(rows.select(F.col(key).alias(name), F.col(text).alias("text")), name)
    return overlap(pairs, side(found, "a"), side(references, "b")).select(F.col("a").alias(key), jaccard(F.col("common"), F.col("either")).alias("score"))


def similarity_matrix(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(a, b, similarity) of every pair of an evaluation's texts, their own included, by multiset Jaccard.

    Common words are counted by a join on words; the pairs themselves are the result, so give it a set whose square is wanted.
    """
    ids = rows.select(F.col(key).alias("a"))
    words = tokens(rows.select(F.col(key).alias("a"), F.col(text).alias("text")), "a")
    pairs = ids.join(ids.withColumnRenamed("a", "b"))
    return overlap(pairs, words, words.withColumnRenamed("a", "b")).select("a", "b", jaccard(F.col("common"), F.col("either")).alias("similarity"))


def sts(pairs: DataFrame, vectors_of: DataFrame, key: str, dims: int) -> DataFrame:
    """(name, pearson, spearman, n) of pairs (key, name, a, b, score): cosine similarity of mean word vectors against the score, by dataset."""
    mean = lambda c: word_means(pairs.select(key, F.col(c).alias("text")), vectors_of, key, "text", dims).withColumnRenamed("vector", f"vector_{c}")
    both = pairs.join(mean("a"), key).join(mean("b"), key)
    scored = both.select("name", (1 - V.cosine_distance(F.col("vector_a"), F.col("vector_b"), V.norm(F.col("vector_a")), V.norm(F.col("vector_b")))).alias("similarity"), "score")
    return correlations(scored, "name", "similarity", "score")


def matched_well(matches: DataFrame, text: str, diff: str, lines: float = 0.25, most: float = 0.1) -> DataFrame:
    """Matches whose text has not too many line breaks for its length, and whose difference is small for it."""
    size, breaks = F.length(text), F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    return matches.where((breaks / (size + 1) <= lines) & (F.try_divide(F.col(diff), size) < most))


def aggregated_matches(matches: DataFrame, path: str) -> DataFrame:
    """Matches with the name of the document, the last part of its path, and of the contract, the second to fourth."""
    parts = F.split(path, "/")
    return matches.withColumn("doc_name", F.element_at(parts, -1)).withColumn("contr_name", F.array_join(F.slice(parts, 2, 3), "/"))


def contract_texts(docs: DataFrame) -> DataFrame:
    """(contr_name, id, text) of documents (contr_name, doc_name, contr_id, text): texts behind banners in order of names, and
    the id that most documents have, of equals the first one's."""
    banner = "=" * 23
    listed = docs.groupBy("contr_name").agg(F.sort_array(F.collect_list(F.struct("doc_name", "text"))).alias("all"))
    text = F.array_join(F.transform("all", lambda d: F.concat(F.lit(banner), d["doc_name"].cast("string"), F.lit(banner + "\n"), d["text"])), "")
    ids = relational.most_frequent(docs, "contr_name", "contr_id", "doc_name").withColumnRenamed("contr_id", "id")
    return listed.select("contr_name", text.alias("text")).join(ids, "contr_name")


def concordances(docs: DataFrame, keywords: list[str], key: str = "doc_id", text: str = "text", around: int = 50) -> DataFrame:
    """(key, keyword, at, context): every place of every keyword, in either case, with the characters around it."""
    start = F.greatest(F.col("occ") - around, F.lit(0)) + 1
    each = docs.select(key, F.col(text).alias("_text"), F.explode(K.hits(F.col(text), keywords)).alias("h")).select(key, "_text", "h.keyword", "h.occ")
    return each.select(key, "keyword", F.col("occ").alias("at"), F.substring("_text", start, F.least("occ", F.lit(around)) + F.length("keyword") + around).alias("context"))
