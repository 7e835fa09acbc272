"""From contexts to the items of a contract's subject: cleaning, extraction, dependency filtering, merging.

Each step of the cleaning is a projection of its own, so that no text is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import items as I
from ..functions import text as T


def cleaned(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with their contexts cleaned: the first nineteen steps of the default chain."""
    for _, step in I.CLEANING:
        rows = rows.withColumn(text, step(F.col(text)))
    return rows


def with_attributes(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with items and names, in pair tags, behind their cleaned contexts: the last six steps of the chain."""
    for tag, found in I.EXTRACTION:
        rows = rows.withColumn(text, I.tagged_behind(F.col(text), found, tag))
    return rows


def preprocessed(rows: DataFrame, text: str = "text") -> DataFrame:
    """The default chain of 25 steps."""
    return with_attributes(cleaned(rows, text), text)


def subject_items(contexts: DataFrame, key: list[str], text: str = "context", sentences: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, items): the lines of items and names that contexts give, one text for each.

    Items are the tagged lines of the preprocessed context, followed by what ``sentences`` leaves of its text: a function
    from (key, text) rows to the same, such as annotation with ``trees.subject_parts``; without one, no sentences add.
    """
    done = preprocessed(contexts.select(*key, F.col(text).alias("text")))
    own = done.select(*key, T.attributes_only(F.col("text")).alias("own"))
    if sentences is None:
        both = own.withColumn("all", F.col("own"))
    else:
        more = sentences(done).select(*key, T.tagged(F.col("text"), "ITEM").alias("more"))
        both = own.join(more, key, "left").withColumn("all", F.concat_ws("\n", "own", "more"))
    return both.select(*key, T.tags_cleaned(F.col("all")).alias("items"))


def extracted(docs: DataFrame, found: DataFrame, key: str, sentences: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, items): the items of a document's ``found`` contexts (key, start, context), in their order, joined by line feeds."""
    each = subject_items(found, [key, "start"], "context", sentences)
    listed = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "items"))).alias("all"))
    items = listed.select(key, F.array_join(F.filter(F.col("all.items"), lambda x: x != ""), "\n").alias("items"))
    return docs.select(key).join(items, key, "left").withColumn("items", F.coalesce("items", F.lit("")))
