"""Loads, regroupings, joins and saves of the relational layer, over DataFrames of its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def load(rows: DataFrame, condition: dict[str, object] | None = None, broadcast_over: int = 1000) -> DataFrame:
    """Rows that meet a condition: a value means equality, a list membership; long lists become a semi-join."""
    for column, value in (condition or {}).items():
        if isinstance(value, (list, tuple, set)):
            values = list(value)
            if len(values) > broadcast_over:
                keys = rows.sparkSession.createDataFrame([(v,) for v in values], rows.select(column).schema)
                rows = rows.join(keys, column, "left_semi")
            else:
                rows = rows.where(F.col(column).isin(values))
        else:
            rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
    return rows


def regrouped(rows: DataFrame, key: str, order: list[str], columns: dict[str, str]) -> DataFrame:
    """One row for each key with index-aligned arrays: ``columns`` maps a column to its array's name. Nulls inside stay."""
    all_of = F.sort_array(F.collect_list(F.struct(*order, F.struct(*columns).alias("kept"))))
    grouped = rows.groupBy(key).agg(all_of.alias("all"))
    return grouped.select(key, *(F.col("all.kept").getField(c).alias(name) for c, name in columns.items()))


def joined_items(links: DataFrame, enumeration: DataFrame, link: str, key: str = "id") -> DataFrame:
    """Inner join of (contract_id, link) with an enumeration."""
    return links.join(enumeration, links[link] == enumeration[key]).drop(link)


def enumeration(rows: DataFrame, code: str = "code", order: str = "id") -> DataFrame:
    """One row for each code: of duplicates the last one stays."""
    last = Window.partitionBy(code).orderBy(F.col(order).desc())
    return rows.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def unprocessed(documents: DataFrame, done: DataFrame, key: str = "contract_id", n: int = 10, seed: int | None = None) -> DataFrame:
    """Documents of n contracts that have none of their rows in ``done``; random ones with a seed, else those with the least keys.

    A null key in ``done`` excludes nothing.
    """
    open_ = documents.select(key).where(F.col(key).isNotNull()).distinct().join(done.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    batch = open_.orderBy(*([F.rand(seed)] if seed is not None else []), key).limit(n)
    return documents.join(batch, key, "left_semi")


def merged_items(own: DataFrame, more: DataFrame, key: str = "contract_id", items: str = "items") -> DataFrame:
    """Full outer join of two tables of item arrays: own items first, then the others; a missing side counts as empty."""
    b = more.select(F.col(key), F.col(items).alias("_more"))
    none = F.array()
    both = own.select(key, items).join(b, key, "full")
    return both.select(key, F.concat(F.coalesce(items, none), F.coalesce("_more", none)).alias(items))


def wide(base: DataFrame, *parts: DataFrame, key: str = "contract_id") -> DataFrame:
    """Left joins of all parts on one key."""
    for part in parts:
        base = base.join(part, key, "left")
    return base


def looked_up(rows: DataFrame, key: str, lists: DataFrame, list_key: str, values: str) -> DataFrame:
    """A list for each row by its trimmed key, the empty list where there is none."""
    found = lists.select(F.trim(F.col(list_key).cast("string")).alias("_key"), F.col(values))
    return rows.join(found, F.trim(F.col(key).cast("string")) == F.col("_key"), "left").withColumn(values, F.coalesce(values, F.array())).drop("_key")


def zipped(*arrays: str) -> Column:
    """Parallel arrays as one array of structs, as long as the shortest."""
    short = F.least(*(F.size(a) for a in arrays)) if len(arrays) > 1 else F.size(arrays[0])
    return F.slice(F.arrays_zip(*arrays), 1, short)


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns of ``changes`` where it has the key and a value."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = rows.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def numbered(rows: DataFrame, key: str, order: list[str], start: int = 1) -> DataFrame:
    """New keys without gaps in the given order. Only offsets of partitions are gathered: rows are sorted by range, counted
    a partition, and numbered inside it, so no task has them all."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = sizes.select("_part", "_low", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    # One row of four numbers for each partition.
    out = spread.join(F.broadcast(before), "_part")
    return out.withColumn(key, F.coalesce("_before", F.lit(0)) + F.col("_at") - F.col("_low") + start).drop("_part", "_at", "_low", "_before")


def most_frequent(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value that a group has most often; of equals the one that comes first."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "first")).alias(value))


def frequent(rows: DataFrame, value: str, more_than: int = 100) -> DataFrame:
    """Values that occur more than a number of times."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def batches(rows: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """Consecutive batches of a size, as a column."""
    return numbered(rows, "batch", order, 0).withColumn("batch", F.expr(f"batch div {size}"))
