"""Profiles that learn from behaviour: searched items and viewed contracts become cached items, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def cached_items(events: DataFrame, key: str = "user_id", item: str = "event_type", at: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, cache): each user's distinct items in the order of their first appearance."""
    first = events.groupBy(key, item).agg(F.min(F.struct(at, order)).alias("first"))
    return first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first", item))).alias("all")).select(key, F.col(f"all.{item}").alias("cache"))


def new_items(events: DataFrame, late: str = "1 day", key: str = "user_id", item: str = "event_type", at: str = "ts") -> DataFrame:
    """Of a stream of events those that bring a user a new item; repeats within the watermark are dropped, state older than it too."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key, item]).select(key, item, at)


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day", key: str = "user_id", at: str = "ts") -> DataFrame:
    """Events a user and window; events later than the watermark are not counted."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to the profile items at ``path``, as far as there is input."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def on_new_documents(stream: DataFrame, process, path: str, checkpoint: str) -> StreamingQuery:
    """Run a batch pipeline on each arrival of documents; what it returns goes to a folder ``batch=<id>`` of its own, so a
    batch that is run again after a failure replaces what it had written."""

    def run(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
