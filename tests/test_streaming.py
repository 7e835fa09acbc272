"""Streams over files: new items once, late events out, batches that are run again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.streaming import profiles

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def written(spark, tmp_path, rows, name: str) -> None:
    made = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string")
    made.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type").coalesce(1).write.parquet(f"{tmp_path}/{name}")


def test_items_of_a_stream_come_once_and_are_appended(spark, tmp_path):
    written(spark, tmp_path, [(1, "2024-01-01 10:00:00", 7, "view"), (2, "2024-01-01 11:00:00", 7, "view"), (3, "2024-01-01 12:00:00", 7, "cart"), (4, "2024-01-01 12:00:00", 8, "view")], "in/a")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        profiles.append_to(profiles.new_items(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["user_id"], r["event_type"]) for r in found) == [(7, "cart"), (7, "view"), (8, "view")]
    batch = {r["user_id"]: r["cache"] for r in profiles.cached_items(spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")).collect()}
    assert batch == {7: ["view", "cart"], 8: ["view"]}


def test_events_later_than_the_watermark_are_not_counted(spark, tmp_path):
    counted = lambda: profiles.windowed_counts(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
    written(spark, tmp_path, [(1, "2024-01-05 10:00:00", 7, "view"), (2, "2024-01-05 11:00:00", 7, "view")], "in/a")
    run = lambda: profiles.append_to(counted().select("window.start", "user_id", "n"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    run()
    written(spark, tmp_path, [(3, "2024-01-09 10:00:00", 7, "view")], "in/b")
    run()
    written(spark, tmp_path, [(4, "2024-01-05 12:00:00", 7, "view"), (5, "2024-01-12 10:00:00", 7, "view")], "in/c")
    run()
    found = sorted((str(r["start"])[:10], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == [("2024-01-05", 2), ("2024-01-09", 1)]


def test_a_batch_that_is_run_again_is_written_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    for k in range(2):  # a new checkpoint: the same batch is run again
        profiles.on_new_documents(stream(), lambda b: b.withColumn("text", F.upper("text")), f"{tmp_path}/out", f"{tmp_path}/checkpoint{k}").awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["A", "B"]
