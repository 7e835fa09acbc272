"""Mean ranks by parts against plain sorting; no task sorts a group."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tributary.operators import evaluation


def test_ranks_by_parts_are_those_of_sorted_groups(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), float(draw.choice([draw.randrange(9), draw.gauss(0, 50)]))) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    for parts in (1, 2, 16):
        found = {(r["_by"], r["_value"]): r["rank"] for r in evaluation.average_ranks(df, "g", "v", "rank", parts).collect()}
        want = {}
        for g in ("a", "b", None):
            own = sorted(v for name, v in rows if name == g)
            want |= {(g, v): own.index(v) + (own.count(v) + 1) / 2 for v in own}
        assert found == want


def test_no_window_over_a_whole_group(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"), (F.col("id") % 7).alias("y"))
    plan = evaluation.correlations(df, "g", "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_part" in line for line in windows), plan
