"""Every query that has SQL, against DuckDB; the others run. Goldens of the formulas. The entry file needs no session."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from tributary.functions import standardize
from tributary.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    import duckdb

    con = duckdb.connect()
    compare.views(con, SF)
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert compare.difference(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_standardizers_keep_their_published_values(spark):
    row = spark.range(1).select(
        standardize.cosine(F.lit(0.5445505853395554)).alias("cosine"),
        standardize.log1p(F.lit(0.7850719900135416)).alias("near"),
        standardize.log1p(F.lit(-1.0)).alias("negative"),
        standardize.inverse_capped(F.lit(4.0)).alias("inverse"),
    ).first()
    assert (row["cosine"], row["near"], row["negative"], row["inverse"]) == (0.7277247073302223, 1.0, 1.0, 0.25)


def test_entry_imports_without_a_session():
    top = Path(__file__).parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=top, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0 and int(done.stdout.split()[0]) > 100


@pytest.mark.parametrize("name", ["op_h7_find_occurrences", "op_h21_concordance", "op_e21_keyword_histogram"])
def test_texts_whose_lower_case_is_longer(spark, tmp_path, name):
    import __spark_entry__ as driver

    texts = ["Of the old town \u0130stanbul'da \u0130\u0130 a license for x, License again " + "y" * 700 + " LICENSE end", "no \u0130 word", "\u0130" * 30 + "L\u0130CENSE of some length here", "plain text with more than twenty letters before its license stands"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    compare.views(con, str(tmp_path))
    df = driver.queries()[name](spark, str(tmp_path))
    assert {0, 2} <= {r["doc_id"] for r in df.collect()}
    assert compare.difference(df, con, driver.oracle_sql()[name]) == ""


def test_lists_of_a_nation_do_not_travel_with_customers_and_orders(spark):
    """In op_a9 the join with the lists comes last and is a broadcast, so no exchange or sort of rows holds one."""
    df = registry.queries()["op_a9_contract_entity_subjects"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "s_nationkey" in joins[0] and "o_custkey" in joins[1] and "strategy=broadcast" in joins[0], plan


@pytest.mark.parametrize("name", ["op_c16_word_vector_similarity", "op_e1_item_similarity"])
def test_no_row_for_each_pair_of_vectors(spark, name):
    """Vectors are compared inside tasks; a join without a key made a row for each pair before."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner" not in plan, plan  # joins of contracts alone are left_anti and left_semi


@pytest.mark.parametrize("name", ["op_e8_component_subset_topk", "op_m10_sections"])
def test_same_rows_as_sql_where_places_are_many(spark, con, monkeypatch, name):
    from tributary.operators import similarity

    monkeypatch.setattr(similarity, "PAIRS", 0)
    assert compare.difference(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == ""


def test_equal_lists_of_a_nation_follow_each_other(spark, con, tmp_path, monkeypatch):
    """The rows of op_a9, written: compression finds a list again only near its last place. They took 12.8 MB before."""
    import random

    from tributary.plans import relational_queries

    rng = random.Random(5)
    monkeypatch.setattr(relational_queries, "LOT", 2_000, raising=False)
    spark.createDataFrame([(k, f"{k}") for k in range(8)], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k, k % 8) for k in range(8 * 1500)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, k % 8) for k in range(100)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, rng.randrange(100)) for k in range(6_000)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    df = registry.queries()["op_a9_contract_entity_subjects"](spark, str(tmp_path))
    df.write.parquet(f"{tmp_path}/out")
    written = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert written < 6_000 * 1500, written
    own = duckdb.connect()
    compare.views(own, str(tmp_path))
    said = own.execute(f"select count(*), count(distinct contract_id), bool_and(contract_id in (select o_orderkey from orders)) from '{tmp_path}/out/*.parquet'").fetchone()
    assert said == (6_000, 6_000, True)
    wrong = own.execute(f"select count(*) from '{tmp_path}/out/*.parquet' join orders on o_orderkey = contract_id join customer on c_custkey = o_custkey where subjects <> list_transform(range(1500), lambda k: k * 8 + c_nationkey)").fetchone()
    assert wrong == (0,)
