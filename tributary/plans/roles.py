"""The engine's roles on the test tables: the same arithmetic in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("contract_id"), F.expr("vec_id % 5").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"))


def query_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.expr("vec_id div 100").alias("query_id"), F.expr("(vec_id div 50) % 2").alias("query_pos"), F.col("embedding").cast("array<double>").alias("embedding"))


def entity_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("contract_id"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"))


def _place(rows: DataFrame, key: str, name: str, north: int = 37, east: int = 53) -> DataFrame:
    return rows.select(F.expr(key).alias(name), F.expr(f"48.55D + (({key} * {north}) % 250) / 100D").alias("lat"), F.expr(f"12.10D + (({key} * {east}) % 670) / 100D").alias("lon"))


def location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(table(spark, sf_dir, "customer"), "c_custkey", "contract_id")


def query_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth customer is a query, from another place than its own."""
    return _place(table(spark, sf_dir, "customer").where("c_custkey % 50 = 0"), "(c_custkey div 50)", "query_id", 41, 59)


def cpv(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "concat(lpad(cast((p_partkey * 12345) % 100000000 as string), 8, '0'), '-', cast(p_partkey % 10 as string))"
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(code).alias("code"), F.col("p_name").alias("name"))


def contract_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.expr("doc_id div 3").alias("contract_id"), "doc_id", "text")


#: The same in DuckDB's SQL; queries that join them start with WITH and the ones they need.
SQL = {
    "ref_item": "ref_item as (select vec_id // 5 as contract_id, vec_id % 5 as pos, embedding::double[] as embedding from embeddings)",
    "query_item": "query_item as (select vec_id // 100 as query_id, (vec_id // 50) % 2 as query_pos, embedding::double[] as embedding from embeddings where vec_id % 50 = 0)",
    "entity_item": "entity_item as (select label::bigint as contract_id, vec_id as pos, embedding::double[] as embedding from embeddings)",
    "location": "location as (select c_custkey as contract_id, 48.55::double + ((c_custkey * 37) % 250) / 100.0::double as lat, 12.10::double + ((c_custkey * 53) % 670) / 100.0::double as lon from customer)",
    "query_location": "query_location as (select c_custkey // 50 as query_id, 48.55::double + ((c_custkey // 50 * 41) % 250) / 100.0::double as lat, 12.10::double + ((c_custkey // 50 * 59) % 670) / 100.0::double as lon from customer where c_custkey % 50 = 0)",
    "cpv": "cpv as (select p_partkey as id, lpad(((p_partkey * 12345) % 100000000)::varchar, 8, '0') || '-' || (p_partkey % 10)::varchar as code, p_name as name from part)",
    "contract_doc": "contract_doc as (select doc_id // 3 as contract_id, doc_id, text from documents)",
}


def with_roles(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names) + "\n"
