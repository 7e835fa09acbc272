"""Files in and out and the batch jobs, as round trips: what is written to the shared folder is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import jobs
from ..sources import files
from . import roles
from .roles import table, with_roles

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def embed(rows: DataFrame) -> DataFrame:
    """Stands for a model: (…, item) with an embedding of four hashed numbers."""
    return rows.withColumn("embedding", vectors.hashed_embedding(F.col("item"), 4))


def hashed_sql(text: str, dims: int = 4) -> str:
    return f"list_transform(range(1, {dims + 1}), lambda i: ('0x' || md5('0:' || i || ':' || {text})[:8])::bigint / 4294967296.0::double)"


_ROUNDED = "list_transform({}, lambda x: round(x, 6))"


def _rounded(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, F.transform(column, lambda x: F.round(x, 6)))


# Sources


@query("op_a18_tab_separated", with_roles("cpv") + "select id, code, name, case when id % 3 = 0 then id // 3 end as parent_id from cpv")
def tab_separated(spark: SparkSession, sf: str) -> DataFrame:
    path = files.scratch(spark)
    roles.cpv(spark, sf).select("id", "code", "name", F.expr("if(id % 3 = 0, id div 3, null)").alias("parent_id")).write.csv(path, sep="\t", header=True)
    return files.separated(spark, path, "id long, code string, name string, parent_id long")


@query("op_a19_renamed_columns", "select c_custkey as id, c_mktsegment as cpvs from customer")
def renamed_columns(spark: SparkSession, sf: str) -> DataFrame:
    path = files.scratch(spark)
    table(spark, sf, "customer").select("c_name", "c_custkey", "c_mktsegment", "c_acctbal").write.csv(path, header=True)
    return files.separated(spark, path, "ECZ string, id long, cpvs string, balance double", ["id", "cpvs"], ",")


@query(
    "op_a21_scored_pairs",
    """with r as (select item_id, (item_id % 3)::varchar as name, row_number() over (partition by item_id % 3 order by item_id) - 1 as line, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) as s, (item_id % 6)::double as score from benchmark)
select name, line, s[1:40] as a, s[41:80] as b, score from r where item_id % 5 <> 0""",
)
def scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Files of pairs and of scores, some of them blank, aligned by line."""
    said = F.trim(F.regexp_replace("text", "[ \\t\\r\\n]+", " "))
    rows = table(spark, sf, "benchmark").select(F.expr("item_id % 3").alias("name"), "item_id", F.concat(F.substring(said, 1, 40), F.lit("\t"), F.substring(said, 41, 40)).alias("pair"), F.expr("if(item_id % 5 = 0, '', cast(item_id % 6 as string))").alias("score"))
    whole = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", c))), lambda x: x[c]), "\n").alias(c)
    grouped = rows.groupBy("name").agg(whole("pair"), whole("score"))
    inputs, scores = files.scratch(spark), files.scratch(spark)
    files.texts_beside(grouped, inputs, "name", "pair")
    files.texts_beside(grouped, scores, "name", "score")
    return files.scored_pairs(spark, f"{inputs}/name=*", f"{scores}/name=*", "/name=([^/]*)_ext/")


@query("op_a25_documents_of_size", "select item_id::varchar as name, strlen(text) + 1 as length from benchmark where strlen(text) + 1 between 300 and 600")
def documents_of_size(spark: SparkSession, sf: str) -> DataFrame:
    folder = files.scratch(spark)
    files.texts_beside(table(spark, sf, "benchmark"), folder, "item_id")
    found = files.documents_of_size(spark, folder, low=300, high=600)
    return found.select(F.regexp_extract("path", "/name=([^/]*)_ext/", 1).alias("name"), F.length("content").cast("long").alias("length"))


@query("op_a27_word_vectors", "select 'v' || vec_id as word, round(list_sum(embedding::double[]), 5) as total from embeddings where label = 3")
def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = files.scratch(spark), table(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("word"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    files.embedding_lines(rows, path)
    found = files.word_vectors(spark, path, rows.where("label = 3"))
    return found.select("word", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def _references(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    made = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("name")).agg(F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("name")))).alias("items"), F.max("n_name").alias("last"))
    text = F.to_json(F.struct(F.struct("items").alias("subject"), F.col("last").alias("subject2"), F.concat("last", F.lit("\ncontext")).alias("subject_context")))
    files.texts_beside(made.select("name", text.alias("text")), folder, "name", suffix="_ref")
    return files.references(spark, f"{folder}/name=*")


@query("op_a28_reference_json", "select n_regionkey::varchar as name, list(n_name order by n_name) as items, max(n_name) as subject2, max(n_name) || chr(10) || 'context' as subject_context from nation group by 1")
def reference_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = _references(spark, sf, files.scratch(spark))
    return rows.select(F.regexp_extract("path", "/name=([^/]*)_ref/", 1).alias("name"), "items", "subject2", "subject_context")


@query("op_r2_extracts", "select item_id::varchar as name, text from benchmark where item_id % 4 <> 1 and item_id % 10 <> 7")
def extracts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole extracted files but those of excluded contracts and those whose path says so."""
    rows, folder = table(spark, sf, "benchmark"), files.scratch(spark)
    where = F.when(F.expr("item_id % 10 = 7"), F.lit("test_src")).otherwise(F.lit("src"))
    named = rows.select(F.concat(F.lit("contract"), F.expr("item_id % 4")).alias("contract"), where.alias("kind"), F.col("item_id").alias("file"), F.col("text").alias("value"))
    named.repartition("file").write.partitionBy("contract", "kind", "file").text(folder)
    excluded = spark.createDataFrame([("contract=contract1",)], "name string")
    found = files.extracts(spark, folder, ".txt", excluded=excluded)
    return found.select(F.regexp_extract("path", "/file=([^/]*)/", 1).alias("name"), F.regexp_replace("text", r"\n\z", "").alias("text"))


# Sinks


def _items(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_name")).alias("items"))
    return embed(files.items_as_rows(grouped, "s_nationkey", "items"))


@query("op_b1_appended_items", "select s_nationkey, pos::int as pos, s_name as item, n from (select *, row_number() over (partition by s_nationkey order by s_name) - 1 as pos from supplier), (values (1), (2)) t(n)")
def appended_items(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends keep both."""
    path, rows = files.scratch(spark), _items(spark, sf).select("s_nationkey", "pos", "item")
    files.appended(rows.withColumn("n", F.lit(1)), path)
    return files.appended(rows.withColumn("n", F.lit(2)), path)


@query("op_b3_replaced_subjects", f"select s_nationkey, s_name as item, {_ROUNDED.format(hashed_sql('s_name'))} as embedding from supplier where s_acctbal > 0")
def replaced_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """A second save leaves nothing of the first."""
    path = files.scratch(spark)
    rows = table(spark, sf, "supplier").select("s_nationkey", F.col("s_name").alias("item"), "s_acctbal")
    files.replaced(embed(rows.drop("s_acctbal")), path)
    return _rounded(files.replaced(embed(rows.where("s_acctbal > 0").drop("s_acctbal")), path))


@query("op_b4_replaced_interests", "select user_id, (row_number() over (partition by user_id order by event_type) - 1)::int as pos, event_type as item from (select distinct user_id, event_type from events)")
def replaced_interests(spark: SparkSession, sf: str) -> DataFrame:
    path = files.scratch(spark)
    grouped = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("items"))
    files.replaced(files.items_as_rows(grouped, "user_id", "items").limit(0), path)
    return files.replaced(files.items_as_rows(grouped, "user_id", "items"), path)


@query("op_b8_texts_beside", "select item_id::varchar as name, text from benchmark")
def texts_beside(spark: SparkSession, sf: str) -> DataFrame:
    return files.texts_beside(table(spark, sf, "benchmark"), files.scratch(spark), "item_id")


@query("op_b9_scored_references", "select n_regionkey::varchar as name, count(*) as n_items, n_regionkey / 10.0::double as evaluation from nation group by n_regionkey")
def scored_references(spark: SparkSession, sf: str) -> DataFrame:
    found = _references(spark, sf, files.scratch(spark))
    scores = found.select("path", (F.regexp_extract("path", "/name=([^/]*)_ref/", 1).cast("int") / 10).alias("evaluation"))
    done = files.scored_references(found, scores, files.scratch(spark))
    return done.select(F.regexp_extract("path", "/name=([^/]*)_ref/", 1).alias("name"), F.size("items").cast("long").alias("n_items"), "evaluation")


@query("op_r18_embedding_and_json_lines", "select 'v' || vec_id as word, run from embeddings, (values (1), (2)) t(run)")
def embedding_and_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as lines of text read again, then results of two runs appended as JSON lines."""
    vectors_at, results = files.scratch(spark), files.scratch(spark)
    files.embedding_lines(table(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("word"), "embedding"), vectors_at)
    rows = files.word_vectors(spark, vectors_at).where("size(embedding) > 0").select("word")
    files.json_lines(rows.withColumn("run", F.lit(1)), results)
    return files.json_lines(rows.withColumn("run", F.lit(2)), results)


# Jobs


@query("op_m14_code_job", with_roles("contract_doc", "cpv") + "select distinct contract_id, id as cpv_id from contract_doc join cpv on id = doc_id + 1 where contract_id not in (select doc_id // 3 from labels)")
def code_job(spark: SparkSession, sf: str) -> DataFrame:
    """Codes that documents name, of contracts that have no label yet."""
    known = roles.cpv(spark, sf).select("id", "code")
    codes = known.select(F.expr("id - 1").alias("doc_id"), "code")
    docs = roles.contract_doc(spark, sf).join(codes, "doc_id", "left").select("contract_id", "doc_id", F.concat("text", F.lit(" kód "), F.coalesce("code", F.lit("-")), F.lit(" a 99999999-x, kód "), F.coalesce("code", F.lit("-"))).alias("text"))
    return jobs.contract_codes(docs, table(spark, sf, "labels").select(F.expr("doc_id div 3").alias("contract_id")), known)


@query("op_m16_embedding_job", f"select s_suppkey as entity_id, item, {_ROUNDED.format(hashed_sql('item'))} as embedding from (select s_suppkey, unnest([s_name, 'země ' || n_name]) as item from supplier join nation on n_nationkey = s_nationkey)")
def embedding_job(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    entities = table(spark, sf, "supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("entity_id"), F.concat("s_name", F.lit("\n\nzemě "), "n_name", F.lit("\n")).alias("description"))
    return _rounded(files.replaced(jobs.entity_embeddings(entities, embed), files.scratch(spark)))


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("ico"), F.expr("if(s_acctbal < 0, 1D, null)").alias("lat"), F.expr("if(s_acctbal < 0, 2D, null)").alias("lon"), "s_name", "s_nationkey")


def _asked(rows: DataFrame) -> DataFrame:
    """Stands for the registry's service: an answer with an address and as many subjects as the last digit of the number."""
    subjects = "array_join(transform(sequence(0, 9), k -> if(k < cast(right(ico, 1) as int), concat('<D:PP><D:T> obor ', k div 2, '</D:T></D:PP>'), '')), '')"
    return rows.select("entity_id", F.expr(f"concat('<are:Odpoved xmlns:are=\"http://x\" xmlns:D=\"http://y\"><D:AA><D:N>Brno</D:N><D:CD>', entity_id, '</D:CD></D:AA><D:PPI>', {subjects}, '</D:PPI></are:Odpoved>')").alias("xml"))


def _located(rows: DataFrame) -> DataFrame:
    """Stands for a geocoder: the house number decides."""
    number = F.split("address", ",")[4].cast("double")
    return rows.select("entity_id", (48.5 + number / 1000).alias("lat"), (12.5 + number / 1000).alias("lon"))


@query("op_m17_registry_job", "select s_suppkey as entity_id, round(case when s_acctbal < 0 then 1 else 48.5 + s_suppkey / 1000.0 end, 6)::double as lat, case when s_acctbal < 0 then 0 else (s_suppkey % 10 + 1) // 2 end as n_subjects from supplier")
def registry_job(spark: SparkSession, sf: str) -> DataFrame:
    placed, more = jobs.registry_enriched(_registry(spark, sf).select("entity_id", "ico", "lat", "lon"), _asked, _located)
    counted = files.appended(more, files.scratch(spark)).groupBy("entity_id").agg(F.count("*").alias("n_subjects"))
    return placed.join(counted, "entity_id", "left").select("entity_id", F.round("lat", 6).alias("lat"), F.coalesce("n_subjects", F.lit(0)).alias("n_subjects"))


@query("op_h18_registry_subjects", "select s_suppkey as entity_id, list_transform(range((s_suppkey % 10 + 1) // 2), lambda k: 'obor ' || k) as subjects, 'Brno,,,,' || s_suppkey || ',' as address from supplier")
def registry_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(_registry(spark, sf)).select("entity_id", jobs.registry_subjects("xml").alias("subjects"), jobs.registry_address("xml").alias("address"))


@query("op_b7_m18_code_import", with_roles("cpv") + f"select id, code, name, {_ROUNDED.format(hashed_sql('name'))} as embedding from cpv")
def code_import(spark: SparkSession, sf: str) -> DataFrame:
    """A code list as a file, embedded and inserted."""
    path = files.scratch(spark)
    roles.cpv(spark, sf).write.csv(path, sep="\t", header=True)
    rows = files.separated(spark, path, "id long, code string, name string")
    return _rounded(files.appended(jobs.imported_codes(rows, embed), files.scratch(spark)))


@query("op_h3_hashed_embedding", f"select n_nationkey, {_ROUNDED.format(hashed_sql('n_name', 6))} as embedding from nation")
def hashed_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(table(spark, sf, "nation").select("n_nationkey", vectors.hashed_embedding(F.col("n_name"), 6).alias("embedding")))
