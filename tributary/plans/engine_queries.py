"""The search engine's own answers, profiles, and the research loops around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors
from ..operators import evaluation, jobs, nearest, relational
from ..sources import files
from . import roles, search
from .roles import table, with_roles
from .similarity_queries import FUSE, ITEMS, PLACES, THREE, top_sql
from .storage_queries import embed, hashed_sql

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def _engine(spark: SparkSession, sf: str, k: int = 5) -> search.SearchEngine:
    """Its model knows the embeddings by name (v and the id), its geocoder customers by number."""
    known = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("embedding"))
    places = roles.query_location(spark, sf).select(F.concat(F.lit("place "), "query_id").alias("address"), "lat", "lon")
    return search.SearchEngine(
        items=roles.ref_item(spark, sf),
        places=roles.location(spark, sf),
        entity_items=roles.entity_item(spark, sf),
        embed=lambda rows: rows.join(known, "item"),
        locate=lambda rows: rows.join(places, "address"),
        num_results=k,
    )


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, text): the names of a query's vectors, a line each, and one that the model does not know."""
    rows = table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.expr("vec_id div 100").alias("query_id"), "vec_id")
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return listed.select("query_id", F.concat(F.array_join(F.transform("ids", lambda k: F.concat(F.lit("v"), k)), "\n"), F.lit("\nunknown")).alias("text"))


def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    return roles.query_location(spark, sf).select("query_id", F.concat(F.lit("place "), "query_id").alias("address"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "contract_id", (F.round("similarity", 6) + F.lit(0.0)).alias("similarity"), "rank")


_ROLES = with_roles("ref_item", "query_item", "entity_item", "location", "query_location")


@query("op_m3_query_by_subject", _ROLES + ITEMS.format(items="ref_item") + top_sql("select * from mean", 5))
def query_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_engine(spark, sf).query_by_subject(_texts(spark, sf)))


@query("op_m3_query_by_entity_subject", _ROLES + ITEMS.format(items="entity_item") + top_sql("select * from mean", 5))
def query_by_entity_subject(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_engine(spark, sf).query_by_entity_subject(_texts(spark, sf)))


@query("op_m3_query_by_address", _ROLES + PLACES + top_sql("select * from near", 5))
def query_by_address(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_engine(spark, sf).query_by_address(_addresses(spark, sf)))


@query("op_m2_m4_query", _ROLES + ITEMS.format(items="ref_item") + PLACES + FUSE + top_sql(THREE, 5))
def all_components(spark: SparkSession, sf: str) -> DataFrame:
    """Subject and entity texts form one list, half of the vectors in each, that both item components score."""
    rows = _texts(spark, sf)
    lines = F.split("text", "\n")
    one, two = rows.select("query_id", F.get(lines, F.lit(0)).alias("text")), rows.select("query_id", F.array_join(F.slice(lines, 2, 100), "\n").alias("text"))
    return _ranked(_engine(spark, sf).query(one, _addresses(spark, sf), two))


def _profiles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    places = roles.query_location(spark, sf).select("query_id", F.lit(0).alias("pos"), "lat", "lon")
    return roles.query_item(spark, sf).select("query_id", "embedding"), places.unionByName(places.withColumn("pos", F.lit(1)).withColumn("lat", F.lit(0.5)))


@query("op_m5_query_by_profile", _ROLES + ITEMS.format(items="ref_item") + PLACES + FUSE + top_sql(THREE, 5))
def query_by_profile(spark: SparkSession, sf: str) -> DataFrame:
    """All profiles at once; of two places of a profile the first counts."""
    return _ranked(_engine(spark, sf).query_by_user_profile(*_profiles(spark, sf)))


@query(
    "op_m10_sections",
    _ROLES
    + ITEMS.format(items="ref_item")
    + PLACES
    + FUSE
    + ", "
    + ", ".join(f"{name} as ({top_sql(source, 3)})" for name, source in (("s_all", THREE), ("s_subject", "select * from mean"), ("s_locality", "select * from near"), ("s_entity", "select * from mean_entity")))
    + " select 'all' as section, * from s_all union all select 'subject', * from s_subject union all select 'locality', * from s_locality union all select 'entity_subject', * from s_entity",
)
def sections(spark: SparkSession, sf: str) -> DataFrame:
    parts = _engine(spark, sf, 3).sections(*_profiles(spark, sf))
    out = None
    for name, rows in parts.items():
        one = _ranked(rows).withColumn("section", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_FORM = "select event_id as form, case when event_type <> 'error' then event_type else '' end as subject, case when value > 10 then props end as locality, case when event_type = 'error' then 'user ' || user_id else '' end as entity_subject from events"


@query("op_m11_search_form", f"with f as ({_FORM}) select * from (select form, 'subject' as field, subject as value from f union all select form, 'locality', locality from f union all select form, 'entity_subject', entity_subject from f) where value <> ''")
def search_form(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a form's fields; those that are empty or not there are left out."""
    error = F.col("event_type") == "error"
    forms = table(spark, sf, "events").select(
        F.col("event_id").alias("form"),
        F.when(~error, F.col("event_type")).otherwise("").alias("subject"),
        F.when(F.col("value") > 10, F.col("props")).alias("locality"),
        F.when(error, F.concat(F.lit("user "), F.col("user_id").cast("string"))).otherwise("").alias("entity_subject"),
    )
    return search.search_forms(forms)


@query("op_m7_profiles", "select lpad(s_suppkey::varchar, 8, '0') as user_id, 'registry' as origin, [s_name] as items from supplier where s_suppkey % 2 = 0 union all select c_custkey::varchar, 'profile', [c_mktsegment] from customer where c_custkey in (select s_suppkey from supplier where s_suppkey % 2 = 1)")
def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Even suppliers ask by their registry number, odd ones by the id of a stored profile."""
    registry = table(spark, sf, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("user_id"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.array("s_name").alias("items"))
    stored = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.array("c_mktsegment").alias("items"))
    users = table(spark, sf, "supplier").select(F.expr("if(s_suppkey % 2 = 0, lpad(cast(s_suppkey as string), 8, '0'), concat(cast(s_suppkey as string), ' '))").alias("user_id"))
    return jobs.profiles(stored, registry, users).select("user_id", "origin", "items")


@query("op_m9_edited_profiles", "select c_custkey as user_id, case when s_suppkey is null then c_acctbal else 0 end as lat, [coalesce(s_name, c_name)] as items, case when s_suppkey is null then ['seen'] else [] end as cache from customer left join supplier on s_suppkey = c_custkey")
def edited_profiles(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("lat"), F.lit(0.0).alias("lon"), F.array("c_name").alias("items"), F.array(F.lit("seen")).alias("cache"))
    edits = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.array("s_name").alias("items"))
    return jobs.edited(own, edits).select("user_id", "lat", "items", "cache")


@query("op_r8_made_profiles", f"select s_suppkey as user_id, [s_name, 'x'] as items, round(s_suppkey / 10.0, 6)::double as lat, round(list_sum({hashed_sql('s_name')}), 6) as first from supplier")
def made_profiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_suppkey").cast("string").alias("address"), F.array("s_name", F.lit("x")).alias("items"))
    locate = lambda r: r.select("user_id", (F.col("address").cast("double") / 10).alias("lat"), F.lit(0.0).alias("lon"))
    made = jobs.made_profiles(rows, embed, locate)
    return made.select("user_id", "items", F.round("lat", 6).alias("lat"), F.round(F.aggregate(F.get("embeddings", F.lit(0)), F.lit(0.0), lambda s, x: s + x), 6).alias("first"))


# Matching documents with references, and evaluation


_MATCH = """with v as (select item_id, list_transform(range(500), lambda k: case when k in (0, ord(' '), ord('.')) then 0 else len(list_filter(string_split(text, ''), lambda c: ascii(c) % 500 = k)) end) as v, text from benchmark),
d as (select a.item_id, b.item_id as link, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))::bigint as diff, length(a.text) as size, a.text from v a, v b where a.item_id % 2 = 0 and b.item_id % 2 = 1),
best as (select * from (select *, row_number() over (partition by item_id order by diff, link) as k from d) where k = 1)
"""


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, text, link, diff): of each even benchmark text the odd one whose masked character counts differ least."""
    rows = table(spark, sf, "benchmark").select("item_id", "text", T.character_vector(F.col("text")).alias("v"), T.ignore_mask(" .").alias("m"))
    masked = rows.select("item_id", "text", F.zip_with("v", "m", lambda v, m: (v * m).cast("double")).alias("embedding"))
    queries = masked.where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), F.lit(0).alias("query_pos"), "embedding")
    others = masked.where("item_id % 2 = 1").select(F.col("item_id").alias("contract_id"), F.lit(0).alias("pos"), "embedding")
    near = nearest.nearest_items(others, queries, 1, "manhattan").select(F.col("query_id").alias("item_id"), F.col("contract_id").alias("link"), F.col("distance").cast("long").alias("diff"))
    return near.join(rows.select("item_id", "text"), "item_id")


@query("op_c12_document_matches", _MATCH + "select item_id, link, diff from best")
def document_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).select("item_id", "link", "diff")


@query("op_c13_match_filter", _MATCH + "select item_id from best where (size - length(replace(text, chr(10), ''))) / (size + 1) <= 0.25 and diff / size < 0.4")
def match_filter(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.matched_well(_matched(spark, sf), "text", "diff", most=0.4).select("item_id")


@query("op_r3_match_aggregation", _MATCH + "select 'doc' || item_id as doc_name, 'a/b' || item_id % 3 || '/c' as contr_name, link as doc_id, diff from best")
def match_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("root/a/b"), F.expr("item_id % 3"), F.lit("/c/doc"), "item_id")
    return evaluation.aggregated_matches(_matched(spark, sf).withColumn("path", path), "path").select("doc_name", "contr_name", F.col("link").alias("doc_id"), "diff")


@query("op_r4_match_by_name", _MATCH + "select item_id, link, diff from best where contains('doc' || item_id, 'c2')")
def match_by_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = _matched(spark, sf).withColumn("path", F.concat(F.lit("doc"), "item_id"))
    return rows.where(F.contains("path", F.lit("c2"))).select("item_id", "link", "diff")


@query("op_r5_contract_texts", "select doc_id // 4 as contr_name, arg_min(id, (-n, first)) as id, any_value(size) as size from (select doc_id // 4 as g, doc_id % 3 as id, count(*) as n, min(doc_id) as first from documents group by 1, 2) c join (select doc_id, sum(length(text) + length('=======================' || doc_id || '=======================') + 1) over (partition by doc_id // 4)::bigint as size from documents) d on c.g = d.doc_id // 4 group by 1")
def contract_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.expr("doc_id div 4").alias("contr_name"), F.col("doc_id").alias("doc_name"), F.expr("doc_id % 3").alias("contr_id"), "text")
    return evaluation.contract_texts(docs).select("contr_name", "id", F.length("text").cast("long").alias("size"))


_JACCARD = """with a as (select item_id, w, count(*) as n from (select item_id, unnest(list_filter(regexp_split_to_array({a}, '\\s+'), lambda x: x <> '')) as w from benchmark) group by 1, 2),
b as (select item_id, w, count(*) as n from (select item_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as w from benchmark) group by 1, 2),
c as (select item_id, sum(case when a.n is null or b.n is null then 0 else least(a.n, b.n) end) as common from a full join b using (item_id, w) group by 1),
j as (select item_id, common / ((select sum(n) from a where a.item_id = c.item_id) + (select sum(n) from b where b.item_id = c.item_id) - common) as score from c)
""".replace("{a}", "text[1:200]")


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "benchmark").select("item_id", F.substring("text", 1, 200).alias("text"))
    return evaluation.validated(found, table(spark, sf, "benchmark").select("item_id", "text"), "item_id")


@query("op_r6_context_validation", _JACCARD + "select item_id, round(score, 6) as valid_rat, score > 0.5 as valid from j")
def context_validation(spark: SparkSession, sf: str) -> DataFrame:
    return _validated(spark, sf).select("item_id", F.round("score", 6).alias("valid_rat"), (F.col("score") > 0.5).alias("valid"))


@query("op_r7_valid_contexts", _JACCARD + "select item_id::varchar as name, text[1:200] as text from j join benchmark using (item_id) where score > 0.5")
def valid_contexts(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "benchmark").select("item_id", F.substring("text", 1, 200).alias("text"))
    valid = found.join(_validated(spark, sf).where("score > 0.5").select("item_id"), "item_id")
    return files.texts_beside(valid, files.scratch(spark), "item_id", suffix="_subj_context")


@query("op_m19_r11_extraction_score", _JACCARD + "select round(avg(score) * 100, 6) as score from j")
def extraction_score(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.score_100(_validated(spark, sf), "score").select(F.round("score", 6).alias("score"))


@query("op_c19_similarity_matrix", _JACCARD.split("j as")[0].rstrip(",\n") + ", s as (select item_id, sum(n) as size from b group by 1), m as (select x.item_id as a, y.item_id as b, sum(least(x.n, y.n)) as common from b x join b y on x.w = y.w group by 1, 2) select p.item_id as a, q.item_id as b, round(coalesce(common, 0) / (p.size + q.size - coalesce(common, 0)), 6) as similarity from s p cross join s q left join m on m.a = p.item_id and m.b = q.item_id")
def similarity_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.similarity_matrix(table(spark, sf, "benchmark"), "item_id").withColumn("similarity", F.round("similarity", 6))


_STS = f"""with p as (select item_id, item_id % 3 as name, text[1:120] as a, text[61:180] as b, (item_id % 6)::double as gold from benchmark),
w as (select item_id, side, i, avg(v) as x from (select item_id, side, generate_subscripts(e, 1) as i, unnest(e) as v from (select item_id, side, {hashed_sql('w', 8)} as e from (select item_id, 'a' as side, unnest(list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '')) as w from p union all select item_id, 'b', unnest(list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '')) from p))) group by 1, 2, 3),
c as (select item_id, sum(u.x * v.x) / (sqrt(sum(u.x * u.x)) * sqrt(sum(v.x * v.x))) as cos from w u join w v using (item_id, i) where u.side = 'a' and v.side = 'b' group by 1)
"""


@query("op_m21_sts_evaluation", _STS + "select name, round(corr(cos, gold), 6) as pearson, count(*) as n from p join c using (item_id) group by 1")
def sts_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of texts by the cosine of their mean word vectors against a gold score, a correlation for each dataset."""
    rows = table(spark, sf, "benchmark").select("item_id", F.expr("item_id % 3").alias("name"), F.substring("text", 1, 120).alias("a"), F.substring("text", 61, 120).alias("b"), F.expr("cast(item_id % 6 as double)").alias("score"))
    words = rows.select(F.explode(F.split(F.concat_ws(" ", "a", "b"), T.WORDS)).alias("word")).where("word <> ''").distinct()
    known = words.select("word", vectors.hashed_embedding(F.col("word"), 8).alias("embedding"))
    return evaluation.sts(rows, known, "item_id", 8).select("name", F.round("pearson", 6).alias("pearson"), "n")


@query("op_f10_sentence_length_order", "select item_id, row_number() over (order by len(string_split(text[1:80], ' ')), len(string_split(text[81:160], ' ')), item_id % 6, item_id) as place from benchmark")
def sentence_length_order(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs in the order of their sentences' tokens, then of the gold score, as batches take them."""
    size = lambda c: F.size(F.split(c, " "))
    rows = table(spark, sf, "benchmark").select("item_id", size(F.substring("text", 1, 80)).alias("a"), size(F.substring("text", 81, 80)).alias("b"), F.expr("item_id % 6").alias("gold"))
    return relational.numbered(rows, "place", ["a", "b", "gold", "item_id"]).select("item_id", F.col("place").cast("long").alias("place"))


@query("op_f11_by_metric", "select p_type, round(avg(p_retailprice), 4) as score, row_number() over (order by round(avg(p_retailprice), 4) desc, p_type) as place from part group by 1")
def by_metric(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "part").groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 4).alias("score")).withColumn("worse", -F.col("score"))
    return relational.numbered(scored, "place", ["worse", "p_type"]).select("p_type", "score", F.col("place").cast("long").alias("place"))


@query("op_r14_regrouped_results", "select p_brand, " + ", ".join(f"round(avg(p_retailprice) filter (where p_size % 3 = {k}), 8) as s{k}" for k in range(3)) + " from part group by 1")
def regrouped_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results by model and dataset, side by side."""
    rows = table(spark, sf, "part").select("p_brand", F.concat(F.lit("s"), F.expr("p_size % 3")).alias("dataset"), "p_retailprice")
    return rows.groupBy("p_brand").pivot("dataset", ["s0", "s1", "s2"]).agg(F.round(F.avg("p_retailprice"), 8))


_FULL = "1 - list_dot_product(i.embedding, q.embedding) / (sqrt(list_dot_product(i.embedding, i.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding)))"


@query("op_f2_full_order", with_roles("ref_item", "query_item") + f"select query_id, query_pos, contract_id, pos, row_number() over (partition by query_id, query_pos order by round(d, 9), contract_id, pos)::int as rank from (select q.query_id, q.query_pos, i.contract_id, i.pos, {_FULL} as d from ref_item i, query_item q)")
def full_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every item in the order of its distance to each query."""
    return nearest.full_order(roles.ref_item(spark, sf), roles.query_item(spark, sf))


@query("op_h21_all_concordances", "with k as (select * from (values ('license'), ('software')) t(keyword)), a as (select doc_id, text, keyword, unnest(list_transform(range(1, len(parts)), lambda k: (list_sum(list_transform(parts[:k], lambda p: length(p))) + (k - 1) * length(keyword)))) as place from (select doc_id, text, keyword, string_split(lower(translate(text, 'İ', 'i')), keyword) as parts from documents, k)) select doc_id, keyword, place::int as place, text[greatest(place - 20, 0) + 1 : place + length(keyword) + 20] as context from a")
def all_concordances(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence of every keyword with twenty characters on each side."""
    return evaluation.concordances(table(spark, sf, "documents"), ["license", "software"], "doc_id", "text", 20).withColumnRenamed("at", "place")


@query("op_r1_document_loader", with_roles("contract_doc") + "select contract_id, count(*) as n, sum(length(text) + length(chr(10) || '<FILE id=' || doc_id || '>' || chr(10)))::bigint as size, sum(len(list_filter(string_split(text, ''), lambda c: ascii(c) % 500 = 101)))::bigint as e from contract_doc where doc_id in (select doc_id from labels) group by 1")
def document_loader(spark: SparkSession, sf: str) -> DataFrame:
    """Processed documents of a contract: merged behind their headers, with counts of characters."""
    docs = roles.contract_doc(spark, sf).join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    counted = docs.select("contract_id", F.get(T.character_vector(F.col("text")), F.lit(101)).alias("e")).groupBy("contract_id").agg(F.count("*").alias("n"), F.sum("e").cast("long").alias("e"))
    return jobs.merged(docs).select("contract_id", F.length("text").cast("long").alias("size")).join(counted, "contract_id")
