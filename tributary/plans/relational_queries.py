"""Loads, joins, regroupings, counts and orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import contexts as contexts_of
from ..operators import nearest, relational
from ..streaming import profiles
from . import roles, search
from .roles import table, with_roles

QUERIES: dict = {}
#: Entries of lists that are broadcast, some tens of megabytes; contracts of a lot, if all are of one nation.
LISTED, LOT = 4_000_000, 200_000


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


@query("op_a2_generic_sql", "select n_regionkey, count(*) as n from nation where n_nationkey >= 5 group by 1")
def generic_sql(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("select n_regionkey, count(*) as n from {nation} where n_nationkey >= :least group by 1", args={"least": 5}, nation=table(spark, sf, "nation"))


@query("op_a3_conditional_scan", "select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey in (1, 2, 4, 7, 11) and o_orderstatus = 'O'")
def conditional_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return relational.load(rows, {"o_custkey": [1, 2, 4, 7, 11], "o_orderstatus": "O"})


@query("op_a4_items_per_contract", with_roles("ref_item") + "select contract_id, list(pos order by pos) as positions, count(*) as n from ref_item group by 1")
def items_per_contract(spark: SparkSession, sf: str) -> DataFrame:
    grouped = relational.regrouped(roles.ref_item(spark, sf), "contract_id", ["pos"], {"pos": "positions", "embedding": "embeddings"})
    return grouped.select("contract_id", "positions", F.size("embeddings").cast("long").alias("n"))


@query("op_a5_cpv_items_per_contract", with_roles("cpv") + "select l_orderkey as contract_id, list(code order by code, name) as codes, list(name order by code, name) as names from lineitem join cpv on id = l_partkey group by 1")
def cpv_per_contract(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contract_id"), "l_partkey")
    joined = relational.joined_items(links, roles.cpv(spark, sf), "l_partkey")
    return relational.regrouped(joined, "contract_id", ["code", "name"], {"code": "codes", "name": "names"})


@query("op_a6_cpv_enumeration", "select p_brand as code, max(p_partkey) as id, arg_max(p_name, p_partkey) as name from part group by 1")
def cpv_enumeration(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("code"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return relational.enumeration(rows)


@query("op_a7_contract_submitter", with_roles("location") + "select o_orderkey as contract_id, c_custkey as entity_id, c_name, n_name, round(lat, 6) as lat, round(lon, 6) as lon from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join location on location.contract_id = c_custkey")
def contract_submitter(spark: SparkSession, sf: str) -> DataFrame:
    places = roles.location(spark, sf).withColumnRenamed("contract_id", "entity_id")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("contract_id"), F.col("o_custkey").alias("entity_id"))
    joined = orders.join(customers, "entity_id").join(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey").join(places, "entity_id")
    return joined.select("contract_id", "entity_id", "c_name", "n_name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("op_a8_entity_subjects", with_roles("entity_item") + "select contract_id, list(pos order by pos) as items from entity_item group by 1")
def entity_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return relational.regrouped(roles.entity_item(spark, sf), "contract_id", ["pos"], {"pos": "items"})


@query("op_a9_contract_entity_subjects", "select o_orderkey as contract_id, list(s_suppkey order by s_suppkey) as subjects from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join supplier on s_nationkey = n_nationkey group by 1")
def contract_entity_subjects(spark: SparkSession, sf: str) -> DataFrame:
    # Suppliers are regrouped a nation first, so the join does not multiply rows. Orders meet the lists last: a list is long,
    # and there is one for each nation, so none travels with a customer or an order. Orders come in lots of one nation: equal
    # lists follow each other, so a file takes a small part of the bytes that the same rows take in any order.
    suppliers, orders = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey"), table(spark, sf, "orders")
    subjects = relational.regrouped(suppliers, "s_nationkey", ["s_suppkey"], {"s_suppkey": "subjects"})
    subjects = F.broadcast(subjects) if suppliers.count() <= LISTED else subjects
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("s_nationkey"))
    nations = orders.select(F.col("o_orderkey").alias("contract_id"), "o_custkey").join(customers, "o_custkey").select("contract_id", "s_nationkey")
    dealt = F.pmod(F.xxhash64("contract_id"), F.lit(-(-orders.count() // LOT) or 1))
    lots = nations.groupBy("s_nationkey", dealt.alias("lot")).agg(F.sort_array(F.collect_list(F.struct("contract_id"))).alias("contracts"))
    return lots.join(subjects, "s_nationkey").select(F.inline("contracts"), "subjects")


@query("op_a10_entity_subjects_sources", "select n_nationkey, (select list(s_name order by s_suppkey) from supplier where s_nationkey = n_nationkey) as subjects, (select list(c_name order by c_custkey) from customer where c_nationkey = n_nationkey) as sources from nation")
def entity_subjects_sources(spark: SparkSession, sf: str) -> DataFrame:
    subjects = relational.regrouped(table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", ["s_suppkey"], {"s_name": "subjects"})
    sources = relational.regrouped(table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", ["c_custkey"], {"c_name": "sources"})
    return relational.wide(table(spark, sf, "nation").select("n_nationkey"), subjects, sources, key="n_nationkey")


@query("op_a10_literal_fan_out", "select n_nationkey, count(*) as n from nation left join supplier on s_nationkey = n_nationkey left join customer on c_nationkey = n_nationkey group by 1")
def literal_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs the reference's aggregate sees a group: subjects times sources, as counts of each side."""
    one = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("a"))
    two = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("b"))
    both = relational.wide(table(spark, sf, "nation").select("n_nationkey"), one, two, key="n_nationkey")
    return both.select("n_nationkey", (F.coalesce("a", F.lit(1)) * F.coalesce("b", F.lit(1))).alias("n"))


@query("op_a11_sources_per_key", "select s_nationkey, list(s_name order by s_suppkey) as names, list(s_acctbal order by s_suppkey) as urls from supplier group by 1")
def sources_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return relational.regrouped(table(spark, sf, "supplier"), "s_nationkey", ["s_suppkey"], {"s_name": "names", "s_acctbal": "urls"})


@query("op_a13_profiles_with_items", "select c_custkey, list(o_orderkey order by o_orderkey) as items from customer join orders on o_custkey = c_custkey group by 1")
def profiles_with_items(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    joined = table(spark, sf, "customer").select("c_custkey").join(items, "c_custkey")
    return relational.regrouped(joined, "c_custkey", ["o_orderkey"], {"o_orderkey": "items"})


@query("op_a12_interest_items", "select user_id, list(event_type order by event_id) as items from events where value > 90 group by 1")
def interest_items(spark: SparkSession, sf: str) -> DataFrame:
    return relational.regrouped(table(spark, sf, "events").where("value > 90"), "user_id", ["event_id"], {"event_type": "items"})


@query("op_a14_processed_documents", with_roles("contract_doc") + "select contract_id, list(doc_id order by doc_id) as ids, list(length(text) order by doc_id) as sizes from contract_doc where doc_id in (select doc_id from labels) group by 1")
def processed_documents(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "labels").select("doc_id")
    grouped = relational.regrouped(roles.contract_doc(spark, sf).join(done, "doc_id", "left_semi"), "contract_id", ["doc_id"], {"doc_id": "ids", "text": "texts"})
    return grouped.select("contract_id", "ids", F.transform("texts", lambda t: F.length(t).cast("long")).alias("sizes"))


@query("op_a15_contracts", "select o_orderkey as contract_id, o_orderstatus as status, o_totalprice as price from orders")
def contracts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("contract_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


@query("op_a16_unprocessed_batch", with_roles("contract_doc") + "select contract_id, doc_id from contract_doc where contract_id in (select distinct contract_id from contract_doc where contract_id not in (select doc_id // 3 from labels) order by 1 limit 10)")
def unprocessed_batch(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "labels").select(F.expr("doc_id div 3").alias("contract_id"))
    return relational.unprocessed(roles.contract_doc(spark, sf).select("contract_id", "doc_id"), done)


@query("op_a17_entities_to_enrich", "select c_custkey, list(o_orderkey order by o_orderkey) filter (where o_orderkey is not null) as orders from customer left join orders on o_custkey = c_custkey where c_acctbal < 0 group by 1")
def entities_to_enrich(spark: SparkSession, sf: str) -> DataFrame:
    orders = relational.regrouped(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_orderkey"], {"o_orderkey": "orders"})
    return table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey").join(orders, "c_custkey", "left")


@query("op_a29_sources_for_keys", "select n_nationkey, list(s_name order by s_suppkey) as subjects, null::varchar as names from nation join supplier on s_nationkey = n_nationkey where n_nationkey in (1, 3, 5) group by 1")
def sources_for_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = relational.load(table(spark, sf, "nation").select("n_nationkey"), {"n_nationkey": [1, 3, 5]})
    subjects = relational.regrouped(table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", ["s_suppkey"], {"s_name": "subjects"})
    return rows.join(subjects, "n_nationkey").withColumn("names", F.lit(None).cast("string"))


@query("op_b1_array_to_rows", "select o_custkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as pos, o_orderkey as item from orders")
def array_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    grouped = relational.regrouped(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], {"o_orderkey": "items"})
    return grouped.select("o_custkey", F.posexplode("items").alias("pos", "item"))


@query("op_b2_known_codes_only", with_roles("cpv") + "select o_orderkey as contract_id, id as cpv_id from orders join cpv on id = o_orderkey")
def known_codes_only(spark: SparkSession, sf: str) -> DataFrame:
    """Most orders name a code that no part has."""
    found = table(spark, sf, "orders").select(F.col("o_orderkey").alias("contract_id"), F.col("o_orderkey").alias("id")).join(roles.cpv(spark, sf), "id")
    return found.select("contract_id", F.col("id").alias("cpv_id"))


@query("op_b5_generated_keys", "select c_custkey, row_number() over (order by c_mktsegment, c_custkey) as user_id from customer")
def generated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return relational.numbered(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "user_id", ["c_mktsegment", "c_custkey"]).select("c_custkey", F.col("user_id").cast("long").alias("user_id"))


@query("op_b6_update_columns", "select c_custkey, coalesce(s_name, c_name) as c_name, coalesce(s_acctbal, c_acctbal) as c_acctbal from customer left join supplier on c_custkey = s_suppkey")
def update_columns(spark: SparkSession, sf: str) -> DataFrame:
    """There are more customers than suppliers, so most rows have no change."""
    changes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return relational.updated(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), changes, "c_custkey", ["c_name", "c_acctbal"])


@query("op_e9_most_frequent_value", "select l_suppkey, arg_min(l_returnflag, (-n, first)) as l_returnflag from (select l_suppkey, l_returnflag, count(*) as n, min(l_orderkey * 10 + l_linenumber) as first from lineitem group by 1, 2) group by 1")
def most_frequent_value(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("at", F.expr("l_orderkey * 10 + l_linenumber"))
    return relational.most_frequent(rows, "l_suppkey", "l_returnflag", "at")


@query("op_e14_value_counts_threshold", "select l_partkey, count(*) as n from lineitem group by 1 having count(*) > 40")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return relational.frequent(table(spark, sf, "lineitem"), "l_partkey", 40)


@query("op_e15_distinct_counts", "select count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, count(distinct l_shipdate) as days from lineitem")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_shipdate").alias("days"))


@query("op_e16_group_count", "select l_returnflag, count(l_tax) as l_tax, count(l_shipdate) as l_shipdate from lineitem group by 1")
def group_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("l_tax").alias("l_tax"), F.count("l_shipdate").alias("l_shipdate"))


@query("op_e17_concat_per_group", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by 1")
def concat_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("op_e22_null_count", "select count(*) filter (where o_orderkey is null) as n_null, count(*) as n from customer left join orders on o_custkey = c_custkey")
def null_count(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    joined = table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return joined.agg(F.count_if(F.col("o_orderkey").isNull()).alias("n_null"), F.count("*").alias("n"))


@query("op_f3_order_by_rank", "select o_orderkey, o_totalprice, list_position([7, 1, 33, 4, 6], o_orderkey)::int - 1 as position from orders where o_orderkey in (7, 1, 33, 4, 6)")
def order_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    return search.in_given_order(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", [7, 1, 33, 4, 6])


@query("op_f4_best_one", "select l_suppkey, arg_max(l_orderkey, (l_extendedprice, -l_orderkey)) as l_orderkey from lineitem group by 1")
def best_one(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_extendedprice", (-F.col("l_orderkey")).alias("o"))).alias("l_orderkey"))


@query("op_f5_truncated_results", "select s_suppkey, s_acctbal from supplier order by s_acctbal desc, s_suppkey limit 10")
def truncated_results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)


@query("op_f6_random_page", "select 10::bigint as n, 10::bigint as kinds")
def random_page(spark: SparkSession, sf: str) -> DataFrame:
    page = table(spark, sf, "orders").where("o_orderkey is not null").select("o_orderkey").orderBy(F.rand(3)).limit(10)
    return page.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("kinds"))


@query(
    "op_f7_sliding_convolution",
    """select event_id, round(coalesce(lead(value, 2) over w, 0) + coalesce(lead(value, 1) over w, 0) + 2 * value - 2 * coalesce(lag(value, 1) over w, 0)
- coalesce(lag(value, 2) over w, 0) - coalesce(lag(value, 3) over w, 0), 6) as score from events window w as (partition by user_id order by event_id)""",
)
def sliding_convolution(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("event_id", F.round(contexts_of.edge_score("value", w), 6).alias("score"))


@query("op_f8_partition_max_threshold", "select l_orderkey, l_linenumber from (select *, max(l_extendedprice) over (partition by l_orderkey) as top from lineitem) where l_extendedprice > top * 2 / 3")
def partition_max(spark: SparkSession, sf: str) -> DataFrame:
    top = F.max("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", top.alias("top")).where("l_extendedprice > top * 2 / 3").select("l_orderkey", "l_linenumber")


@query("op_f9_look_around", "select event_id, list(event_type) over (partition by user_id order by event_id rows between 3 preceding and 1 preceding) as before, list(event_type) over (partition by user_id order by event_id rows between 1 following and 2 following) as after from events")
def look_around(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    before, after = F.collect_list("event_type").over(w.rowsBetween(-3, -1)), F.collect_list("event_type").over(w.rowsBetween(1, 2))
    none = lambda x: F.when(F.size(x) > 0, x)
    return table(spark, sf, "events").select("event_id", none(before).alias("before"), none(after).alias("after"))


@query("op_f12_batches", "select c_custkey, ((row_number() over (order by c_custkey) - 1) // 100) as batch from customer")
def batches(spark: SparkSession, sf: str) -> DataFrame:
    return relational.batches(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"]).select("c_custkey", F.col("batch").cast("long").alias("batch"))


@query("op_g1_outer_merge_items", "select k as contract_id, list_concat(coalesce(a, []), coalesce(b, [])) as items from (select coalesce(x.o_custkey, y.user_id) as k, a, b from (select o_custkey, list(o_orderkey order by o_orderkey) as a from orders where o_orderstatus = 'F' group by 1) x full join (select user_id, list(event_id order by event_id) as b from events where event_type = 'purchase' group by 1) y on x.o_custkey = y.user_id)")
def outer_merge(spark: SparkSession, sf: str) -> DataFrame:
    own = relational.regrouped(table(spark, sf, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "contract_id"), "contract_id", ["o_orderkey"], {"o_orderkey": "items"})
    more = relational.regrouped(table(spark, sf, "events").where("event_type = 'purchase'").withColumnRenamed("user_id", "contract_id"), "contract_id", ["event_id"], {"event_id": "items"})
    return relational.merged_items(own, more)


@query("op_g2_wide_contract", with_roles("ref_item", "location") + "select o.o_orderkey as contract_id, n_items, round(lat, 6) as lat, n_parts from orders o left join (select contract_id, count(*) as n_items from ref_item group by 1) i on i.contract_id = o_orderkey left join location l on l.contract_id = o_orderkey left join (select l_orderkey, count(*) as n_parts from lineitem group by 1) p on p.l_orderkey = o_orderkey")
def wide_contract(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("contract_id"))
    items = roles.ref_item(spark, sf).groupBy("contract_id").agg(F.count("*").alias("n_items"))
    places = roles.location(spark, sf).select("contract_id", F.round("lat", 6).alias("lat"))
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("contract_id")).agg(F.count("*").alias("n_parts"))
    return relational.wide(base, items, places, parts)


@query("op_g5_semi_join", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    large = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(large, "c_custkey", "left_semi")


@query("op_g5_anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("op_g7_flatten_column", "select o_custkey, unnest(items) as item from (select o_custkey, list(o_orderkey) as items from orders group by 1)")
def flatten_column(spark: SparkSession, sf: str) -> DataFrame:
    grouped = relational.regrouped(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], {"o_orderkey": "items"})
    return grouped.select("o_custkey", F.explode("items").alias("item"))


@query("op_g8_lookup_default_empty", "select c_custkey, coalesce(items, []) as items from customer left join (select o_custkey, list(o_orderkey order by o_orderkey) as items from orders group by 1) on o_custkey = c_custkey")
def lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    lists = relational.regrouped(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], {"o_orderkey": "items"})
    return relational.looked_up(table(spark, sf, "customer").select("c_custkey"), "c_custkey", lists, "o_custkey", "items")


@query("op_g9_zip_shorter", "select s_nationkey, least(count(*), 2) as n from supplier group by 1")
def zip_shorter(spark: SparkSession, sf: str) -> DataFrame:
    grouped = relational.regrouped(table(spark, sf, "supplier"), "s_nationkey", ["s_suppkey"], {"s_name": "a", "s_suppkey": "b"}).withColumn("b", F.slice("b", 1, 2))
    return grouped.select("s_nationkey", F.size(relational.zipped("a", "b")).cast("long").alias("n"))


@query("op_g12_distinct_list", "select l_orderkey, list_sort(list(distinct l_returnflag)) as flags from lineitem group by 1")
def distinct_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags"))


@query("op_g13_distinct", "select distinct l_suppkey, l_returnflag from lineitem")
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("op_g14_filters", "select p_partkey, p_type from part where p_type is not null and regexp_matches(p_name, '^[a-m].*') and p_size between 5 and 20")
def filters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_type").isNotNull() & F.col("p_name").rlike("^[a-m].*") & F.col("p_size").between(5, 20)).select("p_partkey", "p_type")


@query("op_g15_accumulate", "select k, sum(v) as total from (select s_nationkey as k, s_acctbal as v from supplier union all select c_nationkey, c_acctbal from customer) group by 1")
def accumulate(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    two = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    return one.unionByName(two).groupBy("k").agg(F.sum("v").alias("total"))


@query("op_g16_stack", "unpivot (select l_orderkey, l_linenumber, l_tax, l_discount from lineitem) on l_tax, l_discount into name what value amount")
def stack(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"], "what", "amount").where("amount is not null")


@query("op_g17_pivot", "select l_suppkey, count(*) filter (where l_returnflag = 'A') as a, count(*) filter (where l_returnflag = 'N') as n, count(*) filter (where l_returnflag = 'R') as r from lineitem group by 1")
def pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0)
    return wide.select("l_suppkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("op_g19_merged_queries", with_roles("query_item", "entity_item") + "select query_id, count(*) as n from (select query_id from query_item union all select contract_id from entity_item where contract_id < 10) group by 1")
def merged_queries(spark: SparkSession, sf: str) -> DataFrame:
    more = roles.entity_item(spark, sf).where("contract_id < 10").select(F.col("contract_id").alias("query_id"))
    return roles.query_item(spark, sf).select("query_id").unionByName(more).groupBy("query_id").agg(F.count("*").alias("n"))


@query("op_m6_hydrated_results", "select s_nationkey as query_id, s_suppkey as contract_id, rank::int as rank, s_name from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rank from supplier) where rank <= 2")
def hydrated_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("contract_id"), "s_acctbal")
    best = nearest.top_k(rows, F.col("s_acctbal").desc(), 2, ["query_id"], ["contract_id"]).drop("s_acctbal")
    return search.hydrated(best, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("contract_id"), "s_name"))


@query("op_m8_profile_cache", "select user_id, list(event_type order by ts, event_id) as cache from (select distinct on (user_id, event_type) * from events order by user_id, event_type, ts, event_id) group by 1")
def profile_cache(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.cached_items(table(spark, sf, "events"))


@query("op_m13_display_truncation", "select n_regionkey, list_transform(list(n_name order by n_name)[1:5], lambda x: case when length(x) > 6 then left(x, 6) || '...' else x end) as names from nation group by 1")
def display_truncation(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return search.displayed(grouped, "names", 5, 6)


@query("op_m20_validity_flag", "select l_orderkey, l_linenumber, l_discount > 0.05 as valid from lineitem")
def validity_flag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.05, True).otherwise(False).alias("valid"))
