"""Lines, characters, keywords, contexts and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, markup, relational
from . import roles
from .roles import table, with_roles

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def _lines(keep: str) -> str:
    return f"select doc_id, array_to_string(list_concat(list_filter(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '^<[A-Z_]+>')), lambda x: {keep}), list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^<[A-Z_]+>'))), chr(10)) as text from documents"


def _changed(spark: SparkSession, sf: str, change) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", change(F.col("text")).alias("text"))


@query("op_j1_attribute_reorder", _lines("true"))
def attribute_reorder(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf, lambda t: T.by_line(t, lambda rows: rows))


@query("op_j4_lines_by_keyword", _lines("not (length(x) < 75 and (contains(lower(x), 'license') or contains(lower(x), 'the')))"))
def lines_by_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf, lambda t: T.without_lines_saying(t, ["License", "the"]))


@query("op_j5_lines_by_regex", _lines("not (regexp_matches(x, '[0-9]{3}-[0-9]{4}') or regexp_matches(x, '[a-z0-9.]+@[a-z0-9.]+'))"))
def lines_by_regex(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf, lambda t: T.without_lines_matching(t, ["[0-9]{3}-[0-9]{4}", "[a-z0-9.]+@[a-z0-9.]+"]))


@query("op_j6_short_lines", _lines("length(x) = 0 or length(trim(x)) > 5"))
def short_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf, T.without_short_lines)


@query("op_j7_numeral_lines", _lines("length(replace(x, ' ', '')) = 0 or length(regexp_replace(x, '[^0-9]', '', 'g')) < 0.02 * length(replace(x, ' ', ''))"))
def numeral_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf, lambda t: T.without_numeral_lines(t, 0.02))


@query("op_j9_add_line", "select doc_id, text || chr(10) || '==========' as text from documents")
def add_line(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf, T.with_line)


@query("op_j10_replace_marks", "select doc_id, replace(replace(text, ',', ';'), '.', ';') as text from documents")
def replace_marks(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf, lambda t: T.marks_replaced(t, ",.", ";"))


@query("op_j11_regex_replace", r"select doc_id, regexp_replace(text, '([a-z]),([\s]+[a-z])', '\1.\2', 'g') as text from documents")
def regex_replace(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf, lambda t: F.regexp_replace(t, r"([a-z]),([\s]+[a-z])", "$1.$2"))


@query("op_k1_k3_tag_round_trip", "select doc_id, text from documents")
def tag_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf, lambda t: T.tags_cleaned(T.attributes_only(T.tagged(t, "ITEM"))))


@query("op_k7_items_after_colon", "select p_partkey, case when length('x' || p_name) > 5 then [trim(p_name, ' .')] else [] end as items from part")
def items_after_colon(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("druh zboží č. 1: "), F.col("p_name"), F.lit(".\nnic")).alias("text"))
    return rows.select("p_partkey", T.items_after_colon(T.lines(F.col("text"))).alias("items"))


@query("op_k8_cpv_extract", with_roles("cpv") + "select id, [code] as codes from cpv")
def cpv_extract(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("kód 1"), F.lit("23456789-01, "), F.col("code"), F.lit("; tel. 123-4"))
    return roles.cpv(spark, sf).select("id", T.cpv_codes(said).alias("codes"))


@query("op_h19_cpv_levels", with_roles("cpv") + "select id, code[:2] as division, code[:3] as grp, code[:4] as class, code[:5] as category from cpv")
def cpv_levels(spark: SparkSession, sf: str) -> DataFrame:
    return roles.cpv(spark, sf).select("id", T.cpv_levels(F.col("code")).alias("l")).select("id", "l.division", F.col("l.group").alias("grp"), "l.class", "l.category")


@query("op_h20_cpv_format", with_roles("cpv") + "select id from cpv where regexp_full_match(code, '[0-9]{8}-[0-9]') and id % 3 > 0")
def cpv_format(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.when(F.expr("id % 3 = 0"), F.concat(F.col("code"), F.lit("x"))).otherwise(F.col("code"))
    return roles.cpv(spark, sf).select("id", broken.alias("code")).where(T.is_cpv(F.col("code"))).select("id")


@query("op_e14_cpv_threshold", with_roles("cpv") + "select code[:2] as division, count(*) as n from cpv group by 1 having count(*) > 10")
def cpv_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return relational.frequent(roles.cpv(spark, sf).select(F.substring("code", 1, 2).alias("division")), "division", 10)


@query("op_h1_dispatch_over_lists", "select n_regionkey, list_transform(list(n_name order by n_name), lambda x: lower(x)) as names from nation group by 1")
def dispatch_over_lists(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return grouped.select("n_regionkey", F.transform("names", F.lower).alias("names"))


@query("op_h6_split_query_text", "select item_id, string_split(text, chr(10)) as items from benchmark")
def split_query_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.split("text", "\n").alias("items"))


@query("op_h7_find_occurrences", "select doc_id, (length(text) - length(replace(lower(translate(text, 'İ', 'i')), 'license', ''))) // 7 as n, coalesce(nullif(position('license' in lower(translate(text, 'İ', 'i'))), 0) - 1, -1) as first from documents")
def find_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", T.positions(F.col("text"), "License").alias("at"))
    return found.select("doc_id", F.size("at").cast("long").alias("n"), F.coalesce(F.get("at", F.lit(0)), F.lit(-1)).cast("long").alias("first"))


@query("op_h8_current_line", "select doc_id, reverse(string_split(reverse(text[:100]), chr(10))[1]) || string_split(text[101:], chr(10))[1] as line from documents where length(text) > 100")
def current_line(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.length("text") > 100).select("doc_id", T.line_at(F.col("text"), F.lit(100)).alias("line"))


@query("op_h9_merge_documents", with_roles("contract_doc") + "select contract_id, string_agg(chr(10) || '<FILE id=' || doc_id || '>' || chr(10) || text, '' order by doc_id) as text from contract_doc group by 1")
def merge_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = roles.contract_doc(spark, sf).groupBy("contract_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("docs"))
    return docs.select("contract_id", T.merged_documents(F.col("docs")).alias("text"))


@query("op_h10_split_items", with_roles("contract_doc") + "select contract_id, sum(len(list_filter(string_split(text, chr(10)), lambda x: x <> ''))) as n from contract_doc group by 1")
def split_items(spark: SparkSession, sf: str) -> DataFrame:
    docs = roles.contract_doc(spark, sf).groupBy("contract_id").agg(F.collect_list("text").alias("texts"))
    return docs.select("contract_id", F.size(T.split_items(F.col("texts"))).cast("long").alias("n"))


@query("op_h11_split_keep_empty", "select item_id, len(string_split(text || chr(10), chr(10))) as n from benchmark")
def split_keep_empty(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.size(F.split(F.concat("text", F.lit("\n")), "\n")).cast("long").alias("n"))


@query("op_h12_h13_join_attributes", "select n_regionkey, string_agg(n_name, chr(10) order by n_name) || chr(10) || 'x' as text from nation group by 1")
def join_attributes(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return grouped.select("n_regionkey", F.concat(F.array_join("names", "\n"), F.lit("\n"), F.lit("x")).alias("text"))


@query("op_h14_point_from_xml", with_roles("location") + "select contract_id, round(lat, 4) as lat, round(lon, 4) as lon from location")
def point_from_xml(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit('<item x="'), F.format_string("%.4f", "lon"), F.lit('" y="'), F.format_string("%.4f", "lat"), F.lit('"/>'))
    return roles.location(spark, sf).select("contract_id", T.point_of(made).alias("p")).select("contract_id", "p.lat", "p.lon")


@query("op_h15_xml_to_struct", "select s_suppkey, s_name as name, s_acctbal as balance from supplier")
def xml_to_struct(spark: SparkSession, sf: str) -> DataFrame:
    made = F.format_string("<s><name>%s</name><balance>%s</balance></s>", "s_name", F.col("s_acctbal").cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", F.from_xml(made, "name string, balance double").alias("s")).select("s_suppkey", "s.name", "s.balance")


@query("op_h16_namespaces", "select n_nationkey, '<a xmlns:p=\"p\" xmlns:q=\"q\">' || n_name as xml from nation")
def namespaces(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit('<a xmlns:p="http://x/y" xmlns:q="urn:z">'), F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", T.plain_namespaces(made).alias("xml"))


@query("op_h17_address", "select c_custkey, coalesce(o, '') || ',' || c_name || ',' || c_mktsegment as address from (select c_custkey, c_name, c_mktsegment, case when c_custkey % 2 = 0 then c_nationkey::varchar end as o from customer)")
def address(spark: SparkSession, sf: str) -> DataFrame:
    made = T.address_of(F.when(F.expr("c_custkey % 2 = 0"), F.col("c_nationkey").cast("string")), F.col("c_name"), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", made.alias("address"))


@query("op_h21_concordance", "select doc_id, text[place - 20 : place + 26] as context from (select *, position('license' in lower(translate(text, 'İ', 'i'))) as place from documents) where place > 20")
def concordance(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "text", F.get(T.positions(F.col("text"), "license"), F.lit(0)).alias("at")).where("at >= 20")
    return rows.select("doc_id", F.expr("substring(text, at - 19, 47)").alias("context"))


@query("op_h22_dictionary", "select word, count(*) as n from (select unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as word from documents) group by 1 having count(*) >= 50")
def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.dictionary(table(spark, sf, "documents"), "text", 50)


@query("op_h24_md5_key", "select doc_id, md5(text) as key from documents")
def md5_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))


@query("op_e10_character_vector", "select item_id, list_transform(range(500), lambda k: len(list_filter(string_split(text, ''), lambda c: ascii(c) % 500 = k)) + case when k = 0 then length(text) else 0 end) as vector from benchmark")
def character_vector(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.transform(T.character_vector(F.col("text")), lambda x: x.cast("long")).alias("vector"))


@query(
    "op_e11_ignore_mask",
    "select doc_id, bin::int as bin, count(*)::int as n from (select doc_id, ascii(c) % 500 as bin from (select doc_id, unnest(string_split(text, '')) as c from documents where text <> '')) where bin <> 0 and not list_contains([ord(' '), ord(chr(10)), ord('.'), ord('ž')], bin) group by 1, 2",
)
def ignore_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's character counts where the mask lets them through; the bin of the length is ignored with any letter."""
    rows = table(spark, sf, "documents").select("doc_id", T.character_vector(F.col("text")).alias("v"))
    masked = rows.select("doc_id", F.posexplode(F.zip_with("v", T.ignore_mask(" \n.ž"), lambda n, m: n * m)).alias("bin", "n"))
    return masked.where("n > 0")


@query("op_e12_letter_ratio", "select doc_id, round(length(regexp_replace(text, '[^a-z]', '', 'g')) / greatest(length(text), 1), 6) as ratio from documents")
def letter_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(T.letter_ratio(F.col("text"), "abcdefghijklmnopqrstuvwxyz"), 6).alias("ratio"))


@query("op_e13_first_character", "select doc_id, arg_min(c, (-n, first)) as top from (select doc_id, c, count(*) as n, min(i) as first from (select doc_id, l[1:1] as c, i from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)) where c <> '' group by 1, 2) group by 1")
def first_character(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", F.substring("line", 1, 1).alias("top")).where("top <> ''")
    return relational.most_frequent(rows, "doc_id", "top", "i")


@query("op_e13_first_two_characters", "select doc_id, arg_min(c, (-n, first)) as top from (select doc_id, c, count(*) as n, min(i) as first from (select doc_id, l[1:2] as c, i from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)) where length(c) = 2 group by 1, 2) group by 1")
def first_two_characters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", F.substring("line", 1, 2).alias("top")).where("length(top) = 2")
    return relational.most_frequent(rows, "doc_id", "top", "i")


@query(
    "op_e21_keyword_histogram",
    """with o as (select doc_id, unnest(list_filter(range(length(text)::bigint), lambda i: lower(translate(text[i + 1 : i + 7], 'İ', 'i')) = 'license')) as occ from documents),
g as (select doc_id, unnest(range(length(text) // 680 + 1)) as bin from documents)
select g.doc_id, g.bin, coalesce(n, 0) as n from g left join (select doc_id, occ // 680 as bin, count(*) as n from o group by 1, 2) h on h.doc_id = g.doc_id and h.bin = g.bin""",
)
def keyword_histogram(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = docs.select("doc_id", F.explode(T.positions(F.col("text"), "license")).alias("occ"))
    grid = docs.select("doc_id", F.explode(F.expr("sequence(0L, length(text) div 680)")).alias("bin"))
    counted = found.groupBy("doc_id", F.expr("cast(occ div 680 as long)").alias("bin")).agg(F.count("*").alias("n"))
    return grid.join(counted, ["doc_id", "bin"], "left").select("doc_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def _overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark text with the document of the same id; only documents that are asked for are cut into words."""
    pairs = table(spark, sf, "benchmark").select(F.col("item_id").alias("a"), F.col("item_id").alias("b"))
    left = evaluation.tokens(table(spark, sf, "benchmark").withColumnRenamed("item_id", "a"), "a")
    right = evaluation.tokens(table(spark, sf, "documents").withColumnRenamed("doc_id", "b").join(pairs.select("b"), "b", "left_semi"), "b")
    return evaluation.overlap(pairs, left, right)


_TOKENS = """with a as (select item_id as a, w, count(*) as n from (select item_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as w from benchmark) group by 1, 2),
b as (select doc_id as b, w, count(*) as n from (select doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as w from documents) group by 1, 2),
s as (select b as a, sum(n) as size from b group by 1), t as (select a, sum(n) as size from a group by 1), c as (select a.a, sum(least(a.n, b.n)) as common from a join b on a.a = b.b and a.w = b.w group by 1)
select item_id, """


@query("op_c14_jaccard_tokens", _TOKENS + "round(coalesce(common, 0) / (t.size + s.size - coalesce(common, 0)), 6) as jaccard from benchmark join t on t.a = item_id join s on s.a = item_id left join c on c.a = item_id")
def jaccard_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _overlap(spark, sf).select(F.col("a").alias("item_id"), F.round(evaluation.jaccard(F.col("common"), F.col("either")), 6).alias("jaccard"))


@query("op_c15_dice_tokens", _TOKENS + "round(2 * coalesce(common, 0) / (t.size + s.size), 6) as dice from benchmark join t on t.a = item_id join s on s.a = item_id left join c on c.a = item_id")
def dice_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _overlap(spark, sf).select(F.col("a").alias("item_id"), F.round(evaluation.dice(F.col("common"), F.col("total")), 6).alias("dice"))


_CORR = "with r as (select l_returnflag as flag, l_quantity as x, l_extendedprice as y, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2 as rx, rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2 as ry from lineitem), e as (select flag, corr(x, y) as pearson, corr(rx, ry) as spearman, count(*) as n from r group by 1) "


def _correlations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_extendedprice")
    return evaluation.correlations(rows, "flag", "l_quantity", "l_extendedprice")


@query("op_e19_pearson_spearman", _CORR + "select flag, round(pearson, 6) as pearson, round(spearman, 6) as spearman, n from e")
def pearson_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return _correlations(spark, sf).select("flag", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), "n")


@query("op_e20_mean_correlations", _CORR + "select round(avg(pearson), 6) as pearson, round(avg(spearman), 6) as spearman, round(sum(pearson * n) / sum(n), 6) as pearson_weighted, round(sum(spearman * n) / sum(n), 6) as spearman_weighted from e")
def mean_correlations(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.mean_correlations(_correlations(spark, sf))
    return rows.select(*(F.round(c, 6).alias(c) for c in rows.columns))


@query("op_e18_mean_score", "select round(avg(l_discount) * 100, 6) as score from lineitem")
def mean_score(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.score_100(table(spark, sf, "lineitem"), "l_discount").select(F.round("score", 6).alias("score"))


@query("op_h23_word_means", "with w as (select n_name as word, n_nationkey::double as x, n_regionkey::double as y from nation) select c_custkey, [coalesce(x, 0), coalesce(y, 0)] as vector from customer left join nation on n_nationkey = c_nationkey left join w on word = n_name and c_custkey % 2 = 0")
def word_means(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "nation").select(F.col("n_name").alias("word"), F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")).alias("embedding"))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf, "customer").join(names, "c_nationkey", "left").select("c_custkey", F.when(F.expr("c_custkey % 2 = 0"), F.col("n_name")).otherwise(F.lit("?")).alias("text"))
    return evaluation.word_means(rows, vectors, "c_custkey", "text", 2)


@query("op_r16_longest_first", "select doc_id, row_number() over (order by length(text) desc, doc_id) as place from documents")
def longest_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", (-F.length("text")).alias("size"))
    return relational.numbered(rows, "place", ["size", "doc_id"]).select("doc_id", F.col("place").cast("long").alias("place"))


@query("op_a26_links_of_pages", "select page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as links, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def links_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))




#: Character references in SQL, decoded as the selection of elements does.
_DECODED = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
_NAVS, _LINKS = "regexp_extract_all(html, '(?s)<nav>.*?</nav>')", """regexp_extract_all(nav, '<a href="[^"]*">[^<]*</a>')"""
_HREF, _TEXT = _DECODED.format("""regexp_extract(a, 'href="([^"]*)"', 1)"""), _DECODED.format("regexp_extract(a, '>([^<]*)<', 1)")
_ADS = """regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1)"""


@query("op_a26_links_of_lists", f"with n as (select page_id, unnest({_NAVS}) as nav, generate_subscripts({_NAVS}, 1) as element from pages), a as (select page_id, element, unnest({_LINKS}) as a, generate_subscripts({_LINKS}, 1) as link from n) select page_id, element, link, {_HREF} as href, {_TEXT} as text from a")
def links_of_lists(spark: SparkSession, sf: str) -> DataFrame:
    return markup.links(table(spark, sf, "pages"), "nav")


@query("op_a26_texts_by_class", f"with d as (select page_id, unnest({_ADS}) as said, generate_subscripts({_ADS}, 1) as element from pages) select page_id, element, {_DECODED.format('said')} as text from d")
def texts_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return markup.texts(table(spark, sf, "pages"), "div", "ad")
