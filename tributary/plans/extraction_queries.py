"""Keyword occurrences, contexts and their ends, contract names, enumerations, and the items they make."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import items as I
from ..functions import text as T
from ..functions import vectors
from ..operators import contexts, jobs, subjects
from . import roles
from .roles import table, with_roles

QUERIES: dict = {}
#: Keywords that occur in the test documents, with weights, in place of the Czech ones.
SAMPLE = {"the": 3.0, "la": 2.0, "der": 1.0}
#: Fixed value of the listing of occurrences, which contexts do without: so many of a keyword count in a text.
MOST = 1002


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def _occurrences_sql(source: str, keys: str, name: str, end: str = "len(parts)") -> str:
    """Tables ``name``_at and ``name``: (keys, keyword, occ, rat) of the rows (keys, text) of ``source``; ``end``: the first part that counts no more."""
    words = ", ".join(f"('{k}', {w})" for k, w in SAMPLE.items())
    folded = "lower(translate(text, 'İ', 'i'))"
    return f"""{name}_at as (select {keys}, text, keyword, weight, length(keyword) as n, unnest(list_transform(range(1, {end}), lambda k: (list_sum(list_transform(parts[:k], lambda p: length(p))) + (k - 1) * length(keyword))::int)) as occ
 from (select {keys}, text, keyword, weight::double as weight, string_split({folded}, keyword) as parts from {source}, (values {words}) w(keyword, weight))),
{name} as (select {keys}, keyword, occ, weight * (1.0::double + if(alone, 2.0, 0.0)::double + if(ahead[:n] = keyword, 1.5, 0.0)::double + if(ahead[:n] = upper(keyword), 1.5, 0.0)::double + if(contains(ahead[:3 * n], chr(10)), 2.0, 0.0)::double
 + if(regexp_matches(behind, '\\n[ ]*[0-9]'), 2.0, 0.0)::double + if(contains(ahead[:2 * n], ' je '), 2.0, 0.0)::double + if(contains(lower(behind), 'článek'), 2.0, 0.0)::double + if(length(behind) - length(replace(behind, 'I', '')) > 1, 2.0, 0.0)::double
 + coalesce(length(regexp_replace(ahead[51:100], '[^{T.LOWER_LETTERS}]', '', 'g')) / nullif(length(ahead[51:100]), 0), 0)) * if(contains(ahead[:150], 'Zboží'), 0.5, 1.0)::double as rat
 from (select *, text[occ + 1 : occ + 160] as ahead, text[greatest(occ - 20, 0) + 1 : occ] as behind, (occ = 0 or text[occ : occ] = chr(10)) and (occ + n >= length(text) or text[occ + n + 1 : occ + n + 1] = chr(10)) as alone from {name}_at))"""


@query("op_i1_keyword_occurrences", f"with {_occurrences_sql('documents', 'doc_id', 'o', f'least(len(parts), {MOST + 1})')} select doc_id, keyword, occ, round(rat, 6) as rat from o")
def keyword_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return contexts.occurrences(table(spark, sf, "documents"), SAMPLE, most=MOST).withColumn("rat", F.round("rat", 6))


_STARTS = f"""with padded as (select doc_id, text || repeat(' ', (length(text) // 680 + 1) * 680 - length(text)) as text from documents),
{_occurrences_sql("padded", "doc_id", "o")},
g as (select doc_id, unnest(range(length(text) // 680 + 1)) as bin from documents),
h as (select g.doc_id, g.bin, coalesce(w, 0)::double as v from g left join (select doc_id, occ // 680 as bin, sum(rat order by keyword, occ) as w from o group by 1, 2) s on s.doc_id = g.doc_id and s.bin = g.bin),
e as (select doc_id, bin, lead(v, 2, 0::double) over p + lead(v, 1, 0::double) over p + 2 * v - 2 * lag(v, 1, 0::double) over p - lag(v, 2, 0::double) over p - lag(v, 3, 0::double) over p as score from h window p as (partition by doc_id order by bin)),
starts as (select doc_id, (bin * 680)::int as start, score from (select *, max(score) over (partition by doc_id) as best from e) where round(score, 9) > round(best * 2 / 3, 9)),
contexts as (select s.doc_id, start, score, least(start + 2040, length(text))::int as "end", text[start + 1 : least(start + 2040, length(text))] as text from starts s join documents d on d.doc_id = s.doc_id)
"""


@query("op_i3_context_starts", _STARTS + "select doc_id, start, round(score, 6) as score from starts")
def context_starts(spark: SparkSession, sf: str) -> DataFrame:
    return contexts.starts(table(spark, sf, "documents"), SAMPLE).withColumn("score", F.round("score", 6))


@query("op_i4_fixed_contexts", _STARTS + 'select doc_id, start, "end", text as context from contexts')
def fixed_contexts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return contexts.fixed_contexts(docs, contexts.starts(docs, SAMPLE))


@query(
    "op_i5_refined_starts",
    _STARTS.rstrip()
    + f""", few as (select * from (select *, row_number() over (partition by doc_id order by round(score, 9) desc, start) as k from contexts) where k <= 10),
{_occurrences_sql("few", "doc_id, start", "r")},
best as (select doc_id, start, arg_min(occ, (-round(rat, 9), occ)) as occ from r group by 1, 2)
select distinct f.doc_id, (f.start + coalesce(b.occ, 0))::int as start from few f left join best b on b.doc_id = f.doc_id and b.start = f.start""",
)
def refined_starts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return contexts.refined_starts(docs, contexts.starts(docs, SAMPLE), SAMPLE)


@query("op_i14_contexts")
def detected_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return contexts.contexts(table(spark, sf, "documents"), SAMPLE)


@F.pandas_udf(IntegerType())
def _reach(text: pd.Series, start: pd.Series) -> pd.Series:
    return pd.Series([contexts.reach_end(t, int(s)) for t, s in zip(text, start, strict=True)], dtype="int32")


@query(
    "op_i6_default_end",
    with_roles("contract_doc")
    + """, m as (select contract_id, string_agg(chr(10) || '<FILE id=' || doc_id || '>' || chr(10) || text, '' order by doc_id) as text from contract_doc group by 1)
select contract_id, (case when place > 0 then 4 + place else least(6125, length(text)) end)::int as "end" from (select *, position('<file' in lower(text[6 : least(6125, length(text))])) as place from m)""",
)
def default_end(spark: SparkSession, sf: str) -> DataFrame:
    """Of a contract's merged documents, from the fifth character on: the next document's header ends a context."""
    merged = jobs.merged(roles.contract_doc(spark, sf))
    return merged.select("contract_id", _reach("text", F.lit(5)).alias("end"))


def _ended(spark: SparkSession, sf: str, rule: str, before: str, body: str, after: str) -> DataFrame:
    """Where a rule ends contexts that start behind ``before``: SQL expressions over ``part``."""
    rules = [r for r in contexts.END_RULES if r.name.split(" ")[0] == rule]

    @F.pandas_udf("int")
    def end(text: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([next(filter(None, (r.find(t, int(s), len(t)) for r in rules)), 0) for t, s in zip(text, start, strict=True)], dtype="int32")

    made = table(spark, sf, "part").select("p_partkey", F.expr(f"concat({before})").alias("before"), F.expr(f"concat({before}, {body}, {after})").alias("text"))
    return made.select("p_partkey", end("text", F.length("before")).alias("end"))


def _end_sql(before: str, body: str, more: str = "0") -> str:
    return f'select p_partkey, (length(concat({before}, {body})) + {more})::int as "end" from part'


_NUMBER, _DESK = ("chr(10), p_partkey % 90 + 1, '. '", "'Předmět ', p_name"), "chr(10), p_partkey % 90 + 2, '. Cena díla', chr(10)"


@query("op_i7_end_by_number", _end_sql(*_NUMBER))
def end_by_number(spark: SparkSession, sf: str) -> DataFrame:
    return _ended(spark, sf, "numbered", *_NUMBER, _DESK)


_ROMAN = ("chr(10), 'II. '", "'Předmět ', p_name")


@query("op_i8_end_by_roman_number", _end_sql(*_ROMAN))
def end_by_roman_number(spark: SparkSession, sf: str) -> DataFrame:
    return _ended(spark, sf, "roman", *_ROMAN, "chr(10), 'III. Cena díla', chr(10)")


_ARTICLE = ("'Článek 1 '", "p_name, chr(10)")


@query("op_i9_end_by_article", _end_sql(*_ARTICLE))
def end_by_article(spark: SparkSession, sf: str) -> DataFrame:
    return _ended(spark, sf, "article", *_ARTICLE, "'článek 2', chr(10)")


_CAPITALS = ("''", "'PŘEDMĚT SMLOUVY ', p_partkey % 100, chr(10), 'malá písmena 123.', chr(10)")


@query("op_i10_end_by_capitals", _end_sql(*_CAPITALS))
def end_by_capitals(spark: SparkSession, sf: str) -> DataFrame:
    return _ended(spark, sf, "capitals", *_CAPITALS, "'CENA DÍLA', chr(10)")


_NAMED = ("'Název: '", "left(p_name, 20), chr(10), 'dlouhý řádek, který má přes třicet znaků'")


@query("op_i11_end_by_name", _end_sql(*_NAMED))
def end_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return _ended(spark, sf, "named", *_NAMED, "chr(10), 'konec', chr(10)")


_QUOTED = ("'Smlouva '", "'„', p_name")


@query("op_i12_end_by_quotation", _end_sql(*_QUOTED, "1"))
def end_by_quotation(spark: SparkSession, sf: str) -> DataFrame:
    return _ended(spark, sf, "quoted", *_QUOTED, "'“ a další'")


_TOPIC = ("'Předmět '", "p_name, chr(10)")


@query("op_i13_end_by_topic", _end_sql(*_TOPIC))
def end_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    return _ended(spark, sf, "topic", *_TOPIC, "'Cena je ', p_size, chr(10), 'Místo', chr(10)")


# Cleaning and extraction


@query("op_j2_wrapped_lines")
def wrapped_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", I.wrapped_lines_joined(F.col("text")).alias("text"))


@query(
    "op_j8_long_lines",
    "select p_partkey, list_concat(['* ' || p_type, repeat('úvod ', 45) || p_name], list_transform(range(p_size % 5), lambda k: ' * bod ' || k || ' ' || p_brand)) as lines from part",
)
def long_lines(spark: SparkSession, sf: str) -> DataFrame:
    points = "array_join(transform(sequence(0, 5), k -> if(k < p_size % 5, concat(' * bod ', k, ' ', p_brand), '')), '')"
    made = table(spark, sf, "part").select("p_partkey", F.expr(f"concat('* ', p_type, '\\n', repeat('úvod ', 45), p_name, {points})").alias("text"))
    return made.select("p_partkey", F.split(I.long_lines_split(F.col("text")), "\n").alias("lines"))


@query("op_j12_default_chain")
def default_chain(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.preprocessed(table(spark, sf, "benchmark").select("item_id", "text"))


_QUOTES = "concat('Smlouva s názvem \"', p_name, '\" a \"', p_brand, ' ', p_type, '\" (dále jen \"', p_name, p_name, '\")')"


@query(
    "op_k4_quoted_names",
    f"""with t as (select p_partkey, string_split({_QUOTES}, '"') as p from part), n as (select p_partkey, p[2 * k] as name, lower(right(array_to_string(p[: 2 * k - 1], '"'), 50)) as before, k from t, range(1, 4) r(k))
select p_partkey, list(name order by k) as names from n where contains(before, 'názvem') or (length(name) >= 25 and not (contains(before, 'přílo') or contains(before, 'dále') or contains(before, 'jen'))) group by 1""",
)
def quoted_names(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "part").select("p_partkey", F.split(F.expr(_QUOTES), "\n").alias("rows"))
    return made.select("p_partkey", I.quoted_names_of(F.col("rows")).alias("names"))


@query(
    "op_k5_structured_names",
    "select p_partkey, list_filter([name, p_brand || ' pod názvem, který má být dost dlouhý'], lambda x: length(x) > 25) as names from (select p_partkey, p_brand, p_name || ' ' || p_type as name from part)",
)
def structured_names(spark: SparkSession, sf: str) -> DataFrame:
    text = "concat('Název projektu:. ', p_name, ' ', p_type, '.\\nstavba:. ', p_size, '\\n\\t', p_brand, ' pod názvem, který má být dost dlouhý. \\nzapsáno:. ', p_name, ' ', p_name)"
    return table(spark, sf, "part").select("p_partkey", F.split(F.expr(text), "\n").alias("rows")).select("p_partkey", I.structured_names_of(F.col("rows")).alias("names"))


def _listed(spark: SparkSession, sf: str, item: str, header: str, between: str) -> DataFrame:
    """(n_regionkey, rows): lines of a header and of the nations of a region."""
    names = F.sort_array(F.collect_list(F.expr(item)))
    made = table(spark, sf, "nation").groupBy("n_regionkey").agg(names.alias("names"))
    return made.select("n_regionkey", F.split(F.concat(F.lit(header), F.array_join("names", between), F.lit(between)), "\n").alias("rows"))


def _listed_sql(item: str) -> str:
    return f"select n_regionkey, list_concat([''], list({item} order by {item})) as items from nation group by 1"


@query("op_k9_k10_items_by_structure", _listed_sql("lower(n_name) || ' zboží'"))
def items_by_structure(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf, "concat(lower(n_name), ' zboží')", "Seznam:.\n\n", "\n\n").select("n_regionkey", I.items_by_structure(F.col("rows")).alias("items"))


@query("op_k11_items_by_first_character", _listed_sql("lower(n_name)"))
def items_by_first_character(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf, "concat('- ', lower(n_name))", "Seznam:.\n", "\n").select("n_regionkey", I.items_by_first_character(F.col("rows")).alias("items"))


@query("op_k12_items_by_two_characters", _listed_sql("lower(n_name)"))
def items_by_two_characters(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf, "concat('§§ ', lower(n_name), '.')", "Seznam:.\n", "\n").select("n_regionkey", I.items_by_two_characters(F.col("rows")).alias("items"))


@query(
    "op_k13_items_under_header",
    "select n_regionkey, coalesce(list(n_name order by n_name) filter (where short = 0), []) as items from (select *, sum((length(n_name) < 5)::int) over (partition by n_regionkey order by n_name) as short from nation) group by 1",
)
def items_under_header(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf, "n_name", "úvod smlouvy\nPředmět smlouvy je:\n", "\n").select("n_regionkey", I.items_under_header(F.col("rows")).alias("items"))


@query("op_m1_subject_items")
def subject_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of every benchmark text as one context."""
    return subjects.subject_items(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("context")), ["item_id"])


@query("op_m15_item_job")
def item_job(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the contracts that have no label yet, from documents to embedded rows."""
    done = table(spark, sf, "labels").select(F.expr("doc_id div 3").alias("contract_id"))
    embed = lambda rows: rows.withColumn("embedding", vectors.hashed_embedding(F.col("item"), 8))
    return jobs.contract_items(roles.contract_doc(spark, sf), done, embed, keywords=SAMPLE)
