"""Dependency trees over the benchmark's words, which hang on each other like a heap: word k on word k div 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from ..sources import files
from .roles import table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def conllu(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, conllu): a sentence for each line of a text; parts of speech by length of the word."""
    line = "concat_ws('\\t', i + 1, w, lower(w), if(length(w) % 3 = 0, 'VERB', 'NOUN'), '_', if(length(w) % 2 = 0, 'Case=Nom|Number=Sing', '_'), (i + 1) div 2, if(i = 0, 'root', 'dep'), '_', if(length(w) % 5 = 0, 'SpaceAfter=No', '_'))"
    words = "filter(split(s, '[ \\\\t\\\\r]+'), w -> w <> '')"
    blocks = f"transform(filter(transform(split(text, '\\n'), s -> {words}), x -> size(x) > 0), x -> concat('# sent\\n', array_join(transform(x, (w, i) -> {line}), '\\n')))"
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.expr(f"concat(array_join({blocks}, '\\n\\n'), '\\n\\n')").alias("conllu"))


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return trees.sentences(conllu(spark, sf))


#: Tokens with their sentence, place, head and lemma.
_TOKENS = """with recursive s as (select item_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: list_filter(regexp_split_to_array(l, '[ \\t\\r]+'), lambda w: w <> '')), lambda x: len(x) > 0) as blocks from benchmark),
b as (select item_id as doc_id, unnest(blocks) as words, generate_subscripts(blocks, 1) - 1 as sentence from s),
t as (select doc_id, sentence, unnest(words) as form, generate_subscripts(words, 1) as ord, len(words) as n from b)
"""
_DOWN = "up as (select doc_id, sentence, ord, ord as node from t union all select doc_id, sentence, ord, node // 2 from up where node > 1)"


@query("op_l2_conllu_tokens", _TOKENS + "select doc_id, sentence::int as sentence, ord::int as ord, form, lower(form) as lemma, (ord // 2)::int as head, case when length(form) % 2 = 0 then 'Nom' else '' end as case_ from t")
def conllu_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sentences(spark, sf).select("doc_id", "sentence", F.explode("tokens").alias("t"))
    return rows.select("doc_id", "sentence", "t.ord", "t.form", "t.lemma", "t.head", F.coalesce(F.try_element_at("t.feats", F.lit("Case")), F.lit("")).alias("case_"))


@query("op_l3_tree_texts", _TOKENS + "select doc_id, string_agg(line, chr(10) order by sentence) as text from (select doc_id, sentence, rtrim(string_agg(form || case when length(form) % 5 = 0 then '' else ' ' end, '' order by ord), ' ') as line from t group by 1, 2) group by 1")
def tree_texts(spark: SparkSession, sf: str) -> DataFrame:
    return trees.texts(_sentences(spark, sf))


@query("op_l4_sentences_without_lemma", _TOKENS + "select doc_id, sentence::int as sentence from t group by 1, 2 having not bool_or(lower(form) in ('the', 'of'))")
def sentences_without_lemma(spark: SparkSession, sf: str) -> DataFrame:
    return trees.without_sentences_saying(_sentences(spark, sf), ("the", "of")).select("doc_id", "sentence")


_SUBTREES = _TOKENS.rstrip() + f""", {_DOWN},
gone as (select distinct u.doc_id, u.sentence, u.ord from up u join t on t.doc_id = u.doc_id and t.sentence = u.sentence and t.ord = u.node where lower(t.form) in ('the', 'of', 'and'))
"""


@query("op_l5_without_subtrees", _SUBTREES + "select doc_id, sentence::int as sentence, coalesce(list(form order by ord) filter (where g is null), []) as forms from (select t.*, gone.ord as g from t left join gone using (doc_id, sentence, ord)) group by 1, 2")
def without_subtrees(spark: SparkSession, sf: str) -> DataFrame:
    left = trees.without_subtrees(_sentences(spark, sf), ("the", "of", "and"))
    return left.select("doc_id", "sentence", F.transform("tokens", lambda t: t["form"]).alias("forms"))


_CONDITIONS = ((("lemma", ("[a-m].*",)), ("feats[Case]", ("Nom",)), ("unheard", ("x",))), (("upos", ("VERB",)),))
_MET = "(regexp_full_match(lower(form), '[a-m].*') and length(form) % 2 = 0 or length(form) % 3 = 0)"


@query("op_l6_found_nodes", _TOKENS + f"select doc_id, sentence::int as sentence, list(ord::int order by ord) as found from t where {_MET} group by 1, 2")
def found_nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sentences(spark, sf)
    found = F.transform(F.filter("tokens", lambda t: trees.satisfies(t, _CONDITIONS)), lambda t: t["ord"])
    return rows.select("doc_id", "sentence", found.alias("found")).where("size(found) > 0")


@query(
    "op_l7_nearest_nodes",
    _TOKENS.rstrip()
    + f""", {_DOWN}, m as (select *, {_MET} as met from t),
k as (select a.doc_id, a.sentence, a.ord, min(b.ord) filter (where b.ord between a.ord + 1 and a.ord + 3) as next, max(b.ord) filter (where b.ord between a.ord - 3 and a.ord - 1) as previous from m a left join m b on a.doc_id = b.doc_id and a.sentence = b.sentence and b.met group by 1, 2, 3),
v as (select u.doc_id, u.sentence, u.ord, max(u.node) as ancestor from up u join m on m.doc_id = u.doc_id and m.sentence = u.sentence and m.ord = u.node where m.met and u.node < u.ord group by 1, 2, 3),
d as (select u.doc_id, u.sentence, u.node as ord, min(u.ord) as descendant from up u join m on m.doc_id = u.doc_id and m.sentence = u.sentence and m.ord = u.ord where m.met and u.node < u.ord group by 1, 2, 3)
select doc_id, sentence::int as sentence, ord::int as ord, next::int as next, previous::int as previous, ancestor::int as ancestor, descendant::int as descendant from k left join v using (doc_id, sentence, ord) left join d using (doc_id, sentence, ord)""",
)
def nearest_nodes(spark: SparkSession, sf: str) -> DataFrame:
    ways = {"next": 3, "previous": 3, "ancestor": 100, "descendant": 100}
    found = trees.found_nodes(_sentences(spark, sf).select("doc_id", "sentence", "tokens"), _CONDITIONS, ways)
    each = found.select("doc_id", "sentence", F.posexplode(F.arrays_zip(*ways)).alias("at", "node"))
    return each.select("doc_id", "sentence", (F.col("at") + 1).alias("ord"), *(F.col("node")[way].alias(way) for way in ways))


def _made(spark: SparkSession, sf: str) -> DataFrame:
    """A sentence for each part: a supplier, or for parts of odd size the submitter, delivers a machine for a price."""
    who = "if(p_size % 2 = 0, 'Dodavatel\\tdodavatel', 'Objednatel\\tobjednatel')"
    words = f"concat('1\\t', {who}, '\\tNOUN\\t_\\tCase=Nom\\t2\\tnsubj\\t_\\t_\\n2\\tdodá\\tdodat\\tVERB\\t_\\t_\\t0\\troot\\t_\\t_\\n3\\tstroj', p_partkey, '\\tstroj\\tNOUN\\t_\\tCase=Acc\\t2\\tobj\\t_\\t_\\n4\\tza\\tza\\tADP\\t_\\t_\\t5\\tcase\\t_\\t_\\n5\\tcenu\\tcena\\tNOUN\\t_\\tCase=Acc\\t2\\tobl\\t_\\t_\\n')"
    return trees.sentences(table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(words).alias("conllu")))


@query("op_l8_without_submitters", "select p_partkey as doc_id, case when p_size % 2 = 0 then 'Dodavatel dodá stroj' || p_partkey || ' za cenu' else '' end as text from part")
def without_submitters(spark: SparkSession, sf: str) -> DataFrame:
    return trees.texts(trees.without_submitter_clauses(_made(spark, sf)))


@query("op_l9_subject_parts", "select p_partkey as doc_id, case when p_size % 2 = 0 then 'stroj' || p_partkey || ' za cenu' else '' end as text from part")
def subject_parts(spark: SparkSession, sf: str) -> DataFrame:
    return trees.subject_parts(_made(spark, sf)).select("doc_id", trees.sentence_text(F.col("tokens")).alias("text"))


@query("op_l10_without_empty_sentences", _SUBTREES + "select doc_id, sentence::int as sentence, count(*) as n from t anti join gone using (doc_id, sentence, ord) group by 1, 2")
def without_empty_sentences(spark: SparkSession, sf: str) -> DataFrame:
    left = trees.without_empty_sentences(trees.without_subtrees(_sentences(spark, sf), ("the", "of", "and")))
    return left.select("doc_id", "sentence", F.size("tokens").cast("long").alias("n"))


@query("op_l11_default_filters", "select p_partkey as doc_id, 'stroj' || p_partkey as text from part where p_size % 2 = 0")
def default_filters(spark: SparkSession, sf: str) -> DataFrame:
    return trees.texts(trees.filtered(_made(spark, sf)))


@query("op_r17_conllu_files", _TOKENS + "select doc_id, count(*) as n, sum(ord * length(form))::bigint as weight from t group by 1")
def conllu_files(spark: SparkSession, sf: str) -> DataFrame:
    """Trees written as CoNLL-U files and read again."""
    written = files.conllu_files(trees.to_conllu(_sentences(spark, sf)), files.scratch(spark))
    again = trees.sentences(written).select("doc_id", F.explode("tokens").alias("t"))
    return again.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.expr("t.ord * length(t.form)")).cast("long").alias("weight"))
