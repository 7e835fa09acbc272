"""Operator 7: a ledger of quality rules, each evaluated once and kept as a bit beside its measurements.

``ledger`` measures every text and stores one failure bit for each rule; ``apply_policy`` reads a versioned policy
(a set of rules) off the bits; ``ablation`` tells by bitwise aggregation what each rule rejects, alone and in all.
Everything is a DataFrame expression on one row, so nothing is shuffled; only the ablation groups, by bit pattern.

Edge cases: null, empty and blank texts have no words and fail ``few_words``; texts of one or two words have no
three-word window; repeated rows get the same bits each; an empty table gives an empty ledger; only the id and the
text are read, so extra columns cannot clash. Windows are sorted by a hash; neighbours of one hash are compared by their words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, documents, words_of

#: Rules in the order of their bits: name -> failure as an expression over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "shouting": "2 * n_upper > word_chars",
}
#: Versioned policies: the rules whose failure rejects a text.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper")


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(rule) for rule in POLICIES[policy])


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failures): ``failures`` has bit k set where rule k of RULES fails."""
    text, upper = F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    base = documents(df, id_col, text_col, id_col).select(id_col, "text", words_of(text).alias("words"))
    base = base.select(
        id_col,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, upper, ""))).cast("long").alias("n_upper"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]")).alias("lines"),
        # Each window's hash with its place, sorted: equal windows become neighbours.
        F.expr("if(size(words) < 3, array(), sort_array(transform(sequence(1, greatest(size(words) - 2, 1)), i -> struct(xxhash64(element_at(words, i), try_element_at(words, i + 1), try_element_at(words, i + 2)) as h, i))))").alias("windows"),
    )
    # The places that have an equal neighbour, in order, cover three words each.
    twice = "array_sort(array_distinct(flatten(filter(zip_with(windows, slice(windows, 2, greatest(size(windows) - 1, 0)), (a, b) -> if(a.h = b.h and element_at(words, a.i) = element_at(words, b.i) and element_at(words, a.i + 1) = element_at(words, b.i + 1) and element_at(words, a.i + 2) = element_at(words, b.i + 2), array(a.i, b.i), null)), x -> x is not null))))"
    covered = f"aggregate({twice}, named_struct('n', 0L, 'to', 0), (s, i) -> named_struct('n', s.n + i + 2 - greatest(s.to, i - 1), 'to', i + 2), s -> s.n)"
    measured = base.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    )
    bits = " | ".join(f"if({rule}, {1 << k}, 0)" for k, rule in enumerate(RULES.values()))
    return measured.select(id_col, *MEASURES, F.expr(bits).alias("failures"))


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Add ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: texts it rejects, those that only it rejects, and the texts kept without it."""
    rules = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(1 << k).alias("bit")) for k, rule in enumerate(RULES) if rule in POLICIES[policy]))
    patterns = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.expr("if(bits & bit != 0, n, 0)")).alias("rejected"),
        F.sum(F.expr("if(bits = bit, n, 0)")).alias("rejected_alone"),
        F.sum(F.expr("if(bits & ~bit = 0, n, 0)")).alias("kept_without"),
        F.bit_or(F.expr("if(bits & bit != 0, bits, 0)")).alias("fails_beside"),
    )


def verdicts(df: DataFrame, policy: str = "v1") -> DataFrame:
    """Query op7: base measurements, whether a base rule failed, and the policy's verdict."""
    judged = apply_policy(ledger(df), policy)
    base_failed = F.col("failures").bitwiseAND(F.lit(mask("base"))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"), "failures")
