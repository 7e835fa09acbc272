r"""Operator 10: conversations as training windows under a token budget.

A conversation's turns are cut into windows at turn boundaries by prefix sums of their tokens. Every window but the
first repeats the system turn and up to ``history`` earlier turns; the loss mask covers the assistant texts that a
window shows for the first time, so each is a target exactly once.

Template: ``<|turn|>role⏎text<|end|>⏎``, with ``<|seen|>`` instead of ``<|turn|>`` for repeated turns. Inside roles
and texts a backslash becomes ``\\`` and ``<|`` becomes ``\o`` (in roles, a line feed ``\n``), so no text can forge a
mark and ``unescaped`` restores every text.

Edge cases: null roles and texts count as empty; a turn larger than the budget gets a window of its own, whole;
rows with the same turn number go by role and text; repeated rows stay; an empty table gives an empty result; only
the four named columns are read. A conversation's turns meet in one row, as its digest needs them all in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 2


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("\\o"))


def unescaped(text: Column) -> Column:
    """Doubled backslashes are split off first, from the left, so that what is left of a backslash starts a code."""
    return F.array_join(F.transform(F.split(text, r"\\\\"), lambda part: F.replace(part, F.lit("\\o"), F.lit("<|"))), "\\")


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """(conv_id, windows): each window has its text, its mask (start, end in code points) and its numbers of repeated and fresh turns.

    ``tokens`` names a column with the tokens of a turn's text in some vocabulary, such as the size of what ``bpe.encode``
    gives (null: none); without one, words count. Three more stand for the template.
    """
    count = F.coalesce(F.col(tokens).cast("int"), F.lit(0)) if tokens else F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda w: w != ""))
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), count.alias("count"))
    rows = rows.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "text",
            F.concat(F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias("head"),
            escaped(F.col("text")).alias("body"),
            (F.col("count") + 3).alias("tokens"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = turns.select("conv_id", "turns", F.expr("if(turns[0].role = 'system', 1, 0)").alias("lead"))
    # Inclusive prefix sums of tokens, with 0 before the first turn: tokens of turns a..b-1 are sums[b] - sums[a].
    sums = "aggregate(turns, array(0), (s, t) -> array_append(s, element_at(s, -1) + t.tokens))"
    turns = turns.select("conv_id", "turns", "lead", F.expr(sums).alias("sums"))
    # A window from turn a repeats the lead and as much of the history as fits beside turn a; it takes turn b while all fits.
    def first(a: str) -> str:
        fits = f"j -> sums[{a} + 1] - sums[j] + if({a} > 0, sums[lead], 0) <= {budget}"
        return f"coalesce(get(filter(sequence(greatest(least(lead, {a}), {a} - {history}), {a}), {fits}), 0), {a})"

    cost = f"sums[b + 1] - sums[{first('element_at(s, -1)')}] + if(element_at(s, -1) > 0, sums[lead], 0)"
    starts = f"aggregate(sequence(0, size(turns) - 1), array(0), (s, b) -> if(b > element_at(s, -1) and {cost} > {budget}, array_append(s, b), s))"
    turns = turns.select("conv_id", "turns", "lead", "sums", F.expr(starts).alias("starts"))
    piece = "(t, i) -> named_struct('head', concat(if(i < {n}, '<|seen|>', '<|turn|>'), t.head), 'body', t.body, 'target', i >= {n} and t.role = 'assistant')"
    spans = "transform(starts, (a, k) -> named_struct('a', a, 'b', coalesce(try_element_at(starts, k + 2), size(turns)), 'h', {first}, 'lead', if(a = 0, 0, lead)))".format(first=first("a"))
    turns = turns.select("conv_id", "turns", F.expr(spans).alias("spans"))
    seen = "(w.lead + w.a - w.h)"
    pieces = f"transform(spans, w -> named_struct('repeated', {seen}, 'fresh', w.b - w.a, 'pieces', transform(concat(slice(turns, 1, w.lead), slice(turns, w.h + 1, w.b - w.h)), {piece.format(n=seen)})))"
    turns = turns.select("conv_id", "turns", F.expr(pieces).alias("parts"))
    text = "array_join(transform(w.pieces, p -> concat(p.head, p.body, '<|end|>\\n')), '')"
    step = "named_struct('at', s.at + length(p.head) + length(p.body) + 8, 'out', if(p.target, array_append(s.out, named_struct('start', s.at + length(p.head), 'end', s.at + length(p.head) + length(p.body))), s.out))"
    zero = "named_struct('at', 0, 'out', cast(array() as array<struct<start: int, end: int>>))"
    done = f"transform(parts, w -> named_struct('text', {text}, 'mask', aggregate(w.pieces, {zero}, (s, p) -> {step}, s -> s.out), 'repeated', w.repeated, 'fresh', w.fresh))"
    return turns.select("conv_id", F.expr(done).alias("windows"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, targets, formatted_chars), from the formatted windows alone: fresh turns, and the unescaped texts under the mask."""
    fresh = "flatten(transform(windows, w -> transform(filter(split(w.text, '<\\\\|end\\\\|>\\n'), p -> startswith(p, '<|turn|>')), p -> substring(p, 9))))"
    masked = "flatten(transform(windows, w -> transform(w.mask, m -> substring(w.text, m.start + 1, m.end - m.start))))"
    chars = F.expr("aggregate(windows, 0L, (s, w) -> s + length(w.text))")
    raw = formatted.select("conv_id", F.expr(fresh).alias("fresh"), F.expr(masked).alias("masked"), chars.alias("formatted_chars"))

    def parsed(turn: Column) -> Column:
        head = F.substring_index(turn, "\n", 1)
        role = F.array_join(F.transform(F.split(head, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\o"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))), "\\")
        return F.struct(role.alias("role"), unescaped(F.substring(turn, F.length(head) + 2, F.length(turn))).alias("text"))

    return raw.select("conv_id", F.transform("fresh", parsed).alias("turns"), F.transform("masked", unescaped).alias("targets"), "formatted_chars")


def digests(df: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Query op10: what can be read back from every formatted conversation."""
    said = "\\### Assistant: </turn> ok"
    probe = df.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = read_back(windows(df.select("conv_id", "turn", "role", "text").unionByName(probe), budget, history))
    loss = F.array_join("targets", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
