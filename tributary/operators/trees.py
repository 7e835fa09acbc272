"""Dependency trees: sentences from and to CoNLL-U, and the filters that leave what a contract is about.

A sentence is one row, (key.., sentence, tokens): its tokens in order, numbered from 1, each with the number of its head
(0: the root). Filters on words and subtrees are expressions over that array. The two that decide by many rules
(``without_submitter_clauses``, ``subject_parts``) and the searches from all tokens at once (``found_nodes``) work on arrays of
one sentence (``Sentence``), run on Arrow batches; sentences never meet, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

TOKEN = "struct<ord: int, form: string, lemma: string, upos: string, feats: map<string, string>, head: int, deprel: string, space: boolean>"
#: Nodes as columns of CoNLL-U name them; a condition is (attribute, patterns), its patterns match whole values.
Condition = tuple[str, tuple[str, ...]]
#: Any of the alternatives must hold; of an alternative all conditions.
Conditions = tuple[tuple[Condition, ...], ...]


# CoNLL-U


def _spread(docs: DataFrame, key: str) -> DataFrame:
    """The documents dealt out to all cores: a file of a few megabytes holds more trees than one task should take."""
    return docs.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, key)


def sentences(docs: DataFrame, key: str = "doc_id", conllu: str = "conllu") -> DataFrame:
    """(key, sentence, tokens) from CoNLL-U texts; comments, ranges of words and empty nodes are left out."""
    blocks = _spread(docs.select(key, conllu), key).select(key, F.posexplode(F.split(conllu, r"\n[ \t]*\n+")).alias("sentence", "block"))
    rows = F.filter(F.transform(F.split("block", "\n"), lambda x: F.split(x, "\t")), lambda c: (F.size(c) >= 8) & F.get(c, F.lit(0)).rlike("^[0-9]+$"))

    def token(c: Column) -> Column:
        said = lambda k: F.get(c, F.lit(k))
        pairs = F.transform(F.filter(F.split(said(5), r"\|"), lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(F.substring_index(p, "=", 1), F.substring_index(p, "=", -1)))
        return F.struct(said(0).cast("int").alias("ord"), said(1).alias("form"), said(2).alias("lemma"), said(3).alias("upos"), F.map_from_entries(pairs).alias("feats"), said(6).cast("int").alias("head"), said(7).alias("deprel"), (~F.contains(F.coalesce(said(9), F.lit("")), F.lit("SpaceAfter=No"))).alias("space"))

    made = blocks.select(key, "sentence", F.transform(rows, token).cast(f"array<{TOKEN}>").alias("tokens"))
    return made.where(F.size("tokens") > 0)


def to_conllu(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, conllu): the sentences of a document in their order."""

    def line(t: Column) -> Column:
        feats = F.array_join(F.array_sort(F.transform(F.map_entries(t["feats"]), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
        rest = F.when(t["space"], "_").otherwise("SpaceAfter=No")
        return F.concat_ws("\t", t["ord"].cast("string"), t["form"], t["lemma"], t["upos"], F.lit("_"), F.when(feats == "", "_").otherwise(feats), t["head"].cast("string"), t["deprel"], F.lit("_"), rest)

    each = rows.select(key, "sentence", F.array_join(F.transform("tokens", line), "\n").alias("block"))
    return _joined(each, key, "block", "\n\n").withColumnRenamed("text", "conllu")


def sentence_text(tokens: Column) -> Column:
    """The forms, with a space behind each that has one."""
    return F.rtrim(F.array_join(F.transform(tokens, lambda t: F.concat(t["form"], F.when(t["space"], " ").otherwise(""))), ""))


def texts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): a line for each sentence."""
    return _joined(rows.select(key, "sentence", sentence_text(F.col("tokens")).alias("line")), key, "line", "\n")


def _joined(rows: DataFrame, key: str, line: str, between: str) -> DataFrame:
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("sentence", line))).alias("all"))
    return listed.select(key, F.array_join(f"all.{line}", between).alias("text"))


# Filters by words and subtrees


def without_sentences_saying(rows: DataFrame, lemmas: tuple[str, ...]) -> DataFrame:
    return rows.where(~F.exists("tokens", lambda t: t["lemma"].isin(*lemmas)))


def without_empty_sentences(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("tokens") > 0)


def kept(tokens: Column, keep: Column) -> Column:
    """The tokens whose place ``keep`` (an array of booleans) has true, numbered anew; heads that went become the root."""
    marked = F.filter(F.zip_with(tokens, keep, lambda t, k: F.struct(t.alias("t"), k.alias("k"))), lambda x: x["k"])

    def renumber(left: Column) -> Column:
        old = F.transform(left, lambda x: x["t"]["ord"])
        return F.transform(left, lambda x, i: x["t"].withField("ord", (i + 1).cast("int")).withField("head", F.coalesce(F.array_position(old, x["t"]["head"]), F.lit(0)).cast("int")))

    return F.get(F.transform(F.array(marked), renumber), F.lit(0))


def hanging(tokens: Column, hit: Callable[[Column], Column]) -> Column:
    """For each token whether it or one above it is hit.

    Marks climb to the root by pointer jumping: each round looks twice as far up, so rounds grow with the logarithm of the
    sentence's length only.
    """
    start = F.transform(tokens, lambda t: F.struct(F.coalesce(hit(t), F.lit(False)).alias("hit"), t["head"].alias("up")))

    def jump(s: Column, _: Column) -> Column:
        above = lambda x: F.get(s, x["up"] - 1)
        return F.transform(s, lambda x: F.when(x["up"] > 0, F.struct((x["hit"] | above(x)["hit"]).alias("hit"), above(x)["up"].alias("up"))).otherwise(x))

    rounds = F.sequence(F.lit(1), (F.ceil(F.log2(F.size(tokens) + 1)) + 1).cast("int"))
    return F.aggregate(rounds, start, jump, lambda s: F.transform(s, lambda x: x["hit"]))


def without_subtrees(rows: DataFrame, lemmas: tuple[str, ...]) -> DataFrame:
    """Removes tokens with such a lemma and all that hangs on them."""
    said = lambda t: t["lemma"].isin(*lemmas)
    keep = F.transform(hanging(F.col("tokens"), said), lambda hit: ~hit)
    return rows.withColumn("tokens", F.when(F.exists("tokens", said), kept(F.col("tokens"), keep)).otherwise(F.col("tokens")))


# Finding nodes


def satisfies(token: Column, conditions: Conditions) -> Column:
    """Whether a token meets any of the alternatives; an attribute that tokens do not have counts as met."""

    def holds(condition: Condition) -> Column:
        name, patterns = condition
        feature = re.fullmatch(r"feats\[(.+)\]", name)
        if feature:
            value = F.coalesce(F.try_element_at(token["feats"], F.lit(feature[1])), F.lit(""))
        elif name in ("form", "lemma", "upos", "deprel"):
            value = token[name]
        else:
            return F.lit(True)
        return value.rlike("^(" + "|".join(f"(?:{p})" for p in patterns) + ")$")

    found = F.lit(False)
    for alternative in conditions:
        every = F.lit(True)
        for condition in alternative:
            every = every & holds(condition)
        found = found | every
    return found


def nearest_node(tokens: Column, at: Column, conditions: Conditions, way: str, reach: int = 100, itself: bool = False) -> Column:
    """Number of the first token that meets the conditions, from token ``at`` on: ``next``, ``previous``, up to the root
    (``ancestor``) or below it (``descendant``, in order); null if none does within ``reach`` steps."""
    ways = {
        "next": lambda: F.when(F.size(tokens) > at, F.sequence(at + 1, F.least(at + reach, F.size(tokens)))),
        "previous": lambda: F.when(at > 1, F.sequence(at - 1, F.greatest(at - reach, F.lit(1)))),
        "ancestor": lambda: ancestors(tokens, at, reach),
        "descendant": lambda: F.filter(F.transform(tokens, lambda t: t["ord"]), lambda k: (k != at) & F.get(hanging(tokens, lambda t: t["ord"] == at), k - 1)),
    }
    path = F.coalesce(ways[way](), F.array().cast("array<int>"))
    if itself:
        path = F.concat(F.array(at), path)
    return F.get(F.filter(path, lambda k: satisfies(F.get(tokens, k - 1), conditions)), F.lit(0))


def ancestors(tokens: Column, at: Column, reach: int) -> Column:
    """Numbers of the first ``reach`` heads above a token, the nearest first."""
    start = F.struct(F.get(tokens, at - 1)["head"].alias("up"), F.array().cast("array<int>").alias("out"))
    climb = lambda s, _: F.when(s["up"] > 0, F.struct(F.get(tokens, s["up"] - 1)["head"].alias("up"), F.array_append(s["out"], s["up"]).alias("out"))).otherwise(s)
    return F.aggregate(F.slice(tokens, 1, reach), start, climb, lambda s: s["out"])


# Filters by rules


def _once(search: Callable) -> Callable:
    """A search of a sentence, answered from memory from its second time on."""

    @wraps(search)
    def answer(s: Sentence, *args, **kwargs):
        key = (search.__name__, args, *kwargs.items())
        if key not in s.answers:
            s.answers[key] = search(s, *args, **kwargs)
        return s.answers[key]

    return answer


@lru_cache(maxsize=1024)
def _whole(patterns: tuple[str, ...]) -> Callable[[str], re.Match | None]:
    """Matches values that one of the patterns describes whole."""
    return re.compile("|".join(f"(?:{p})" for p in patterns) or "(?!)").fullmatch


class Sentence:
    """A tree's tokens as arrays; places count from 0, and -1 stands for none.

    A walk around the tree numbers every token when it enters and when it leaves, so what hangs on a token is one range of
    numbers. Searches answer for all tokens at once, each in one sweep over the sentence or up or down the walk.
    Tokens whose heads go round in a circle count as roots.

    Several sentences in a row are searched together, ``sizes`` tokens each, as short ones cost little more than the calls
    they take; no search leaves a token's own sentence, whose places are ``first`` to ``end`` - 1.
    """

    def __init__(self, tokens: list[dict], sizes: list[int] | None = None):
        self.tokens, n = tokens, len(tokens)
        self.sizes = [n] if sizes is None else sizes
        each = np.array(self.sizes, dtype=int)
        self.end = np.repeat(np.cumsum(each), each)
        self.first = self.end - np.repeat(each, each)
        self.feats = [dict(t["feats"] or ()) for t in tokens]
        self.places, self.answers = np.arange(n), {}
        self.head, self.depth = np.full(n, -1), np.zeros(n, dtype=int)
        self.enter, self.leave, self.walk = np.full(n, -1), np.full(n, -1), np.zeros(n, dtype=int)
        children: list[list[int]] = [[] for _ in range(n)]
        roots = []
        for k, (t, first, end) in enumerate(zip(tokens, self.first.tolist(), self.end.tolist(), strict=True)):
            (children[first + t["head"] - 1] if 0 < (t["head"] or 0) <= end - first else roots).append(k)
        clock = 0
        for root in (*roots, *range(n)):
            if self.enter[root] >= 0:
                continue
            stack = [(root, -1)]
            while stack:
                k, above = stack.pop()
                if k < 0:
                    self.leave[~k] = clock - 1
                elif self.enter[k] < 0:
                    self.enter[k], self.walk[clock], self.head[k], self.depth[k] = clock, k, above, self.depth[above] + 1 if above >= 0 else 0
                    clock += 1
                    stack.append((~k, -1))
                    stack.extend((c, k) for c in reversed(children[k]))

    @_once
    def mask(self, conditions: Conditions) -> np.ndarray:
        """Which tokens meet any of the alternatives; an attribute that a token does not have counts as met."""
        met = np.zeros(len(self.tokens), dtype=bool)
        for alternative in conditions:
            every = np.ones(len(self.tokens), dtype=bool)
            for name, patterns in alternative:
                values, fits = self.values(name), _whole(patterns)
                every &= np.array([v is None or fits(v) is not None for v in values], dtype=bool)
            met |= every
        return met

    @_once
    def values(self, name: str) -> list[str | None]:
        return [f.get(name[6:-1], "") for f in self.feats] if name.startswith("feats[") else [t.get(name) for t in self.tokens]

    @_once
    def before(self, conditions: Conditions, reach: int, itself: bool = False) -> np.ndarray:
        """For each token the last place before it, at most ``reach`` away, that meets the conditions."""
        last = np.maximum.accumulate(np.where(self.mask(conditions), self.places, -1))
        last = last if itself else np.concatenate(([-1], last[:-1]))[: len(last)]
        return np.where((self.places - last <= reach) & (last >= self.first), last, -1)

    @_once
    def after(self, conditions: Conditions, reach: int) -> np.ndarray:
        n = len(self.places)
        following = np.minimum.accumulate(np.where(self.mask(conditions), self.places, n)[::-1])[::-1]
        following = np.concatenate((following[1:], [n]))[:n]
        return np.where((following < self.end) & (following - self.places <= reach), following, -1)

    @_once
    def up(self, conditions: Conditions, steps: int | None = None) -> np.ndarray:
        """For each token the nearest above it that meets the conditions, at most ``steps`` heads away."""
        met, found = self.mask(conditions), np.full(len(self.places), -1)
        for k in self.walk:
            above = self.head[k]
            if above >= 0:
                found[k] = above if met[above] else found[above]
        return found if steps is None else np.where((found >= 0) & (self.depth - self.depth[found] <= steps), found, -1)

    @_once
    def first_below(self, conditions: Conditions) -> np.ndarray:
        """For each token the first place that hangs on it and meets the conditions."""
        met, n = self.mask(conditions), len(self.places)
        found = np.full(n, n)
        for k in self.walk[::-1]:
            if self.head[k] >= 0:
                found[self.head[k]] = min(found[self.head[k]], k if met[k] else n, found[k])
        return np.where(found < n, found, -1)

    def under(self, k: int, places: np.ndarray | None = None, itself: bool = False) -> np.ndarray:
        """Whether the places (all, if none are given) hang on token ``k``."""
        at = self.enter if places is None else self.enter[places]
        return (at > self.enter[k] - itself) & (at <= self.leave[k])

    def own(self, k: int) -> np.ndarray:
        """The places of the sentence that ``k`` is in."""
        return np.arange(self.first[k], self.end[k])

    def below(self, k: int) -> np.ndarray:
        """All that hangs on ``k``, in the order of the sentence."""
        return np.sort(self.walk[self.enter[k] + 1 : self.leave[k] + 1])


#: Tokens of sentences that are searched together.
_TOGETHER = 4096


def _together(column: pa.Array) -> Iterator[Sentence]:
    """The sentences of a batch in their order, some thousand tokens at a time."""
    tokens, sizes = [], []
    for sentence in column.to_pylist():
        tokens += sentence or []
        sizes.append(len(sentence or []))
        if len(tokens) >= _TOGETHER:
            yield Sentence(tokens, sizes)
            tokens, sizes = [], []
    if sizes:
        yield Sentence(tokens, sizes)


def found_nodes(rows: DataFrame, conditions: Conditions, ways: dict[str, int], prefix: str = "") -> DataFrame:
    """``rows`` with an array for each way (``next``, ``previous``, ``ancestor``, ``descendant``, and its reach): the number of
    the node that ``nearest_node`` finds from each token. Linear in a sentence's length, for all its tokens together."""
    names = [prefix + way for way in ways]
    kind = StructType([*rows.schema.fields, *(StructField(name, ArrayType(IntegerType())) for name in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in ways]
            for s in _together(batch.column(batch.schema.get_field_index("tokens"))):
                for out, (way, reach) in zip(found, ways.items(), strict=True):
                    search = {"next": lambda: s.after(conditions, reach), "previous": lambda: s.before(conditions, reach), "ancestor": lambda: s.up(conditions, reach), "descendant": lambda: s.first_below(conditions)}  # noqa: B023
                    at = search[way]()
                    numbers = [k + 1 if k >= 0 else None for k in np.where(at >= 0, at - s.first, -1).tolist()]
                    out += [numbers[end - size : end] for end, size in zip(np.cumsum(s.sizes).tolist(), s.sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.list_(pa.int32())) for x in found)], names=[*batch.schema.names, *names])

    return rows.mapInArrow(run, kind)


def _is(name: str, *patterns: str) -> Conditions:
    return (((name, patterns),),)


#: Relations, parts of speech, verbs and lemmas that decide which words name a contract's subject.
TARGETS = _is("deprel", "nsubj", "nsubj:pass", "obj", "obl", "obl:arg", "nmod")
TARGET_VERBS: Conditions = (
    (("lemma", ("zavazovat", "doda(t|ný)", "zajistit", "prov(edený|ést)", "zahrnovat", "spočíva(t|jící)", "rozumět")),),
    (("lemma", ("být",)), ("deprel", ("cop", "root", "acl")), ("feats[Polarity]", ("Pos",))),
)
NEVER_WORDS: Conditions = ((("upos", ("PUNCT", "SYM", "NUM", "DET")),), (("feats[Case]", ("Ins",)),))
NEVER_LEMMAS = _is(
    "lemma",
    *"smlouva předmět uzavření náklad nebezpečí specifikace dodavatel závazek dokumentace rozsah plnění zakázka dohoda poplatek požádání záměr dodatek podmínka standard norma kvalita prohlášení jiný osoba souhrn".split(),
)
SUBMITTERS, SUPPLIERS = ("objednatel", "kupující", "zadavate[lt]", "projektant"), ("dodavatel", "prodávající", "zhotovitel", "uchazeč")
PLACE_OR_TIME, DOUBTFUL, CONDITIONAL = _is("lemma", "místo", "doba"), _is("lemma", "zbytný", "pokud", "dodatečný", "dokumentace", "nutný"), _is("lemma", "specifikovaný", "povinný", "oprávněný", "možný", "uvedený")
CLOSING, PERFORMING, REALISING = _is("lemma", "pořízení", "uzavřen(í|ý)", "zabezpečení"), _is("lemma", "proveden(í|ý)"), _is("lemma", "realizace")
CONJUNCTS, VERBS, SAID_VERB = _is("deprel", "conj", "nsubj", "obj"), ((("upos", ("VERB",)),), (("deprel", ("cop",)),)), _is("form", "(je|.{3,})")
SUBJECT, WORK, DETERMINER, FOR = _is("lemma", "předmět"), _is("lemma", "dílo"), _is("upos", "DET"), _is("lemma", "pro")
NEVER_KEPT = _is("lemma", "smlouva", "uzavření", "předmět", "plnění")
#: Lemmas whose subtrees the default chain removes, in two steps.
PRICES, REFERENCES = ("cena", "hodnota", "DPH"), ("příloha", "dále", "jen")


def refused(s: Sentence) -> np.ndarray:
    """Words that name no subject, whatever their verb."""
    submitter, work = s.before(_is("lemma", *SUBMITTERS), 10, itself=True), s.before(WORK, 5, itself=True)
    for_submitter = (submitter != s.places) & (s.before(FOR, 2)[submitter] >= 0)
    this_work = (work != s.places) & ((s.after(DETERMINER, 5)[work] >= 0) | (s.before(SUBJECT, 2)[work] >= 0))
    near = ((submitter >= 0) & ~for_submitter) | ((work >= 0) & ~this_work) | (s.before(PLACE_OR_TIME, 10, itself=True) >= 0) | (s.before(DOUBTFUL, 5) >= 0)
    return ~s.mask(TARGETS) | s.mask(NEVER_WORDS) | s.mask(NEVER_LEMMAS) | near | (s.up(CONDITIONAL, 4) >= 0)


def names_subject(s: Sentence) -> np.ndarray:
    """Words that are the object or subject of a verb of delivery, or hang on a noun of it."""
    done = s.before(PERFORMING, 5)
    performed = (done >= 0) & (s.before((*SUBJECT, *DETERMINER), 3)[done] >= 0)
    aside = s.mask(_is("deprel", "obl", "obl:arg")) & (s.mask(REALISING) | (s.before(SUBJECT, 5) >= 0))
    by_verb = (s.before(TARGET_VERBS, 5) >= 0) & ~aside
    return performed | np.where(s.mask(_is("deprel", "nmod")), s.up(CLOSING) >= 0, by_verb)


def _followed(link: np.ndarray, at: int) -> Iterator[int]:
    while (at := int(link[at])) >= 0:
        yield at


def with_conjuncts(s: Sentence, candidates: np.ndarray) -> list[int]:
    """Candidates and their conjuncts: links lead from each word to the next conjunct near it, and a candidate's chain of
    them starts behind its subtree and ends at the first that hangs on the candidate that follows."""
    link = s.after(CONJUNCTS, 7)
    last = np.array([s.walk[s.enter[k] + 1 : s.leave[k] + 1].max(initial=-1) for k in candidates], dtype=int)
    last = np.where(last < 0, candidates, last)
    # A subtree that ends right before its own head is looked over from the head on.
    at = np.where(last + 1 == candidates, candidates, last)
    out = set(candidates.tolist())
    beside = [b if s.first[a] == s.first[b] else None for a, b in zip(candidates, candidates[1:], strict=False)]
    for start, following in zip(at, [*beside, None], strict=False):
        out |= set(takewhile(lambda p: following is None or not s.under(following, p), _followed(link, start)))  # noqa: B023
    return sorted(out)


def phrase(s: Sentence, k: int) -> np.ndarray:
    """The words that a candidate stands for: its subtree, or the unbroken part of it behind a verb of its own; without what
    hangs on a subject inside, and up to far punctuation."""
    verb = s.first_below(VERBS)[k]
    if verb >= 0 and abs(verb - k) < 10 and s.mask(SAID_VERB)[verb] and s.before(DETERMINER, 2)[verb] < 0:
        inside = s.under(k, np.arange(verb + 1, s.end[k]), itself=True)
        words = verb + 1 + np.arange(np.argmin(np.append(inside, False)))
    else:
        words = np.concatenate(([k], s.below(k)))
    subject = s.up(SUBJECT)[words]
    words = words[~((subject >= 0) & s.under(k, subject))]
    far = (np.abs(words - k) > 10) & s.mask(_is("upos", "PUNCT"))[words]
    return words[: np.argmax(np.append(far, True))]


def subject_places(s: Sentence) -> list[int]:
    """Places of the words that name a contract's subject."""
    if not s.tokens:
        return []
    candidates = s.mask(TARGETS) & names_subject(s)
    # Most sentences have none, or only such as the many rules need not be asked for.
    candidates = np.flatnonzero(candidates & ~refused(s)) if candidates.any() else ()
    if not len(candidates):
        return []
    named = np.zeros(len(s.tokens), dtype=bool)
    for k in with_conjuncts(s, candidates):
        named[phrase(s, k)] = True
    return np.flatnonzero(named & ~s.mask(NEVER_KEPT)).tolist()


def places_without_submitters(s: Sentence) -> list[int]:
    """Places outside clauses whose subject is the submitter: the nearest verb above it goes with all below. If a supplier
    is a subject inside, the last such one's own verb goes instead."""
    gone = np.zeros(len(s.tokens), dtype=bool)

    def subject(*lemmas: str) -> np.ndarray:
        return s.mask(((("lemma", tuple(f"(?i:{x})" for x in lemmas)), ("feats[Case]", ("Nom",))),))

    verb, supplier = s.up(_is("upos", "VERB")), subject(*SUPPLIERS)
    for k in np.flatnonzero(subject("objednatel", "kupující", "zadavatel")):
        if not gone[k]:
            top = verb[k] if verb[k] >= 0 else k
            places = s.own(k)
            own = verb[places[supplier[places] & s.under(top, places)]]
            own = own[own >= 0]
            gone[places] |= s.under(own[-1] if len(own) else top, places, itself=True)
    return np.flatnonzero(~gone).tolist()


def _by_rule(rows: DataFrame, rule: Callable[[Sentence], list[int]], flat: bool) -> DataFrame:
    """``rows`` with only the tokens at the places a rule returns; ``flat``: each becomes a child of the root."""
    out_schema = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("tokens")
            changed: list[list[dict]] = []
            for s in _together(batch.column(at)):
                places, end = iter(rule(s)), 0
                place = next(places, None)
                for size in s.sizes:
                    end, number = end + size, {}
                    while place is not None and place < end:
                        number[place] = len(number) + 1
                        place = next(places, None)
                    changed.append([{**s.tokens[k], "ord": n, "head": 0 if flat else number.get(end - size + (s.tokens[k]["head"] or 0) - 1, 0)} for k, n in number.items()])
            columns = list(batch.columns)
            columns[at] = pa.array(changed, out_schema.field("tokens").type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def without_submitter_clauses(rows: DataFrame) -> DataFrame:
    return _by_rule(rows, places_without_submitters, flat=False)


def subject_parts(rows: DataFrame) -> DataFrame:
    """Sentences reduced to the words that name a contract's subject, all children of the root."""
    return _by_rule(rows, subject_places, flat=True)


def filtered(rows: DataFrame) -> DataFrame:
    """The default chain: subtrees of prices, of references, words beside the subject, empty sentences go."""
    return without_empty_sentences(subject_parts(without_subtrees(without_subtrees(rows, PRICES), REFERENCES)))
