"""Operator 5: secrets by fixed patterns, and by a battery of randomness tests under false-discovery control.

Fixed patterns give the base spans. Beside them, every run of 16 or more key-like characters with a letter is a
candidate: its encoding is inferred from its alphabet (ENCODINGS), then tested.

* Uniformity: chi-squared of its character counts against the alphabet's uniform distribution, as the number of equal
  pairs of characters, which is about Poisson; that also holds for tokens shorter than their alphabet.
* Serial correlation of neighbouring code points.
* Runs: changes between lower case, upper case, digits and signs, against those of uniform draws.

Each test gives a p-value of being random (Chernoff's bounds, so none is too small); Bonferroni's rule combines the three,
and what the battery rejects at BATTERY is no secret. The rest is weighed against words and identifiers: how probable the
token is as these (which change class with a probability of at most CLASS_CHANGE a step, and whose pairs of letters are
as frequent as in PAIRS), against uniform draws from its own encoding's alphabet. By Markov's inequality that ratio is a
p-value, also over the choice of encoding.

Benjamini and Hochberg's procedure at level FDR, within strata of length, decides which candidates are reported. The
p-values meet in a histogram of at most 401 bins for each of the four strata, the only thing that crosses documents.

Everything is DataFrame or SQL functions. Edge cases: null and empty texts have no spans; spans are in code points,
end exclusive, of the whole match; repeated rows get the same spans each; an empty table gives an empty result; only
the id and the text are read. Candidates that overlap a base span are not reported again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, settle, sized, unused

#: Kinds in the order that breaks ties. Runs of hexadecimal digits and access keys are matched with their least length
#: at once, which finds the same spans; an assignment that is too short still hides what it covers, so it is dropped later.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
_KEY = "[A-Za-z0-9+/_-]"
CANDIDATE = rf"(?<![A-Za-z0-9+/_\-\x01])(?={_KEY}*?[A-Za-z]){_KEY}{{16,}}+(?!\x01)"
#: Most probable share of class changes between neighbours in identifiers; level of false discoveries; level at which the battery rejects randomness.
CLASS_CHANGE, FDR, BATTERY = 0.25, 0.01, 0.001
#: (alphabet, sizes of its classes): the first that a candidate keeps to is its encoding.
ENCODINGS = (
    ("[0-9a-f]+|[0-9A-F]+", (10, 6)),
    ("[a-z]+|[A-Z]+", (26,)),
    ("[A-Z2-7]+|[a-z2-7]+", (26, 6)),
    ("[a-z0-9]+|[A-Z0-9]+", (26, 10)),
    ("[A-Za-z]+", (26, 26)),
    ("[A-Za-z0-9]+", (26, 26, 10)),
    (".+", (26, 26, 10, 2)),
)
#: Stands for characters of assignments, beside which no candidate is looked for; matches placed at once; characters of a block.
_HIDDEN, _CHUNK, _BLOCK = "\u0001", 256, 1024
#: -5 ln of the share of each letter at the start of a word and after each letter, as code points from 48: means over
#: words of English, French, German and Spanish, mixed with a tenth of the letters' own shares.
PAIRS = (
    "<C>=9EFD>MK?C?=DD@@;BFFTRJ CG<@APHH=MP@D9DJK=;<9JMQMT CPHK6RPJEDX7OG8OSGGHDTVT?T BQFK=RQ59XG>OG<QRFI@>SVTST >GGF4QOD;VWEPC9QSDBAASITOT "
    "=HA??JHG>MP?E8CHI9;?BILGOB =CBJ=GFA>XH?OF7GR;@;BGQSOC 7CIL6RH??XMCM>@LSC?@@LHTUK :CDL5RHB>XIBGC=EGAB>FEITTI @H>F7FHIDLSBB8:IHB?<HGQPVN "
    "2NII9ONHEVOIMD=OPFHEBQSQQQ DPJI1PLIBXWFNEHGRHBGGSISSS ;LGG6KMJ8PU:KG@MNGCDESRT;S >FJK5RPG6XUJHG;@SDGDGSTTQT =D?<;M<D@KIBDD>FFA@8CFKTOJ "
    "CGCDB@IJ?KOFC5FGK<<C;LKQUT 5QKK?8QI<XW@PG:GSAIBDSUTIT GPKJCRPJGXWJPFIQSGIH1SUTUS :BCG5NDC?MGCFB@FK=@?CFJTKH >G:F;PG=?HREDEAHGCB6<NNTLT "
    ";GGK7QK9:XLELF@HM<CBDJMTK? @EFJ6GJCAXMAC8AEL>@>HJI>VM >PKL3RPJ6XXKOG>QSIJHJSUTUT <OKKAQP3:XWHOD:QRCGGJSTTUS 4N@K<MOIAXWCDF>@D?I;JFUPSP "
    "=D?D:PKC=TWCG>8?PC<:HRFSTQ >A?F8QFE=HBCCFCLECFB5GUSSM"
).split()
#: Costs in nats of a digit and of a sign.
_DIGIT, _SIGN = math.log(10), math.log(2)
_SPAN = "array<struct<s: int, k: int, e: int>>"


def _lengths(found: str, between: str, group: str | None = None) -> Column:
    """Lengths of the matches ``found``, of the parts ``between`` before each, and of a group inside."""
    more, last = (f", {group}", f"length(z.{group})") if group else ("", "0")
    zipped = f"transform(arrays_zip({found}, slice({between}, 1, size({found})){more}), z -> named_struct('p', length(z['1']), 'm', length(z.{found}), 'g', {last}))"
    return F.expr(f"if(size({found}) = 0, cast(array() as array<struct<p: int, m: int, g: int>>), {zipped})")


def _chunks(lengths: str) -> Column:
    """Places of matches by chunks, each from 0, so that no long array is built element by element."""
    step = "named_struct('at', a.at + x.p + x.m, 'out', array_append(a.out, named_struct('s', a.at + x.p, 'e', a.at + x.p + x.m, 'g', x.g)))"
    zero = "named_struct('at', 0, 'out', cast(array() as array<struct<s: int, e: int, g: int>>))"
    return F.expr(f"transform(sequence(0, (size({lengths}) - 1) div {_CHUNK}), c -> aggregate(slice({lengths}, c * {_CHUNK} + 1, {_CHUNK}), {zero}, (a, x) -> {step}))")


def _placed(kind: int, chunks: str, starts: str) -> Column:
    """Spans of a kind from its chunks and where these start; assignments of fewer than six characters are dropped."""
    keep = "x.g >= 6" if kind == 0 else "true"
    moved = f"transform(filter(c.out, x -> {keep}), x -> named_struct('s', x.s + {starts}[i], 'k', {kind}, 'e', x.e + {starts}[i]))"
    return F.expr(f"flatten(transform({chunks}, (c, i) -> {moved}))")


def _costs() -> str:
    """SQL for costs in nats, at 29 * before + after: 0 starts a word, then letters, 27 a digit, 28 a sign."""
    rows = [[(ord(c) - 48) / 5 for c in row] for row in PAIRS]
    rows += [rows[0], rows[0]]
    return "array(" + ", ".join(f"{x:.3f}D" for row in rows for x in (0.0, *row, _DIGIT, _SIGN)) + ")"


def _tested() -> str:
    """SQL for a candidate's tests: struct(s, e, n, p) from its text ``t``."""
    size = "case " + " ".join(f"when c.t rlike '^({alphabet})$' then {sum(classes)}" for alphabet, classes in ENCODINGS) + " end"
    change = "case " + " ".join(f"when c.t rlike '^({alphabet})$' then {1 - sum((x / sum(classes)) ** 2 for x in classes):.6f}D" for alphabet, classes in ENCODINGS) + " end"
    pairs = "aggregate(transform(array_distinct(c.chars), x -> length(c.t) - length(replace(c.t, x, ''))), 0L, (a, n) -> a + n * (n - 1) div 2)"
    mean = "(aggregate(c.codes, 0.0D, (a, x) -> a + x) / size(c.codes))"
    ahead = "zip_with(slice(c.codes, 1, size(c.codes) - 1), slice(c.codes, 2, size(c.codes) - 1), (a, b) -> struct(a as a, b as b))"
    changes = "length(regexp_replace(c.t, '(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])', '\\\\n')) - length(c.t)"
    kinds = "transform(split(lower(regexp_replace(c.t, '(?<=[a-z])(?=[A-Z])', ' ')), ''), x -> case when x = ' ' then 0 when x between 'a' and 'z' then ascii(x) - 96 when x between '0' and '9' then 27 else 28 end)"
    letters = f"aggregate({kinds}, named_struct('at', 0, 'sum', 0.0D), (a, x) -> named_struct('at', x, 'sum', a.sum + element_at({_costs()}, 29 * a.at + x + 1)), a -> a.sum)"
    first = f"transform(raw, c -> named_struct('s', c.s, 'e', c.e, 't', c.t, 'n', cast(length(c.t) as double), 'k', cast({size} as double), 'r', {change}, 'chars', split(c.t, ''), 'changes', cast({changes} as double), 'letters', {letters}))"
    carried = "'s', c.s, 'e', c.e, 'n', c.n, 'k', c.k, 'r', c.r, 'changes', c.changes, 'letters', c.letters"
    second = f"transform({first}, c -> named_struct({carried}, 'pairs', cast({pairs} as double), 'codes', transform(c.chars, x -> cast(ascii(x) as double))))"
    third = f"transform({second}, c -> named_struct({carried}, 'pairs', c.pairs, 'few', c.n * (c.n - 1) / (2 * c.k), 'codes', c.codes, 'mean', {mean}))"
    serial = f"(aggregate({ahead}, 0.0D, (a, p) -> a + (p.a - c.mean) * (p.b - c.mean)) / greatest(aggregate(c.codes, 0.0D, (a, x) -> a + (x - c.mean) * (x - c.mean)), 1e-9D))"
    # Logarithms of upper bounds of the p-values of the three tests; 0 where a test says nothing.
    uniform = "if(c.pairs > c.few, c.pairs - c.few - c.pairs * ln(c.pairs / c.few), 0.0D)"
    correlated = f"least(0.0D, ln(2) - {serial} * {serial} * c.n / 2)"
    runs = "if(c.r > 0, least(0.0D, ln(2) - pow(c.changes - (c.n - 1) * c.r, 2) / (2 * (c.n - 1) * c.r * (1 - c.r))), 0.0D)"
    fourth = f"transform({third}, c -> named_struct({carried}, 'q', least(c.changes / (c.n - 1), {CLASS_CHANGE}D), 'battery', ln(3) + least({uniform}, {correlated}, {runs})))"
    # A change leads to one of at least two likely classes.
    words = "-(if(c.changes > 0, c.changes * ln(greatest(c.q, 1e-9D) / 2), 0.0D) + (c.n - 1 - c.changes) * ln(1 - c.q))"
    p = f"if(c.battery < {math.log(BATTERY)}D, 1.0D, exp(-greatest(0.0D, {words} + c.letters - c.n * ln(c.k) - {math.log(len(ENCODINGS))}D)))"
    return f"transform({fourth}, c -> named_struct('s', c.s, 'e', c.e, 'n', cast(c.n as int), 'p', {p}))"


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash of the text, base spans, tested candidates) of every text; time grows in proportion to a text and its matches.

    Candidates are runs that touch no assignment and hold no base span; both are seen from the text around and in them.
    """
    rows = documents(df, id_col, text_col, id_col)
    all_of = lambda text, k, p: F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"m{k}")
    base = (ASSIGN, ACCESS, HEX)
    found = rows.select(id_col, "text", F.xxhash64("text").alias("print"), *(all_of("text", k, p) for k, p in enumerate(base)))

    def parts(text: str, k: int, pattern: str) -> Column:
        return F.when(F.size(f"m{k}") > 0, F.split(text, pattern, -1)).alias(f"p{k}")

    group = F.when(F.size("m0") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("g0")
    cut = found.select(id_col, "print", "text", "m0", "m1", "m2", *(parts("text", k, p) for k, p in enumerate(base)), group)
    hidden = F.expr(f"if(size(m0) = 0, text, array_join(transform(p0, (p, i) -> concat(p, repeat('{_HIDDEN}', coalesce(length(get(m0, i)), 0)))), ''))")
    sized = cut.select(id_col, "print", hidden.alias("text"), *(_lengths(f"m{k}", f"p{k}", "g0" if k == 0 else None).alias(f"l{k}") for k in range(3)))
    more = sized.select(id_col, "print", "text", "l0", "l1", "l2", all_of("text", 3, CANDIDATE))
    more = more.select(id_col, "print", "l0", "l1", "l2", "m3", parts("text", 3, CANDIDATE)).select(id_col, "print", "m3", "l0", "l1", "l2", _lengths("m3", "p3").alias("l3"))
    chunked = more.select(id_col, "print", "m3", *(_chunks(f"l{k}").alias(f"c{k}") for k in range(4)))
    started = chunked.select("*", *(F.expr(f"aggregate(c{k}, array(0), (a, c) -> array_append(a, element_at(a, -1) + c.at))").alias(f"s{k}") for k in range(4)))
    placed = started.select(id_col, "print", "m3", F.array_sort(F.concat(*(_placed(k, f"c{k}", f"s{k}") for k in range(3)))).alias("base"), _placed(3, "c3", "s3").alias("places"))
    fresh = F.expr(f"filter(zip_with(places, m3, (a, t) -> named_struct('s', a.s, 'e', a.e, 't', t)), c -> not (c.t rlike '{HEX}' or c.t rlike '{ACCESS}'))")
    return placed.select(id_col, "print", "base", fresh.alias("raw")).select(id_col, "print", "base", F.expr(_tested()).alias("tested"))


def _stratum(n: str) -> str:
    return f"case when {n} < 24 then 0 when {n} < 32 then 1 when {n} < 64 then 2 else 3 end"


def discoveries(tested: DataFrame) -> dict[int, int]:
    """For each stratum of length the least bin of -10 log10(p) that is reported; reads at most 4 x 401 counts."""
    each = tested.select(F.explode("tested").alias("c")).select(F.expr(_stratum("c.n")).alias("stratum"), F.expr("least(400, cast(floor(-10 * log10(greatest(c.p, 1e-45D))) as int))").alias("bin"))
    cuts: dict[int, int] = {}
    counts: dict[int, dict[int, int]] = {}
    for r in each.groupBy("stratum", "bin").count().collect():
        counts.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    for stratum, bins in counts.items():
        total, above = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if math.pow(10, -b / 10) * total <= FDR * above:
                cuts[stratum] = b
    return cuts


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash of the text, base, spans): arrays of (s: start, k: place in KINDS, e: end), by start, then kind."""
    tested = settle(candidates(df, id_col, text_col))
    cuts = discoveries(tested)
    least = "case " + " ".join(f"when {_stratum('c.n')} = {k} then {b}" for k, b in sorted(cuts.items())) + " else 9999 end" if cuts else "9999"
    more = F.expr(f"transform(filter(tested, c -> least(400, floor(-10 * log10(greatest(c.p, 1e-45D)))) >= {least}), c -> named_struct('s', c.s, 'k', 3, 'e', c.e))")
    return tested.select(id_col, "print", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({', '.join(repr(k) for k in KINDS)}), x.k + 1), x.s, x.e)), ',')")


def report(df: DataFrame) -> DataFrame:
    """Query op5: base counts, the digest of the base spans, and all spans."""
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = {k})) as long)").alias(f"n_{KINDS[k]}")
    return scan(df).select("doc_id", count(0), count(1), count(2), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """Rows of ``df`` with each secret replaced by ``mark``; rows without secrets pass unchanged.

    Rows meet their spans by id and hash of the text, so rows with null or repeated ids are masked too.
    """
    of, hashed, places = (unused(df, name) for name in ("secret_of", "secret_print", "secret_spans"))
    # Spans that overlap become one; those that only touch stay two.
    merged = "aggregate(slice(spans, 2, size(spans)), slice(spans, 1, 1), (m, x) -> if(x.s < element_at(m, -1).e, array_append(slice(m, 1, size(m) - 1), named_struct('s', element_at(m, -1).s, 'k', 0, 'e', greatest(element_at(m, -1).e, x.e))), array_append(m, x)))"
    some = scan(df, id_col, text_col).where(F.size("spans") > 0).select(F.col(id_col).alias(of), F.col("print").alias(hashed), F.expr(merged).alias(places))
    found = settle(some.dropDuplicates([of, hashed]))
    # Pieces are cut out of blocks of the text, so that cutting many takes no longer than the text.
    blocks = f"transform(sequence(0, length(`{text_col}`) div {_BLOCK}), j -> substring(`{text_col}`, j * {_BLOCK} + 1, {_BLOCK}))"
    piece = lambda a, b: f"substring(array_join(slice(b, {a} div {_BLOCK} + 1, {b} div {_BLOCK} - {a} div {_BLOCK} + 1), ''), {a} % {_BLOCK} + 1, {b} - {a})"
    pieces = f"array_join(transform(`{places}`, (x, i) -> concat({piece(f'if(i = 0, 0, `{places}`[i - 1].e)', 'x.s')}, '{mark}')), '')"
    last = f"element_at(`{places}`, -1).e"
    clean = f"transform(array({blocks}), b -> concat({pieces}, {piece(last, f'length(`{text_col}`)')}))[0]"
    same = F.col(id_col).cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(hashed))
    joined = df.join(sized(found, 200_000), same, "left")
    return joined.withColumn(text_col, F.when(F.col(places).isNotNull(), F.expr(clean)).otherwise(F.col(text_col))).select(*df.columns)
