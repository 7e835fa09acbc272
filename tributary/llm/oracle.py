"""The numbered queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

from .quality import POLICIES, RULES, mask

_BLANK = r"[ \x09-\x0D]"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda w: w <> '')"

QUALITY = f"""with t as (select doc_id, coalesce(text, '') as text, {_WORDS} as words from documents),
m as (select doc_id, words, len(words)::bigint as n_words, length(regexp_replace(text, '{_BLANK}', '', 'g'))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
 (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_upper, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\x09-\\x0D]')) as lines from t),
w as (select doc_id, i, words[i : i + 2] as window_ from m, lateral (select unnest(range(1, len(words) - 1)) as i)),
r as (select doc_id, count(distinct i + j) as n from (select doc_id, i, count(*) over (partition by doc_id, window_) as n from w), (values (0), (1), (2)) k(j) where n > 1 group by 1),
l as (select m.doc_id, n_words, word_chars, n_symbols, n_upper, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words from m left join r on r.doc_id = m.doc_id),
f as (select *, ({" | ".join(f"(case when {rule} then {1 << k} else 0 end)" for k, rule in enumerate(RULES.values()))})::int as failures from l)
"""

VERDICTS = QUALITY + f"select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {mask('base')} <> 0 as base_failed, failures & {mask('v1') | mask('base')} = 0 as kept, failures from f"


def _ablation(policy: str) -> str:
    rules = ", ".join(f"('{rule}', {1 << k})" for k, rule in enumerate(RULES) if rule in POLICIES[policy])
    return QUALITY + f"""select rule, sum(case when bits & bit <> 0 then 1 else 0 end)::bigint as rejected, sum(case when bits = bit then 1 else 0 end)::bigint as rejected_alone, sum(case when bits & ~bit = 0 then 1 else 0 end)::bigint as kept_without, bit_or(case when bits & bit <> 0 then bits else 0 end)::int as fails_beside
from (select failures & {mask(policy)} as bits from f), (values {rules}) r(rule, bit) group by 1"""


ABLATION = _ablation("v1")

NEAR_COPIES = """with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda w: w <> '') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [words] else list_transform(range(1, len(words) - 2), lambda i: words[i : i + 3]) end) as shingle from t),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
linked as (select a, b from e union all select b, a from e),
reach as (select doc_id, doc_id as seen from documents union select r.doc_id, b from reach r join linked on a = seen)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, m.component_id = d.doc_id as kept from documents d left join n on n.doc_id = d.doc_id join (select doc_id, min(seen) as component_id from reach group by 1) m on m.doc_id = d.doc_id"""

REPEATS = f"""with t as (select doc_id, {_WORDS} as words from documents),
w as (select doc_id, i, words[i : i + 12] as window_ from t, lateral (select unnest(range(1, len(words) - 11)) as i)),
f as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by window_) as first from w) where first < doc_id),
g as (select distinct doc_id, i + j as k from f, range(13) r(j)),
x as (select t.doc_id, k, words[k] as word from t, lateral (select unnest(range(1, len(words) + 1)) as k)),
kept as (select x.doc_id, count(*) as n, string_agg(word, ' ' order by x.k) as text from x anti join g on g.doc_id = x.doc_id and g.k = x.k group by 1)
select t.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256 from t left join kept on kept.doc_id = t.doc_id"""


def chat(budget: int, history: int) -> str:
    escaped = "replace(replace({0}, '\\', '\\\\'), '<|', '\\o')"
    said = "\\### Assistant: </turn> ok"
    return f"""with recursive c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')),
t as (select *, (row_number() over w - 1)::int as i, length({escaped.format("role")}) - length(replace({escaped.format("role")}, chr(10), '')) + length({escaped.format("role")}) + length({escaped.format("text")}) + 17 as chars,
 len(list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: x <> '')) + 3 as tokens from c window w as (partition by conv_id order by turn, role, text)),
a as (select conv_id, list(tokens order by i) as tokens, list(chars order by i) as chars, count(*)::int as n, case when arg_min(role, i) = 'system' then 1 else 0 end as lead from t group by 1),
s as (select *, list_transform(range(0, n + 1), lambda k: coalesce(list_sum(tokens[:k]), 0)) as sums, list_transform(range(0, n + 1), lambda k: coalesce(list_sum(chars[:k]), 0)) as wide from a),
h as (select conv_id, k, coalesce(list_filter(range(greatest(least(lead, k), k - {history}), k + 1), lambda j: sums[k + 2] - sums[j + 1] + case when k > 0 then sums[lead + 1] else 0 end <= {budget})[1], k) as first from s, lateral (select unnest(range(0, n)) as k)),
walk as (select conv_id, 0::bigint as b, 0::bigint as start from s
 union all select w.conv_id, w.b + 1, case when s.sums[w.b + 3] - s.sums[h.first + 1] + case when w.start > 0 then s.sums[s.lead + 1] else 0 end > {budget} then w.b + 1 else w.start end from walk w join s on s.conv_id = w.conv_id join h on h.conv_id = w.conv_id and h.k = w.start where w.b + 1 < s.n),
spans as (select conv_id, start, max(b) + 1 as stop from walk group by 1, 2),
f as (select x.conv_id, sum(s.wide[x.stop + 1] - s.wide[h.first + 1] + case when x.start > 0 then s.wide[s.lead + 1] else 0 end)::bigint as formatted_chars from spans x join s on s.conv_id = x.conv_id join h on h.conv_id = x.conv_id and h.k = x.start group by 1)
select t.conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256, coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256, any_value(formatted_chars) as formatted_chars from t join f on f.conv_id = t.conv_id group by 1"""


FIM = """with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
n as (select *, len(units)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
 case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from n),
p as (select *, array_to_string(units[1 : a], '') as prefix, array_to_string(units[a + 1 : b], '') as middle, array_to_string(units[b + 1 : n], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from p"""


def _repairs() -> str:
    """A walk over each conversation's turns that keeps, for each grammar state, the least pair of cost and audit."""

    def edit(state: str, cost: str, letter: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"

    def inserted(*states: str) -> tuple[str, ...]:
        start, system, user, assistant = states
        return start, system, f"least({user}, {', '.join(edit(s, '3', 'I') for s in (start, system, assistant))})", f"least({assistant}, {edit(user, '3', 'I')})"

    never = "{'c': 1000000000::bigint, 'a': ''}"
    names = ("start", "system", "user_", "assistant")
    near = inserted(*(f"w.{n}" for n in names))
    # The second insertion in a row starts from a user turn that the first one made.
    before = ", ".join(f"{x} as {n}" for x, n in zip(near[:3], names)) + ", w.assistant as last"
    to_user = "least(b.start, b.system, b.assistant)"

    def turn(state: str, initial: str, source: str, rerole: bool) -> str:
        ways = [edit(f"b.{state}", "4", "D"), f"case when f.initial = '{initial}' and not lost then {edit(source, 'f.more', 'K')} else {never} end"]
        if rerole:
            ways.append(f"case when not lost then {edit(source, '3 + f.more', 'R')} else {never} end")
        return f"least({', '.join(ways)})"

    steps = ", ".join([f"{edit('b.start', '4', 'D')} as start", f"{turn('system', 's', 'b.start', False)} as system", f"{turn('user_', 'u', to_user, True)} as user_", f"{turn('assistant', 'a', 'b.user_', True)} as assistant"])
    return f"""with recursive k(n, c, i) as (select range, range, 0 from range(256) union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from k where i < 8),
crc as (select list(c order by n) as t from k where i = 8),
r as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 as harm from r, crc),
d as (select conv_id, turn, case when harm = 4 then 'user' else role end as role, case harm when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case harm when 0 then []::int[] when 3 then [0, 1] else [0] end) as copy_ from h),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, left(role, 1) as initial from d),
p as (select *, row_number() over (partition by conv_id, role, text order by i) as nth from o),
f as (select *, bare = '' as blank, bare <> '' and nth > 1 as duplicate, bare <> '' and nth = 1 and right(bare, 1) not in ('.', '!', '?') as cut, case when cut then 3 else 0 end as more, bare = '' or nth > 1 as lost,
 lag(initial) over (partition by conv_id order by i) || initial as pair from p),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, sum(blank::int)::bigint as blank, sum(duplicate::int)::bigint as duplicate, sum(cut::int)::bigint as truncated, sum((pair is not null and pair not in ('su', 'ua', 'au'))::int)::bigint as illegal, count(*) as n from f group by 1),
walk as (select conv_id, 0::bigint as i, n, {{'c': 0::bigint, 'a': ''}} as start, {never} as system, {never} as user_, {never} as assistant from g
 union all select b.conv_id, b.i + 1, b.n, {steps} from (select conv_id, i, n, start, system, user_, least(last, {edit('user_', '3', 'I')}) as assistant from (select w.conv_id, w.i, w.n, {before} from walk w where w.i < w.n)) b join f on f.conv_id = b.conv_id and f.i = b.i + 1),
e as (select conv_id, least(start, last, {edit('user_', '3', 'I')}) as best from (select w.conv_id, {before} from walk w where w.i = w.n)),
a as (select conv_id, best.c as cost, best.a as audit, unnest(range(1, length(best.a) + 1)) as p from e),
s as (select a.conv_id, p, audit[p] as e, sum((audit[p] <> 'I')::int) over w as i, sum((audit[p] <> 'D')::int) over w as j from a window w as (partition by conv_id order by p)),
u as (select s.*, f.role, f.text, max((s.j = 1 and s.e = 'K' and f.initial = 's')::int) over (partition by s.conv_id) as lead from s join f on f.conv_id = s.conv_id and f.i = greatest(s.i, 1)),
m as (select conv_id, string_agg(case when e = 'K' then role else case when (j - lead) % 2 = 1 then 'user' else 'assistant' end end || ':' || case when e = 'I' then '' else text end, chr(10) order by p) filter (where e <> 'D') as out from u group by 1)
select c.conv_id, {', '.join(f'coalesce(g.{x}, 0)::bigint as {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, coalesce(e.best.c, 0)::bigint as cost, coalesce(e.best.a, '') as audit, sha256(coalesce(m.out, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join g on g.conv_id = c.conv_id left join e on e.conv_id = c.conv_id left join m on m.conv_id = c.conv_id"""


REPAIRS = _repairs()
