"""The text queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from crestline.llm import chat, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chat_sql() -> str:
    """op1: each control string, and the mark itself, makes three characters of a text."""
    escaped = "x"
    for s in [chat.MARK, *chat.CONTROL, *chat.FOREIGN]:
        escaped = f"replace({escaped}, {_quoted(s)}, '~~~')"
    around = sum(map(len, (chat.CONTROL[chat.TURN], chat.CONTROL[chat.BODY], chat.CONTROL[chat.END])))
    size = lambda c: f"length({escaped.replace('(x,', f'({c},', 1)})"
    extra = "'</s>[INST] ok [/INST]'"
    return f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all select -7, 0, 'user', {extra} union all select -7, 1, 'assistant', {extra})
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast({len(chat.CONTROL[chat.START])} + sum({around} + {size('role')} + {size('text')}) as bigint) as formatted_chars
from turns group by conv_id"""


def dedup_sql(similarity: int = 85) -> str:
    """op3: all pairs that share a shingle; components by reachability."""
    return f"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as w from documents),
shingle as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s from words, lateral (select unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) as i)),
sizes as (select doc_id, count(*) as n from shingle group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingle a join shingle b on a.s = b.s and a.doc_id != b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100*k >= {similarity}*(x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on links.a = reach.b),
low as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from low left join sizes using (doc_id)"""


def quality_sql() -> str:
    """op4: counts, votes, and expectation-maximisation over the patterns of votes, a table for each step."""
    q = quality
    rules = _rules()
    n = len(rules)
    count_of = lambda chars: f"len(list_filter(string_split(t, ''), lambda c: contains({_quoted(chars)}, c)))"
    steps = [f"m0 as materialized (select {q.PRIOR}::double as prior, [{', '.join([f'{q.ON_GOOD}::double'] * n)}] as good, [{', '.join([f'{q.ON_BAD}::double'] * n)}] as bad)"]
    score = "1 / (1 + exp(-(ln(prior / (1 - prior)) + " + " + ".join(f"case v[{j}] when 1 then ln(good[{j}] / (1 - bad[{j}])) when -1 then ln((1 - good[{j}]) / bad[{j}]) else 0 end" for j in range(1, n + 1)) + "))) as p"
    clamp = lambda e, b: f"greatest({b[0]}::double, least({b[1]}::double, {e}))"
    for k in range(1, q.STEPS + 1):
        some = lambda j, v, p: f"coalesce(sum(n*{p}) filter (where v[{j}] = {v}), 0)"
        good = ", ".join(clamp(f"({some(j, 1, 'p')} + {q.ON_GOOD}) / ({some(j, 1, 'p')} + {some(j, -1, 'p')} + 1)", q.GOOD_BOUNDS) for j in range(1, n + 1))
        bad = ", ".join(clamp(f"({some(j, -1, '(1 - p)')} + {q.ON_BAD}) / ({some(j, -1, '(1 - p)')} + {some(j, 1, '(1 - p)')} + 1)", q.BAD_BOUNDS) for j in range(1, n + 1))
        steps.append(f"m{k} as materialized (select {clamp('sum(n*p) / sum(n)', q.SHARE)} as prior, [{good}] as good, [{bad}] as bad from (select v, n, {score} from patterns, m{k - 1}))")
    return f"""
with t0 as (select doc_id, coalesce(text, '') as t from documents),
t1 as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as w, list_filter(string_split(t, chr(10)), lambda x: not regexp_full_match(x, '[\\x20\\x09-\\x0D]*')) as l from t0),
win as (select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') as s from t1, lateral (select unnest(generate_series(1, len(w) - 7)) as i)),
hits as (select doc_id, i, lead(i) over (partition by doc_id order by i) as after from (select *, count(*) over (partition by doc_id, s) as c from win) where c > 1),
again as (select doc_id, sum(least(8, coalesce(after - i, 8))) as n from hits group by doc_id),
c as (select t1.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, {count_of(q.SYMBOLS)} as n_symbols, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
      cast(coalesce(again.n, 0) as bigint) as n_repeat_words, {count_of(q.OTHER)} as n_other, {count_of('.!?')} as n_stops from t1 left join again using (doc_id)),
votes as materialized (select *, [{', '.join(rules)}] as v from c),
patterns as materialized (select v, count(*)::double as n from votes group by v),
{', '.join(steps)},
judged as (select v, {score} from patterns, m{q.STEPS}),
done as (select votes.*, p, n_words < {q.MIN_WORDS} or 100*n_repeat_words > {q.MAX_REPEAT}*n_words as base_failed from votes join judged using (v))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and p >= {q.LEAST} as kept, round(p, 6) as posterior from done"""


def _rules() -> list[str]:
    return [f"case when {bad} then -1 when {good} then 1 else 0 end" for good, bad in quality.RULES]


def decontam_sql() -> str:
    """op9: windows of items against windows of documents."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with item as (select item_id, {words} as w from benchmark),
win as (select distinct item_id, least(len(w), 10) as k, array_to_string(list_slice(w, i, i + 9), ' ') as s from item, lateral (select unnest(generate_series(1, greatest(len(w) - 9, least(len(w), 1)))) as i)),
doc as (select doc_id, {words} as w from documents),
ks as (select distinct k from win),
spot as (select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as s from doc, ks, lateral (select unnest(generate_series(1, len(w) - k + 1)) as i)),
found as (select doc_id, i, k, item_id from spot join win using (k, s)),
hit as (select doc_id, count(distinct i + d) as n from found, lateral (select unnest(generate_series(0, k - 1)) as d) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from found) group by doc_id)
select doc_id, len(w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, hit.n is not null as contaminated
from doc left join hit using (doc_id) left join items using (doc_id)"""
