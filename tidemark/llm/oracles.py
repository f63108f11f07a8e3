"""DuckDB SQL of the contract queries that SQL can express over whole tables.

The networks, the language models, the set-similarity labels, the tokenizer, XXH64 and approximate search have no SQL
form; tests hold those against brute force, the library, or held-out labels.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (select *, case when regexp_matches(text, '<\|im_(start|end)\|>|<\\+\|') or regexp_matches(role, '<\|im_(start|end)\|>|<\|nl\|>|<\\+\||\n')
  then length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))
  else length(role) + length(text) end + 12 + 1 + 10 + 1 as chars from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from e group by conv_id
"""

OP5 = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, w, least(len(w), 8) as n from (select item_id, {_WORDS} as w from benchmark where item_id is not null) x where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as win from (select item_id, n, w, unnest(range(1, len(w) - n + 2)) as i from b) x),
l as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, l where len(w) >= n) x),
h as (select doc_id, dw.n, i, item_id from dw join bw on dw.n = bw.n and dw.win = bw.win),
p as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from h) x group by doc_id),
r as (select doc_id, max(n) as longest from (select doc_id, run, count(*) as n from (select doc_id, place - row_number() over (partition by doc_id order by place) as run
  from (select distinct doc_id, unnest(range(i, i + n)) as place from h) x) y group by doc_id, run) z group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) x group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated, coalesce(longest, 0) as longest_span
from d left join r on r.doc_id = d.doc_id left join p on p.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op4_chat": OP4, "op5_decontaminate": OP5}
