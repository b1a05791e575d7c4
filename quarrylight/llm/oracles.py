"""DuckDB SQL for what SQL can say of the operators: whole results (near-duplicates, quality rules), and the parts of
others' results that no trained model decides (sizes, url parts and rules, base counts)."""

from __future__ import annotations

LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NEAR_DUPLICATES = f"""
with recursive worded as (select doc_id, coalesce({WORDS.format(LOW)}, []) as w from documents),
sets as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from worded),
sizes as (select doc_id, count(s) as n from worded left join sets using (doc_id) group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from shared join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * k >= 75 * (x.n + y.n - k)),
reach as (select doc_id as d, doc_id as r from documents union select d, b from reach join links on r = a),
least as (select d, min(r) as component_id from reach group by d)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from sizes join least on d = doc_id
"""

QUALITY = f"""
with docs as materialized (select row_number() over () as k, doc_id, coalesce(text, '') as text, coalesce('s' || source, 'n') as host, coalesce({WORDS.format('text')}, []) as w from documents),
windows as (select k, unnest(range(1, len(w) - 3)) as i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from docs),
twice as (select k, s from windows group by all having count(*) > 1),
repeated as (select k, count(distinct i + j) as n_repeat_words from windows semi join twice using (k, s), range(5) r(j) group by k),
lines as (select k, host, unnest(string_split(text, chr(10))) as line from docs),
worded as (select *, len({WORDS.format('line')}) as n from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dups as (select k, count(*) - count(distinct line) as n_dup_lines from worded group by k),
normal as (
  select k, host, trim(regexp_replace(regexp_replace({LOW.replace('text', 'line')}, '[0-9]', '0', 'g'), '[\\x00-/:-@\\[-`{{-\\x7f]+', ' ', 'g')) as key, sum(n) as n from worded group by all),
common as (select host, key from normal where key <> '' group by all having count(*) > 20),
gone as (select k, sum(n) as n_common from normal semi join common using (host, key) group by k),
facts as (
  select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_common, 0) as n_common
  from docs left join repeated using (k) left join dups using (k) left join gone using (k))
select * exclude (n_common), n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_words - n_common >= 0.3 * n_words as kept from facts
"""

SHARD_SIZES = "select doc_id, coalesce(strlen(text), 0) + 1 as size, 'bytes' as law, null::int as grown_shard from documents"

URL_RULES = """
with cut as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
rules(h, p, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as ruled from parts, rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, ruled from parts left join fits using (page_id)
"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: case when i % 2 = 1 then substr(reverse({_DIGITS}), i, 1)::int else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(reverse({_DIGITS}), i, 1)::int + 1] end)) % 10 = 0"
PERSONAL_BASE = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as n_email,
  len(list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: p::hugeint)) <= 255)) as n_ip,
  len(list_filter(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: length({_DIGITS}) between 12 and 19 and {_LUHN})) as n_card,
  len(list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS}) between 9 and 15)) as n_phone
from t
"""

SECRET_BASE = r"""
with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, len(list_filter(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) as n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) as n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 32)) as n_hex
from t
"""
