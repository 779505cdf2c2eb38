"""DuckDB SQL for the results of those operators that SQL expresses, written from their definitions."""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

# Documents of the same words are alike; links are counted from all shared five-word windows.
OP1 = f"""
with recursive w as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
c as (select w, min(doc_id) as rep, count(*) as copies from w group by w),
g as (
  select rep, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w]
    else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as gram from c),
s as (select distinct rep, gram from g),
n as (select rep, count(*) as n from s group by rep),
p as (select a.rep as a, b.rep as b, count(*) as both_ from s a join s b on a.gram = b.gram and a.rep <> b.rep group by 1, 2),
l as (
  select p.a, p.b, c.copies from p join n x on x.rep = p.a join n y on y.rep = p.b join c on c.rep = p.b
  where p.both_ >= 0.8 * (x.n + y.n - p.both_) - 1e-9),
reach as (select rep as a, rep as b from c union select reach.a, l.b from reach join l on l.a = reach.b),
k as (select a, min(b) as class_id from reach group by a),
m as (select a, sum(copies) as linked from l group by a)
select w.doc_id, c.rep as rep_id, k.class_id, cast(c.copies - 1 + coalesce(m.linked, 0) as bigint) as n_links
from w join c on w.w = c.w join k on k.a = c.rep left join m on m.a = c.rep
"""

# Longest repeats only matter beyond 100 words: then some window of 101 words comes twice.
OP3 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
l as (select r, unnest(string_split(text, chr(10))) as line from d),
dup as (
  select r, sum(n - 1) as n_dup_lines from (
    select r, line, count(*) as n from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by all) group by r),
win as (
  select r, k, unnest(range(1, len(w) - k + 2)) as i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: hash(w[i:i + k - 1]))) as h
  from d, (values (3), (10), (101)) as t(k) where len(w) >= k),
often as (select r, k, i from (select *, count(*) over (partition by r, k, h) as n from win) where n > 1),
cover as (select r, k, count(distinct p) as words from (select r, k, unnest(range(i, i + k)) as p from often) group by r, k),
m as (
  select d.doc_id, len(w) as n_words, length(list_aggregate(list_append(w, ''), 'string_agg', '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(c3.words, 0) as n_repeat_words, coalesce(c10.words, 0) as covered_words, c101.words as over
  from d left join dup using (r) left join cover c3 on c3.r = d.r and c3.k = 3
  left join cover c10 on c10.r = d.r and c10.k = 10 left join cover c101 on c101.r = d.r and c101.k = 101),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, cast(covered_words as bigint) as covered_words,
  base_failed, not base_failed and over is null and 100 * covered_words <= 30 * n_words as kept
from b
"""

_KINDS = [  # kind, pattern, group, least length; letters in either case are spelled out
    (
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        '["\'\']?\\x20*[:=]\\x20*["\'\']?([A-Za-z0-9+/_.=-]+)',
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("prefixed", "(gh[pousr]_|xox[abprs]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}", 0, 0),
]
_MATCHES = " union all ".join(
    f"""select r, '{kind}' as kind, {turn} as turn, {least} as least,
      unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) as nth,
      unnest(list_transform(regexp_extract_all(text, '{pattern}'), lambda x: length(x))) as found,
      unnest(list_transform(regexp_extract_all(text, '{pattern}', {group}), lambda x: length(x))) as value,
      unnest(list_transform(string_split_regex(text, '{pattern}')[1:len(regexp_extract_all(text, '{pattern}'))], lambda x: length(x))) as gap
    from d where regexp_matches(text, '{pattern}')"""
    for turn, (kind, pattern, group, least) in enumerate(_KINDS)
)
OP4 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
m as ({_MATCHES}),
e as (select *, sum(gap + found) over (partition by r, kind order by nth) as stop from m),
f as (select r, kind, turn, concat_ws(':', kind, cast(stop - found as bigint), cast(stop as bigint)) as span, stop - found as start
  from e where value >= least),
g as (
  select r, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
    count(*) filter (where kind = 'hex') as n_hex, string_agg(span, ',' order by start, turn) as spans,
    string_agg(span, ',' order by start, turn) filter (where turn < 3) as base
  from f group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (r)
"""

OP5 = """
with p as (
  select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as top,
    sha1(coalesce(html, '')) as h from pages)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(h, cast(i // 4 * 5 + 1 as integer), 5) as bigint) // [32768, 1024, 32, 1][i % 4 + 1]) % 32 + 1 as integer), 1)), '')
    as payload_digest,
  case when top is null or top is not distinct from page_id then 'response' else 'revisit' end as record_type,
  case when top is null or top is not distinct from page_id then null else top end as refers_to, true as verified
from p
"""

OP6 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (
  select *, replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>') as r,
    regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as x from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<|im_start|>') + length(r) + 1 + length(x) + length('<|im_end|>') + 1) as bigint) as formatted_chars
from e group by conv_id
"""

_LINE_WORDS = "list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP7 = f"""
with d as (
  select *, row_number() over (order by doc_id nulls last, text)::hugeint * 4294967296 as place
  from (select distinct doc_id, coalesce(text, '') as text from documents)),
o as (
  select doc_id, text, place, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as line from d),
w as (select doc_id, text, place + i as own, i, {_LINE_WORDS} as w from o),
occ as (select * from w where len(w) > 0),
u as (select w, min(own) as place from occ group by w),
v as (select w, place, unnest(range(1, len(w) + 1)) as pos from u where len(w) >= 8),
x as (select w, place, pos, list_concat(w[1:pos - 1], w[pos + 1:]) as rest from v),
pairs as (
  select b.w from (select *, min(place) over (partition by rest, pos) as least from x) b where b.least < b.place
  union select x.w from x join u on u.w = x.rest where len(u.w) >= 8 and u.place < x.place
  union select u.w from x join u on u.w = x.rest where len(u.w) >= 8 and x.place < u.place),
j as (
  select occ.doc_id, occ.text, occ.i, occ.own > u.place as exact,
    pairs.w is not null as near
  from occ join u on occ.w = u.w left join pairs on pairs.w = occ.w),
k as (
  select doc_id, text, count(*) as n_lines, count(*) filter (where exact) as n_exact, count(*) filter (where near and not exact) as n_near,
    string_agg(cast(i as varchar), ',' order by i) filter (where exact or near) as dropped
  from j group by doc_id, text)
select documents.doc_id, cast(coalesce(n_lines, 0) as integer) as n_lines, cast(coalesce(n_exact, 0) as integer) as n_exact,
  cast(coalesce(n_near, 0) as integer) as n_near, coalesce(dropped, '') as dropped
from documents left join k on documents.doc_id is not distinct from k.doc_id and coalesce(documents.text, '') = k.text
"""

OP9 = f"""
with s as (
  select doc_id, source, cast(len({_WORDS}) as bigint) as size,
    (cast('0x' || substr(md5('9:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 12) as bigint)::double + 0.5) / 281474976710656.0 as u
  from documents),
t as (select source, sum(size)::double as source_size, 2.0 * sum(size)::double as cap from s group by source),
w as (select *, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from t),
l as (
  select *, (1.5 * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w),
p as (
  select source, source_size, cap,
    coalesce(least(cap, weight * max(case when level <= cap / weight then level end) over ()), cap) as target from l),
c as (
  select s.*, p.source_size, p.target, case when p.source_size > 0 then least(2.0::double, p.target * 1.0::double / p.source_size) else 0.0::double end as expected
  from s join p on s.source is not distinct from p.source),
r as (
  select *, floor(expected) as whole, expected - floor(expected) as part,
    case when expected - floor(expected) > 0 then (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) end as rank_
  from c),
m as (
  select *, target - sum(whole * size) over (partition by source) as missing,
    sum(case when rank_ is not null then size else 0 end) over (partition by source order by rank_ nulls last, doc_id nulls first, size
      rows between unbounded preceding and current row) as upto
  from r)
select doc_id, size, cast(m.source_size as bigint) as source_size, target,
  cast((whole + case when rank_ is not null and 2 * upto - size < 2 * missing then 1 else 0 end) * size as bigint) as taken
from m
"""

# CRC-32 from its table, which its polynomial gives.
OP11 = """
with t as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as tab),
own as (
  select conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as seq
  from conversations where conv_id is not null group by conv_id),
plan as (
  select conv_id, seq, conv_id - ((conv_id % 5) + 5) % 5 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda ch: ascii(ch)::bigint)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 9 as h
  from own, t),
new as (
  select plan.conv_id, list_concat(coalesce(own.seq[1:plan.h], []), plan.seq[plan.h + 1:]) as seq from plan left join own on own.conv_id = plan.base),
m as (select conv_id, d, seq[1:d] as pre, d = len(seq) as ends from new, unnest(range(len(seq) + 1)) as u(d)),
n as (
  select pre, d, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from m group by pre, d),
k as (select pre[1:d - 1] as pre, count(*) as n_children from n where d > 0 group by 1),
c as (
  select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * case when d = 0 then 0 else octet_length(encode(n.pre[d].x)) end as saved
  from n left join k on k.pre = n.pre),
s as (select pre[1:a] as pre, sum((n_children = 0)::int) as n_leaves, sum(saved) as saved_tokens from c, unnest(range(d + 1)) as u(a) group by 1)
select c.conv_id, c.d as depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, cast(n_leaves as bigint) as n_leaves,
  cast(saved_tokens as bigint) as saved_tokens, c.ends_sha256
from c join s on s.pre = c.pre left join n p on c.d > 0 and p.pre = c.pre[1:c.d - 1]
"""

OP12 = """
with d as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
w as materialized (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from d),
g as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as p
  from w, (values (1), (2), (3)) as t(k) where len(w) >= k),
f as materialized (select lang, k, p, count(*) as a from g group by lang, k, p),
n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
c as materialized (select *, string_split(p, ' ') as v from f where k >= 2 and a >= 10),
held as (select lang, array_to_string(v[i:i + 1], ' ') as p, max(a) as held from c, (values (1), (2)) as t(i) where k = 3 group by 1, 2),
cuts as (
  select lang, p, a, j, array_to_string(v[1:j], ' ') as first, array_to_string(v[j + 1:], ' ') as second from c, (values (1), (2)) as t(j) where j < k),
s as (
  select cuts.lang, cuts.p, cuts.a, l.a as l, r.a as r, j, cast(1000000::hugeint * cuts.a * cuts.a // (l.a::hugeint * r.a) as bigint) as score
  from cuts join f as l on l.lang = cuts.lang and l.p = first join f as r on r.lang = cuts.lang and r.p = second),
b as (select * from s qualify row_number() over (partition by lang, p order by score, j) = 1),
q as (
  select b.*, b.p as phrase from b left join held on held.lang = b.lang and held.p = b.p
  where held is null or 100 * held < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from q join n using (lang) qualify rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": OP1,
        "op3_repetition": OP3,
        "op4_secret_scan": OP4,
        "op5_warc_segments": OP5,
        "op6_chat_events": OP6,
        "op7_line_dedup": OP7,
        "op9_pareto_mix": OP9,
        "op11_prefix_trie": OP11,
        "op12_collocations": OP12,
    }
