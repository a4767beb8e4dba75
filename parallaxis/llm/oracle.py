"""Equivalent SQL of the queries that SQL can express, for the oracle."""

from __future__ import annotations

from parallaxis.llm import chat, pii

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
  l as (select r, doc_id, unnest(ls) line, unnest(range(1, len(ls) + 1)) pos from d),
  k as (select *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') key from l),
  shared as (select key, min(doc_id) first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
  m as (select k.*, coalesce(k.doc_id <> s.first, false) gone from k left join shared s using (key))
select doc_id, count(*) n_lines, count_if(gone)::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) kept_sha256 from m group by r, doc_id"""

_HOST = "regexp_replace(regexp_extract(u, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')"
WARC_INDEX = f"""
with p as (select page_id, coalesce(html, '') html, lower(coalesce(url, '')) u from pages),
  h as (select *, strlen(html) n, min(page_id) over (partition by html) origin, {_HOST} host, regexp_extract(u, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) path, regexp_extract(u, '^[^?#]*([?][^#]+)', 1) query from p)
select page_id, n payload_bytes, sha256(html) payload_digest, case when n >= 100 and origin <> page_id then 'revisit' else 'response' end record_type,
  case when n >= 100 and origin <> page_id then origin end refers_to,
  array_to_string(list_reverse(string_split(regexp_replace(split_part(host, ':', 1), '^www[.]', ''), '.')), ',') || case when contains(host, ':') then ':' || split_part(host, ':', 2) else '' end
    || ')' || case when path = '' then '/' else path end || query url_key,
  1704067200 + page_id captured, true payload_intact from h"""

_ESC = "replace(replace({}, chr(92), chr(92) || 'b'), '<|', '<' || chr(92) || 'p')"
_W = "(partition by conv_id order by turn nulls first, role, text rows between unbounded preceding and current row)"
_O = "(partition by conv_id order by turn nulls first, role, text)"
CHAT_WINDOWS = f"""
with c as (select conv_id, turn, coalesce(role, '') "role", coalesce(text, '') text from conversations
    union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
  a as (select *, row_number() over {_O} rn, ceil(length(text) / {chat.CHARS_PER_TOKEN})::bigint + {chat.TURN_OVERHEAD} tokens from c),
  b as (select *, rn = 1 and "role" = 'system' sys from a),
  room as (select *, sum(case when sys then 0 else tokens end) over {_W} stop, greatest(1, {chat.BUDGET} - first_value(case when sys then tokens else 0 end) over {_W}) room from b),
  e as (select *, least({chat.HISTORY}, room // 2) history, room - least({chat.HISTORY}, room // 2) bin from room),
  f as (select *, case when sys then 0 else stop - tokens end start from e),
  g as (select *, floor(start::double / bin) low, floor((stop - 1)::double / bin) high from f),
  i as (select *, lag(case when not sys then low end) over {_O} pl, lag(case when not sys then high end) over {_O} ph from g),
  j as (select *, case when sys or coalesce(low = high and pl = ph and pl = low, false) then 0 else 1 end opens from i),
  k as (select *, greatest(0, sum(opens) over {_W} - 1)::bigint span from j),
  l as (select *, max(span) over (partition by conv_id) + 1 spans, {', '.join(f"min(start) over (partition by conv_id order by span range between {n} following and {n} following) n{n}" for n in range(1, chat.AHEAD + 1))} from k),
  shown as (select *, length('<|im_start|>' || replace({_ESC.format('"role"')}, chr(10), chr(92) || 'n') || chr(10) || {_ESC.format('text')} || '<|im_end|>' || chr(10)) chars,
    case when sys then spans else 1 {' '.join(f"+ case when start >= n{n} - history then 1 else 0 end" for n in range(1, chat.AHEAD + 1))} end places from l)
select conv_id, count(*) n_turns, sha256(string_agg("role" || chr(10) || text || chr(10), '' order by rn)) turns_sha256,
  coalesce(sum(length(text)) filter (where "role" = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by rn) filter (where "role" = 'assistant'), '')) loss_sha256,
  sum(chars * places)::bigint formatted_chars, max(spans) n_windows from shown group by conv_id"""

JACCARD_JOIN = f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
  g as (select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) end) s from w),
  n as (select doc_id, count(*) n from g group by doc_id),
  common as (select a.doc_id u, b.doc_id v, count(*) both_have from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by all),
  link as (select u, v from common join n a on a.doc_id = u join n b on b.doc_id = v where 100 * both_have >= 85 * (a.n + b.n - both_have)),
  edge as (select u, v from link union all select v, u from link),
  reach(node, root) as (select doc_id, doc_id from n union select e.v, r.root from reach r join edge e on e.u = r.node),
  least_root as (select node, min(root) root from reach group by node)
select d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(l.root, d.doc_id) component_id from documents d left join n using (doc_id) left join least_root l on l.node = d.doc_id"""

#: The same spans in a dialect without possessive loops and look-around.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){1,2}(?: [0-9]{4}){1,5}(?: [0-9]{1,3})?)\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: case when i % 2 = 1 then substr({_DIGITS}, length({_DIGITS}) - i + 1, 1)::int else (substr({_DIGITS}, length({_DIGITS}) - i + 1, 1)::int * 2) // 10 + (substr({_DIGITS}, length({_DIGITS}) - i + 1, 1)::int * 2) % 10 end)) % 10 = 0"
_TURNED = "(substr(replace(m, ' ', ''), 5) || substr(m, 1, 4))"
_MOD97 = f"list_reduce(list_transform(range(1, length({_TURNED}) + 1), lambda i: case when ascii(substr({_TURNED}, i, 1)) <= 57 then ascii(substr({_TURNED}, i, 1)) - 48 else ascii(substr({_TURNED}, i, 1)) + 945 end), lambda a, c: case when c < 10 then (a * 10 + c) % 97 else (a * 100 + c - 1000) % 97 end) % 97 = 1"
_CHECKS = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 and coalesce(try_cast(right(x, 3) as int), 0) <= 255))",
    "card": f"length({_DIGITS}) between 16 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 8 and 15",
    "iban": _MOD97,
    "ssn": "not (substr(m, 1, 3) in ('000', '666') or m like '9%' or substr(m, 5, 2) = '00' or substr(m, 8, 4) = '0000')",
}


def _kind(n: int, kind: str) -> str:
    sure = pii.PROPOSED + (pii.CONFIRMED if kind in ("card", "iban", "ip", "phone") else 0.2)
    beside = f"lower(right(substr(t, 1, (stop - length(m))::bigint), {pii.CONTEXT}) || ' ' || substr(t, stop::bigint + 1, {pii.CONTEXT}))"
    return f"""{kind}_a as (select r, t, regexp_extract_all(t, '{_PLAIN[kind]}') ms, string_split_regex(t, '{_PLAIN[kind]}') s from d),
  {kind}_b as (select r, t, s, unnest(ms) m, unnest(range(1, len(ms) + 1)) i from {kind}_a),
  {kind}_c as (select *, sum(length(s[i]) + length(m)) over (partition by r order by i) stop from {kind}_b),
  {kind}_d as (select r, {n} k, '{kind}' kind, (stop - length(m))::bigint start, stop::bigint stop, case when regexp_matches({beside}, '{pii.alone(pii.WORDS[kind])}') then {min(1.0, sure + pii.CONTEXT_GAIN)} else {sure} end score from {kind}_c where {_CHECKS[kind]})"""


_LISTED = "string_agg(kind || ':' || start || ':' || stop, ',' order by k, start)"
PII_SPANS = f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
  {', '.join(_kind(n, kind) for n, kind in enumerate(pii.PATTERNS))},
  f as (select * from ({' union all '.join(f'select * from {kind}_d' for kind in pii.PATTERNS)}) where k < {len(pii.BASE)} or score >= {pii.THRESHOLD}),
  g as (select r, {', '.join(f"count_if(kind = '{kind}')::bigint n_{kind}" for kind in pii.BASE)}, {_LISTED} filter (where k < {len(pii.BASE)}) base, {_LISTED} spans, string_agg(printf('%.2f', score), ',' order by k, start) scores from f group by r)
select doc_id, {', '.join(f"coalesce(n_{kind}, 0) n_{kind}" for kind in pii.BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(scores, '') scores from d left join g using (r)"""

#: Places of all windows of 100 bytes by their digest; texts are cut into pieces first, as offsets into long ones are slow.
SUFFIX_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
  c as (select doc_id, h, unnest(range((length(h) // 2 - 100) // 256 + 1)) c from d where length(h) >= 200),
  v as (select doc_id, c, substr(h, 512 * c + 1, 710) part from c),
  w as (select doc_id, c, part, unnest(range(least(256, length(part) // 2 - 99))) i from v),
  k as (select doc_id, 256 * c + i s, md5(substr(part, 2 * i + 1, 200)) m from w),
  f as (select m, min(struct_pack(d := doc_id, s := s)) f from k group by m having count(*) > 1),
  x as (select k.doc_id, k.s, lag(k.s) over (partition by k.doc_id order by k.s) before from k join f using (m) where k.doc_id <> f.f.d or k.s <> f.f.s),
  g as (select *, sum(case when before is null or s > before + 100 then 1 else 0 end) over (partition by doc_id order by s) span from x),
  p as (select doc_id, span, min(s) a, max(s) + 100 b from g group by all),
  q as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) after from p),
  o as (select doc_id, sum(b - a)::bigint gone, count(*) spans, string_agg(substr(d.h, 2 * after + 1, 2 * (a - after)), '' order by a) front, max(b) last from q join d using (doc_id) group by doc_id)
select doc_id, length(h) // 2 n_bytes, coalesce(gone, 0) n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) kept_sha256 from d left join o using (doc_id)"""

#: The checksum is worked out bytewise; letters beyond one byte are of two.
SPELLING = f"""
with recursive t as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) crc from range(256) r(i)),
  r as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') run from documents),
  c as (select doc_id, run, count(*) n from r group by all),
  y as (select *, flatten(list_transform(string_split(doc_id::varchar || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195, unicode(x)::bigint - 64] end)) bytes from c),
  h as (select run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) h from y, t),
  e as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end word, n from h),
  w as (select word, sum(n)::bigint n from e where length(word) >= 5 group by word having sum(n) >= 3),
  o as (select word, i, substr(word, 1, i) || substr(word, i + 2) hole from (select word, unnest(range(length(word))) i from w)),
  p as (select a.word, b.word near from o a join o b on a.i = b.i and a.hole = b.hole and a.word <> b.word union select word, hole from o where hole in (select word from w) union select hole, word from o where hole in (select word from w)),
  b as (select p.word, near, w.n near_n, count(*) over (partition by p.word) n_near, row_number() over (partition by p.word order by w.n desc, near) rn from p join w on w.word = p.near),
  f as (select w.word, w.n, coalesce(n_near, 0) n_near, case when near_n >= 2 * w.n then near end form, case when near_n >= 2 * w.n then near_n end form_n from w left join b on b.word = w.word and rn = 1),
  u as (select word, word root, form next from f union all select u.word, f.word, f.form from u join f on f.word = u.next)
select f.word, f.form, u.root, f.n, f.n_near, f.form_n from f join u on u.word = f.word and u.next is null"""

ORACLE_SQL = {
    "op3_pii_spans": PII_SPANS,
    "op2_line_dedup": LINE_DEDUP,
    "op7_warc_index": WARC_INDEX,
    "op8_chat_windows": CHAT_WINDOWS,
    "op9_ngram_jaccard_join": JACCARD_JOIN,
    "op11_suffix_dedup": SUFFIX_DEDUP,
    "op13_spelling_variants": SPELLING,
}
