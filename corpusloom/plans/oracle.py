"""SQL that DuckDB runs on the same tables, one text a query; built from shared pieces."""

from __future__ import annotations

QUESTION = "How does the gateway treat access tokens when the source has changed since the last import?"
EXCLUDED = "gavepi-forum.example"

_BR = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"
_LINES = f"""
ls as (select id, doc_id, hash, text, string_split_regex(text, {_BR}) raw from documents where text is not null and text <> ''),
ln as (select id, doc_id, hash, case when raw[-1] = '' then raw[:-2] else raw end l from ls),
l as (select id, doc_id, hash, unnest(l) line, unnest(range(1, len(l) + 1)) line_no from ln)
"""
_BLANK = "not regexp_matches({0}, '[^\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0b\\x1c-\\x1f]')"
_S = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]"
_HEAD = f"'^#{{1,6}}{_S}+(.+)$'"
_BASE = f"""{_LINES},
f as (select *, sum(cast(regexp_matches(line, '^{_S}*(```|~~~)') as int)) over (partition by id order by line_no) fences from l),
h as (select *, case when fences % 2 = 0 and regexp_matches(line, {_HEAD}) then 1 else 0 end head from f),
s as (select *, sum(head) over (partition by id order by line_no) sec from h),
p as (select *, (row_number() over (partition by id, sec order by line_no) - 1) // 20 piece from s),
t as (select id, sec, max(case when head = 1 then regexp_extract(line, {_HEAD}, 1) end) title from s group by 1, 2),
g as (select id, any_value(hash) hash, sec, piece, min(line_no) start_line, max(line_no) end_line, string_agg(line, chr(10) order by line_no) text from p group by id, sec, piece),
base as (select sha256(g.id || ':' || hash || ':heading-lines-v1:20:' || start_line || ':' || end_line) id, g.id doc_id, coalesce(title, '(正文)') section, cast(start_line as int) start_line, cast(end_line as int) end_line, text, 'body' kind
 from g join t on g.id = t.id and g.sec = t.sec where regexp_matches(text, '\\S'))
"""
_META = f"'(?i)^{_S}*(Source|Publisher|License|Retrieved|Title|Author|Date){_S}*[:：]'"
_NOTE = f"'(?i)^{_S}*(This is a (selected )?excerpt|Formatting and|Adapted from|Note:)'"
# sections, their provenance part (0) and the rest (1), and where a piece starts: one step a line
_BLOCKS = f"""{_LINES},
h as (select *, regexp_matches(line, {_HEAD}) head, {_BLANK.format('line')} blank, regexp_matches(line, {_META}) meta, regexp_matches(line, {_NOTE}) note, regexp_matches(line, '^{_S}*([-*+]|\\d+[.)]){_S}+') item, regexp_matches(line, '[:：]{_S}*$') colon from l),
s as (select *, sum(cast(head as int)) over (partition by id order by line_no) sec from h),
u as (select *, row_number() over (partition by id, sec order by line_no) n from s),
w as (select id, sec, any_value(case when n = 1 and head then regexp_extract(line, {_HEAD}, 1) end) title, bool_or(n = 1 and head) headed, min(case when n > 1 and not blank and not meta and not note then n end) body_at from u group by 1, 2),
v as (select id, sec, coalesce(headed and bool_or(n > 1 and (meta or note) and (body_at is null or n < body_at)), false) peel from u join w using (id, sec) group by id, sec, headed),
p as (select u.*, title, case when peel and (body_at is null or n < body_at) then 0 else 1 end part from u join w using (id, sec) join v using (id, sec)),
i as (select *, row_number() over (partition by id, sec, part order by line_no) k, coalesce(lead(item) over (partition by id, sec, part order by line_no), false) next_item from p),
r as (select id, sec, part, k, line_no, line_no starts, colon and not blank open, next_item from i where k = 1
 union all select i.id, i.sec, i.part, i.k, i.line_no, case when r.line_no - r.starts + 1 >= 20 and not (r.open and r.next_item) then i.line_no else r.starts end,
  case when not i.blank then i.colon else r.open and not (r.line_no - r.starts + 1 >= 20 and not (r.open and r.next_item)) end, i.next_item from r join i on i.id = r.id and i.sec = r.sec and i.part = r.part and i.k = r.k + 1),
g as (select id, sec, part, starts, any_value(hash) hash, max(line_no) ends, any_value(title) title, string_agg(line, chr(10) order by line_no) text, bool_and(blank or meta) provenance, bool_and(blank) blank from r join i using (id, sec, part, k, line_no) group by 1, 2, 3, 4)"""
# the same with fences heeded, titles inherited over peeled ones, and pieces of prose and fences: one step a line
_PROCEDURES = f"""{_LINES},
f as (select *, regexp_matches(line, '^{_S}*(```|~~~)') fence, {_BLANK.format('line')} blank, regexp_matches(line, {_META}) or regexp_matches(line, {_NOTE}) meta, regexp_matches(line, {_HEAD}) headlike from l),
h as (select *, headlike and sum(cast(fence as int)) over (partition by id order by line_no) % 2 = 0 head from f),
s as (select *, sum(cast(head as int)) over (partition by id order by line_no) sec from h),
u as (select *, row_number() over (partition by id, sec order by line_no) n from s),
w as (select id, sec, coalesce(any_value(case when n = 1 and head then regexp_extract(line, {_HEAD}, 1) end), '(正文)') title, bool_or(n = 1 and headlike) headed, min(case when n > 1 and not blank and not meta then n end) body_at from u group by 1, 2 having not bool_and(blank)),
v as (select id, sec, title, body_at, coalesce(headed and bool_or(n > 1 and meta and (body_at is null or n < body_at)), false) peel from u join w using (id, sec) group by id, sec, title, headed, body_at),
t as (select *, last_value(case when not peel then title end ignore nulls) over o own, first_value(case when peel and body_at is not null then title end ignore nulls) over o opening from v window o as (partition by id order by sec rows between unbounded preceding and 1 preceding)),
p as (select u.*, case when peel and (body_at is null or n < body_at) then 0 else 1 end part, case when peel and (body_at is null or n < body_at) then '(说明性元数据)' when peel then coalesce(own, opening, title) else title end label from u join t using (id, sec)),
q as (select *, row_number() over (partition by id, sec, part order by line_no) k, first_value(headlike) over (partition by id, sec, part order by line_no) headed, first_value(line_no) over (partition by id, sec, part order by line_no) starts_at from p),
i as (select *, k - cast(headed as int) j from q where k > cast(headed as int)),
r as (select id, sec, part, j, line_no, case when not blank then line_no end cur, fence inf, blank done from i where j = 1
 union all select i.id, i.sec, i.part, i.j, i.line_no, case when r.inf then r.cur when i.blank then null else coalesce(case when not r.done then r.cur end, i.line_no) end, case when r.inf then not i.fence else i.fence end,
  case when r.inf then i.fence when i.blank then true when i.fence then false else i.line_no - coalesce(case when not r.done then r.cur end, i.line_no) + 1 >= 20 end from r join i on i.id = r.id and i.sec = r.sec and i.part = r.part and i.j = r.j + 1),
c as (select id, sec, part, cur, max(line_no) ends from r where cur is not null group by 1, 2, 3, 4),
a as (select c.*, label, case when headed and cur = min(cur) over (partition by c.id, c.sec, c.part) then starts_at else cur end starts from c join (select distinct id, sec, part, label, headed, starts_at from q) using (id, sec, part)),
g as (select a.id, label, part, starts, ends, any_value(hash) hash, string_agg(line, chr(10) order by line_no) text, bool_or(fence) fenced from a join f on f.id = a.id and f.line_no between starts and ends group by 1, 2, 3, 4, 5)"""
_TOK = "regexp_extract_all(lower({0}), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]+')"
_ALIAS = (("提示注入", "prompt injection"), ("工具权限", "tool permissions"), ("最小权限", "least privilege"), ("间接注入", "indirect injection"))


def _expanded(q: str) -> str:
    return f"lower({q}) || " + " || ".join(f"case when contains({q}, '{a}') then ' {b}' else '' end" for a, b in _ALIAS)


_ACTIVE = "ch as (select id, any_value(kind) kind, any_value(doc_id) doc_id, any_value(text) text, any_value(start_line) start_line, any_value(end_line) end_line from chunks where active group by id)"
_PAGES = """pc as (select id, any_value(doc_id) doc_id, any_value(version) version, any_value(page) page, any_value(start_line) start_line, any_value(text) text from chunks where active and page is not null group by id),
pp as (select doc_id id, row_number() over (partition by doc_id, version order by page) page, string_agg(text, chr(10) order by start_line, id) t from pc group by doc_id, version, page)"""
_PAGED = f"""{_PAGES}, pv as (select doc_id id, any_value(version) hash from pc group by 1), pl as (select id, page, unnest(string_split(t, chr(10))) line, unnest(range(1, len(string_split(t, chr(10))) + 1)) pos from pp),
pa as (select *, row_number() over (partition by id order by page, pos) n, {_BLANK.format('line')} blank, regexp_replace(regexp_replace(line, '^{_S}+|{_S}+$', '', 'g'), '\\d+', '#', 'g') key from pl),
pe as (select *, pos = min(case when not blank then pos end) over (partition by id, page) top, pos = max(case when not blank then pos end) over (partition by id, page) bottom from pa),
po as (select id, count(distinct page) total from pa group by 1),
pk as (select id, 'top' edge, key from pe join po using (id) where top and total >= 2 group by id, key, total having count(*) >= greatest(2, (total + 1) // 2) union all select id, 'bottom', key from pe join po using (id) where bottom and total >= 2 group by id, key, total having count(*) >= greatest(2, (total + 1) // 2)),
pf as (select pe.*, coalesce(top, false) and exists (select 1 from pk where pk.id = pe.id and pk.key = pe.key and edge = 'top') or coalesce(bottom, false) and exists (select 1 from pk where pk.id = pe.id and pk.key = pe.key and edge = 'bottom') furniture,
 regexp_matches(line, {_HEAD}) headlike, coalesce(sum(cast(regexp_matches(line, '^{_S}*(```|~~~)') as int)) over (partition by id order by n rows between unbounded preceding and 1 preceding), 0) % 2 = 0 plain from pe),
ps as (select *, case when n = 1 or furniture or (headlike and plain) or lag(furniture) over o or lag(page) over o <> page then 1 else 0 end new, last_value(case when headlike and plain and not furniture then regexp_extract(line, {_HEAD}, 1) end ignore nulls) over (partition by id order by n) title from pf window o as (partition by id order by n)),
pn as (select *, sum(new) over (partition by id order by n) piece from ps), pm as (select *, row_number() over (partition by id, piece order by n) k, regexp_matches(line, {_META}) or regexp_matches(line, {_NOTE}) boiler from pn),
pw as (select id, piece, bool_or(k = 1 and headlike) headed, min(case when k > 1 and not blank and not boiler then k end) body_at from pm group by 1, 2),
px as (select id, piece, body_at, headed and bool_or(k > 1 and boiler and k < body_at) peel from pm join pw using (id, piece) group by id, piece, body_at, headed),
py as (select pm.*, case when coalesce(peel, false) and not furniture and k < body_at then 0 else 1 end part from pm join px using (id, piece)),
pg as (select id, piece, part, any_value(page) page, bool_or(furniture) furniture, first(title order by n) title, min(n) starts, max(n) ends, string_agg(line, chr(10) order by n) text, bool_and(blank) blank from py group by 1, 2, 3)"""
_SAMPLE = "sm as (select id case_id, any_value(split) split, any_value(question) question, any_value(evidence) evidence from cases where split in ('development', 'holdout') and id is not null and trim(question) <> '' and len(evidence) > 0 group by id)"
_ONE = f"qs as (select 'q' query_id, '{QUESTION}' text)"
_DEV = f"{_SAMPLE}, qs as (select case_id query_id, question text from sm)"
_TERMS = f"""tk as (select id, kind, unnest({_TOK.format("text")}) term from ch),
tf as (select id, kind, term, count(*) tf from tk group by all),
le as (select id, kind, greatest(1, len({_TOK.format("coalesce(text, '')")})) length from ch),
qt as (select distinct query_id, unnest({_TOK.format(_expanded("text"))}) term from qs)"""
_KEYWORD = """ks as (select query_id, id, kind, count(*) score from tf join qt using (term) group by all),
kr as (select query_id, id, score, row_number() over (partition by query_id order by score desc, kind <> 'body', id) rank from ks)"""
_BM25 = """st as (select count(*) n, avg(length) avgdl from le), df as (select term, count(*) df from tf group by 1),
bs as (select query_id, id, kind, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) score from tf join qt using (term) join df using (term) join le using (id, kind), st group by all),
br as (select query_id, id, score, row_number() over (partition by query_id order by kind <> 'body', score desc, id) rank from bs where score > 0)"""
_EXCLUDED = f"ex as (select id doc_id from documents where lower(trim(source)) = '{EXCLUDED}'), n as (select least(20, 5 + (select count(*) from ex) + 3) n)"
_VECTORS = """{n}_t as (select id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]+') ts from {rows}), {n}_w as (select id, ts, unnest(range(0, greatest(1, cast(ceil(len(ts) / 100.0) as int)))) i from {n}_t),
{n}_h as (select id, i, sha256(array_to_string(ts[i * 100 + 1:(i + 1) * 100], ' ')) h from {n}_w), {n}_d as (select id, i, h, unnest(range(0, 8)) dim from {n}_h),
{n}_x as (select id, i, dim, cast(('0x' || substr(h, cast(8 * dim + 1 as int), 8)) as bigint) / 2147483648.0::double - 1 x from {n}_d), {n}_s as (select id, i, greatest(sqrt(sum(x * x)), 1e-12) s from {n}_x group by 1, 2),
{n}_m as (select id, dim, avg(x / s) m from {n}_x join {n}_s using (id, i) group by 1, 2), {n}_l as (select id, greatest(sqrt(sum(m * m)), 1e-12) s from {n}_m group by 1), {n}_n as (select id, dim, m / s x from {n}_m join {n}_l using (id))"""
_BY_VECTOR = f"""qx as (select query_id id, text from qs), {_VECTORS.format(rows='ch', n='vv')}, {_VECTORS.format(rows='qx', n='ww')}, ve as (select id, list(x order by dim) e from vv_n group by 1), we as (select id query_id, list(x order by dim) e from ww_n group by 1),
vs as (select query_id, ve.id, round(list_dot_product(ve.e, we.e), 6) score from ve, we), vr as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) rank from vs)"""


def _change(own: str, base: str) -> str:
    return f"case when {own}.recall is null or {base}.recall is null then 'unscored' when {own}.recall > {base}.recall then 'gained' when {own}.recall < {base}.recall then 'lost' else 'same' end"


_COVER = """sp as (select case_id, unnest(evidence) e, unnest(range(1, len(evidence) + 1)) span_no from sm),
ds as (select case_id, span_no, coalesce(e.required_together, true) together, e.start_line a, e.end_line z, coalesce(u.id, v.id) doc from sp left join documents u on u.url = e.source left join documents v on v.id = e.source),
cv as (select case_id, span_no, together, ch.id from ds left join ch on ch.doc_id = doc and ch.start_line <= z and ch.end_line >= a)"""


def _bundles(ranked: str, name: str) -> str:
    return f"""{name}_r as (select query_id case_id, id, 1 hit from {ranked} where rank <= 5),
{name}_b as (select case_id, span_no, count(cv.id) covering, count(hit) retrieved, count(cv.id) = 0 stale, case when any_value(together) then count(hit) = count(cv.id) and count(cv.id) > 0 else count(hit) > 0 end whole from cv left join {name}_r using (case_id, id) group by 1, 2),
{name}_e as (select case_id, sum(greatest(1, length(coalesce(text, '')) // 4)) t, count(*) filter (where kind = 'metadata') m from {name}_r join ch using (id) group by 1),
{name}_c as (select case_id, count(span_no) relevant, count(*) filter (where whole) w, count(*) filter (where retrieved > 0 and not whole) br, bool_or(stale) stale from {name}_b group by 1),
{name}_s as (select case_id, coalesce(relevant, 0) relevant, cast(case when stale then 0 else w end as bigint) whole, cast(case when stale then 0 else br end as bigint) broken,
 case when not stale then round(w / relevant, 6) end recall, cast(case when stale then 0 else coalesce(t, 0) end as bigint) tokens, cast(case when stale then 0 else coalesce(m, 0) end as bigint) metadata_chunks
, split from sm left join {name}_c using (case_id) left join {name}_e using (case_id))"""


_EVAL = f"with {_ACTIVE}, {_DEV}, {_TERMS}, {_BM25}, {_COVER}, {_bundles('br', 'b')}"
_CURRENT = "cur as (select id, url source, sha256(text) hash, text from documents where text is not null)"
_INCOMING = """inc as (select distinct sha256(trim(src)) id, sha256(tx) hash, tx text from (select case when doc_id % 11 = 0 then url || '/new' else url end src, case when doc_id % 5 = 0 then text || chr(10) || 'Updated.' else text end tx from documents where text is not null and doc_id % 7 <> 0))"""
_HASHSUM = "cast(coalesce(sum(cast(('0x' || substr(h, {0}, 8)) as bigint)), 0) as varchar)"


def _sums(rows: str, lead: str = "") -> str:
    return f"(select count(*) n, sha256({lead}" + " || ':' || ".join(_HASHSUM.format(a) for a in (1, 9, 17, 25)) + f") x from {rows})"


_SIZES = "kc as (select query_id, count(*) c from kr where rank <= 15 group by 1), sz as (select qs.query_id, least(5, coalesce(c, 0)) s1, least(10, coalesce(c, 0)) s2, least(15, coalesce(c, 0)) s3 from qs left join kc using (query_id))"
_MODES = f"""{_SIZES}, md as (select query_id, 'off' mode, 0 rounds, cast(s1 as int) reached, 'round_limit' stop_reason, 'same' change from sz union all select query_id, 'on', 1, cast(s1 as int), 'no_new_evidence', 'same' from sz
union all select query_id, 'widening', case when s2 = s1 then 1 else 2 end, cast(s3 as int), case when s3 = s2 or s2 = s1 then 'no_new_evidence' else 'round_limit' end, case when s3 > s1 then 'gained' else 'same' end from sz)"""
_CALLS = "cl as (select user_id account, event_id id, cast(round(value * 100) as bigint) amount, event_type in ('error', 'view') opens, row_number() over (partition by user_id order by ts, event_id) n from events)"


def _guard(limit: int, opens: str) -> str:
    ok = f"not blocked and spent + cl.amount <= {limit} and cl.amount >= 0"
    return f"""with recursive {_CALLS}, f as (select account, n, id, 0::bigint spent_before, amount >= 0 and amount <= {limit} accepted, case when amount >= 0 and amount <= {limit} and not ({opens}) then amount else 0 end spent, amount >= 0 and amount <= {limit} and ({opens}) blocked from cl where n = 1
union all select cl.account, cl.n, cl.id, spent, {ok}, case when {ok} and not ({opens}) then spent + cl.amount else spent end, blocked or ({ok} and ({opens})) from f join cl on cl.account = f.account and cl.n = f.n + 1)
select account, id, accepted, spent_before from f"""


_ANSWERS = """ca as (select id answer_id, any_value(question) question, any_value(expected_status) status, any_value(evidence) evidence from cases where len(evidence) > 0 and question is not null group by id),
an as (select answer_id, question, status, case when status = 'grounded' then '' else 'not stated' end missing, list_filter(evidence, lambda e: len(e.must_include) > 0) ev from ca)"""

_BASE_OF_VERSIONS = _BASE.replace("from documents where text is not null and text <> ''", "from (select id, id doc_id, hash, text, now from k where text <> '')")
for _a, _b in (("id, doc_id, hash, text, string_split_regex", "id, doc_id, hash, now, text, string_split_regex"), ("select id, doc_id, hash, case when raw", "select id, doc_id, hash, now, case when raw"), ("select id, doc_id, hash, unnest(l)", "select id, doc_id, hash, now, unnest(l)"), ("partition by id order", "partition by id, hash order"), ("partition by id, sec", "partition by id, hash, sec"), ("from s group by 1, 2),", "from s group by 1, 2, 3),"), ("t as (select id, sec,", "t as (select id, hash, sec,"), ("any_value(hash) hash, sec, piece", "hash, any_value(now) now, sec, piece"), ("group by id, sec, piece", "group by id, hash, sec, piece"), ("on g.id = t.id and", "on g.id = t.id and g.hash = t.hash and"), ("':' || hash || ':heading", "':' || g.hash || ':heading"), ("'body' kind\n", "'body' kind, g.hash, g.hash = now live\n")):
    assert _a in _BASE_OF_VERSIONS, _a
    _BASE_OF_VERSIONS = _BASE_OF_VERSIONS.replace(_a, _b)

ORACLE_SQL: dict[str, str] = {
    "q_lines": f"with {_LINES} select doc_id, cast(line_no as int) line_no, line from l",
    "q_chunk_baseline": f"with {_BASE} select * from base",
    "q_chunk_blocks": f"""with recursive {_BLOCKS} select sha256(id || ':' || hash || ':heading-block-v2:' || starts || ':' || ends) id, id doc_id, case when part = 0 then '(说明性元数据)' else coalesce(title, '(正文)') end section, cast(starts as int) start_line, cast(ends as int) end_line, text,
 case when part = 0 or provenance then 'metadata' else 'body' end kind from g where not blank""",
    "q_chunk_procedures": f"""with recursive {_PROCEDURES} select sha256(id || ':' || hash || ':heading-procedure-v3:' || starts || ':' || ends) id, id doc_id, case when fenced and label not in ('(正文)', '(说明性元数据)') then '代码（' || label || '）' else label end section,
 cast(starts as int) start_line, cast(ends as int) end_line, text, case when part = 0 then 'metadata' else 'body' end kind from g""",
    "q_chunk_pages": f"""with {_PAGED} select sha256(pg.id || ':' || hash || ':pdf-pages-v1:' || page || ':' || starts || ':' || ends) id, pg.id doc_id, case when part = 0 then '(说明性元数据)' else coalesce(title, '(正文)') end section, cast(starts as int) start_line, cast(ends as int) end_line,
 case when part = 0 or furniture then 'metadata' else 'body' end kind, cast(page as int) page from pg join pv using (id) where not blank""",
    "q_chunk_census": f"with {_BASE} select doc_id, count(*) chunks, count(*) filter (where kind = 'metadata') metadata, count(*) filter (where kind <> 'metadata') body, cast(round(avg(length(text)), 0) as bigint) mean_chars from base group by 1",
    "q_page_furniture": f"""
with {_PAGES}, pg as (select id, page, string_split(t, chr(10)) ls from pp),
nb as (select id, page, list_filter(ls, lambda x: not ({_BLANK.format("x")})) r from pg),
tot as (select id, count(*) total from pg group by 1),
e as (select id, 'top' edge, r[1] x from nb where len(r) > 0 union all select id, 'bottom' edge, r[-1] x from nb where len(r) > 0),
k as (select id, edge, regexp_replace(regexp_replace(x, '^{_S}+|{_S}+$', '', 'g'), '\\d+', '#', 'g') key from e)
select id doc_id, edge, key, cast(count(*) as int) pages from k join tot using (id) where total >= 2 group by id, edge, key, total having count(*) >= greatest(2, (total + 1) // 2)""",
    "q_suspect_pages": f"""
with {_PAGES}, nb as (select id, page, list_filter(regexp_extract_all(t, '[^\\n]{{1,3}}'), lambda x: not ({_BLANK.format("x")})) r from pp),
c as (select id, page, len(r) n, len(list_filter(r, lambda x: length(regexp_replace(x, '^{_S}+|{_S}+$', '', 'g')) <= 3)) s from nb)
select id doc_id, cast(page as int) page, cast(n as int) lines, cast(s as int) short from c where n >= 12 and s > 0.6 * n""",
    "q_import_pages": f"""
with {_PAGES}, x as (select id, page, len(list_filter(string_split(t, chr(10)), lambda x: not ({_BLANK.format("x")}))) n from pp)
select 'pages/' || id source, 'pdf-pages-v1' splitter, cast(sum(n) as bigint) lines, count(*) filter (where n > 0) pages from x group by 1 having sum(n) > 0""",
    "q_chunk_preview": f"""with {_ACTIVE}, x as (select ch.*, string_split(d.text, chr(10)) ls from ch join documents d on d.id = ch.doc_id)
select id, kind, start_line, end_line, cast(length(text) as int) chars, array_to_string(ls[greatest(1, start_line - 2):start_line - 1], chr(10)) before, array_to_string(ls[end_line + 1:end_line + 2], chr(10)) after from x""",
    "q_metadata_blocks": f"""with {_ACTIVE}, n as (select id, kind, list_filter(string_split_regex(text, {_BR}), lambda x: not ({_BLANK.format("x")})) r from ch where text is not null)
select id, kind, len(r) > 0 and len(list_filter(r, lambda x: not regexp_matches(x, '(?i)^{_S}*(Source|Publisher|License|Retrieved|Title|Author|Date){_S}*[:：]'))) = 0 provenance from n""",
    "q_structure_fallback": f"""with h as (select doc_id, len(list_filter(string_split_regex(text, {_BR}), lambda x: regexp_matches(x, {_HEAD}))) > 0 headed, splitter from documents where text is not null)
select doc_id, splitter, case when splitter in ('heading-block-v2', 'heading-procedure-v3') and headed then splitter else 'heading-lines-v1:20' end effective from h""",
    "q_tokens_tf": f"with {_ACTIVE}, {_ONE}, {_TERMS} select id, term, tf from tf",
    "q_tokens_df": f"with {_ACTIVE}, {_ONE}, {_TERMS} select term, count(*) df, cast(sum(tf) as bigint) cf from tf group by 1",
    "q_avgdl": f"with {_ACTIVE}, {_ONE}, {_TERMS} select count(*) n, round(coalesce(avg(length), 0), 6) avgdl from le",
    "q_search_terms": f"with r as (select id, any_value(query) q from runs where query is not null group by id) select id, array_to_string({_TOK.format(_expanded('q'))}, ' ') terms from r",
    "q_question_parts": f"""with c as (select id, any_value(question) q from cases where question is not null group by id),
x as (select id, list_filter(list_transform(regexp_extract_all(q, '[^？?；;\\n]+[？?；;\\n]*|[？?；;\\n]+'), lambda p: regexp_replace(p, '^{_S}+|{_S}+$', '', 'g')), lambda p: p <> '') ps from c)
select id, 'q' || unnest(range(1, len(ps) + 1)) part, unnest(ps) text from x""",
    "q_evidence_tokens": f"with {_ACTIVE} select id, cast(greatest(1, length(text) // 4) as bigint) tokens from ch where text is not null",
    "q_keyword_topk": f"with {_ACTIVE}, {_ONE}, {_TERMS}, {_KEYWORD} select query_id, id, cast(rank as int) rank, cast(score as double) score from kr where rank <= 10",
    "q_bm25_topk": f"with {_ACTIVE}, {_ONE}, {_TERMS}, {_BM25} select query_id, id, cast(rank as int) rank, score from br where rank <= 10",
    "q_keyword_batch": f"with {_ACTIVE}, {_DEV}, {_TERMS}, {_KEYWORD} select query_id, id, cast(rank as int) rank, cast(score as double) score from kr where rank <= 5",
    "q_bm25_batch": f"with {_ACTIVE}, {_DEV}, {_TERMS}, {_BM25} select query_id, id, cast(rank as int) rank, score from br where rank <= 5",
    "q_vector_topk": """with s as (select 'q' query_id, b.vec_id id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) score from embeddings a, embeddings b where a.vec_id = 0)
select query_id, id, cast(row_number() over (order by score desc, id) as int) rank, score from s qualify rank <= 10""",
    "q_vector_batch": """with s as (select a.vec_id query_id, b.vec_id id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) score from embeddings a, embeddings b where a.vec_id % 20 = 0)
select query_id, id, cast(row_number() over (partition by query_id order by score desc, id) as int) rank, score from s qualify rank <= 5""",
    "q_pool": """with d as (select label, unnest(embedding) x, unnest(range(0, 64)) dim from embeddings), m as (select label, dim, avg(x::double) m from d group by 1, 2),
n as (select label, greatest(sqrt(sum(m * m)), 1e-12) s from m group by 1) select label id, cast(dim as int) dim, round(m / s, 6) x from m join n using (label)""",
    "q_rrf": f"""with {_ACTIVE}, {_DEV}, {_TERMS}, {_KEYWORD}, {_BM25},
u as (select query_id, id, 'k' n, rank from kr where rank <= 10 union all select query_id, id, 'b' n, rank from br where rank <= 10),
f as (select query_id, id, round(sum(1.0::double / (60 + rank)), 9) score, max(case when n = 'k' then rank end) rk, max(case when n = 'b' then rank end) rb from u group by 1, 2)
select query_id, id, cast(row_number() over (partition by query_id order by score desc, id) as int) rank, score, cast(coalesce(rk, 0) as int) rank_keyword, cast(coalesce(rb, 0) as int) rank_bm25 from f qualify rank <= 5""",
    "q_exclude": f"""with {_ACTIVE}, {_ONE}, {_TERMS}, {_KEYWORD}, {_EXCLUDED}, x as (select query_id, kr.id, score, rank was from kr join ch using (id), n where rank <= n and ch.doc_id not in (select doc_id from ex))
select query_id, id, cast(row_number() over (partition by query_id order by was) as int) rank, cast(score as double) score from x qualify rank <= 5""",
    "q_exclude_bm25": f"""with {_ACTIVE}, {_DEV}, {_TERMS}, {_BM25}, {_EXCLUDED}, x as (select query_id, br.id, score, rank was from br join ch using (id), n where rank <= n and ch.doc_id not in (select doc_id from ex))
select query_id, id, cast(row_number() over (partition by query_id order by was) as int) rank, score from x qualify rank <= 5""",
    "q_search_guard": "select distinct id query_id, 'the query is blank' problem from runs where id % 7 = 0 or trim(coalesce(query, '')) = ''",
    "q_vector_index": f"with {_ACTIVE}, {_VECTORS.format(rows='ch', n='v')} select id, cast(dim as int) dim, round(x, 6) x from v_n",
    "q_rrf_vector": f"""with {_ACTIVE}, {_DEV}, {_TERMS}, {_KEYWORD}, {_BM25}, {_BY_VECTOR},
u as (select query_id, id, 'k' n, rank from kr where rank <= 10 union all select query_id, id, 'b' n, rank from br where rank <= 10 union all select query_id, id, 'v' n, rank from vr where rank <= 10),
f as (select query_id, id, round(sum(1.0::double / (60 + rank)), 9) score, max(case when n = 'k' then rank end) rk, max(case when n = 'b' then rank end) rb, max(case when n = 'v' then rank end) rv from u group by 1, 2)
select query_id, id, cast(row_number() over (partition by query_id order by score desc, id) as int) rank, score, cast(coalesce(rk, 0) as int) rank_keyword, cast(coalesce(rb, 0) as int) rank_bm25, cast(coalesce(rv, 0) as int) rank_vector from f qualify rank <= 5""",
    "q_compare_modes": f"""with {_ACTIVE}, {_DEV}, {_TERMS}, {_BM25}, {_BY_VECTOR},
u as (select query_id, id, rank from br where rank <= 10 union all select query_id, id, rank from vr where rank <= 10), f as (select query_id, id, round(sum(1.0::double / (60 + rank)), 9) score from u group by 1, 2),
hr as (select query_id, id, row_number() over (partition by query_id order by score desc, id) rank from f), {_COVER}, {_bundles('vr', 'v')}, {_bundles('br', 'b')}, {_bundles('hr', 'h')}
select case_id, v_s.recall recall_vector, b_s.recall recall_bm25, h_s.recall recall_hybrid, {_change('b_s', 'v_s')} change_bm25, {_change('h_s', 'v_s')} change_hybrid, v_s.split from v_s left join b_s using (case_id) left join h_s using (case_id)""",
    "q_rank_lookup": f"with {_ACTIVE}, {_DEV}, {_TERMS}, {_BM25}, {_COVER}, w as (select distinct case_id query_id, id from cv where id is not null) select query_id, id, cast(rank as int) rank from w left join (select * from br where rank <= 5) r using (query_id, id)",
    "q_section_recall": f"""with {_ACTIVE}, {_DEV}, {_TERMS}, {_BM25}, sc as (select id, any_value(section) section from chunks where active group by id), n as (select count(*) n from sc where section = '(body)'),
g as (select query_id, count(*) r from br join sc using (id) where rank <= 5 and section = '(body)' group by 1)
select query_id, '(body)' section, n chunks, coalesce(r, 0) retrieved, case when n > 0 then round(coalesce(r, 0) / n, 6) end recall from qs left join g using (query_id), n""",
    "q_term_mismatch": f"""with {_ACTIVE}, {_DEV}, {_TERMS}, {_KEYWORD}, c as (select query_id, count(*) n from kr where rank <= 5 group by 1),
t as (select query_id, text, {_TOK.format(_expanded("text"))} ts from qs)
select query_id, cast(len(list_filter(ts, lambda x: regexp_matches(x, '^[\\x{{4e00}}-\\x{{9fff}}]+$'))) as int) han_terms, cast(len(list_filter(ts, lambda x: not regexp_matches(x, '^[\\x{{4e00}}-\\x{{9fff}}]+$'))) as int) other_terms,
{" or ".join(f"contains(text, '{a}')" for a, _ in _ALIAS)} alias_hit, coalesce(n, 0) candidates, n is null zero from t left join c using (query_id)""",
    "q_import_status": f"""with {_CURRENT}, {_INCOMING} select id, inc.hash, case when cur.hash is null then 'imported' when cur.hash = inc.hash then 'unchanged' else 'updated' end status from inc left join cur using (id)""",
    "q_import_invalid": f"""with p as (select case when {_BLANK.format("coalesce(source, '')")} then 'source is blank' when {_BLANK.format("coalesce(title, '')")} then 'title is blank' when {_BLANK.format("coalesce(license, '')")} then 'license is blank'
 when acquired is null then 'acquired is no date' when {_BLANK.format("coalesce(text, '')")} then 'text is blank' when splitter not in ('heading-lines-v1:20', 'heading-block-v2', 'heading-procedure-v3', 'pdf-pages-v1') then 'unknown splitter' when splitter = 'pdf-pages-v1' then 'the page splitter for a text' end problem from documents)
select problem, count(*) "rows" from p where problem is not null group by 1""",
    "q_delete": f"""with g as (select id from documents where text is not null and contains(url, '{EXCLUDED}')), c as (select id, any_value(active) active, any_value(doc_id) doc_id from chunks group by id)
select id, active and doc_id not in (select id from g) active from c""",
    "q_active_chunks": "select distinct id, kind from chunks where active",
    "q_read": "with c as (select id, any_value(doc_id) doc_id, any_value(section) section, any_value(start_line) start_line, any_value(end_line) end_line, any_value(active) active from chunks group by id) select c.id, c.doc_id, section, start_line, end_line, title, url source, hash as version from c join documents d on d.id = c.doc_id where active",
    "q_liveness": """with c as (select id, any_value(doc_id) doc_id, any_value(active) active, any_value(version) version from chunks group by id)
select c.id, d.hash as version, case when not active then 'retired' when c.version is distinct from d.hash then 'version_changed' else 'ok' end status from c left join documents d on d.id = c.doc_id""",
    "q_fingerprint": f"with {_ACTIVE}, z as (select sha256(id || ':' || sha256(coalesce(text, ''))) h from ch) select n chunks, x fingerprint from {_sums('z', chr(39) + chr(39) + ' || count(*) || ' + chr(39) + ':' + chr(39) + ' || ')}",
    "q_stale_index": "select count(*) filter (where kind <> 'body') > 0 stale from chunks where active",
    "q_manifest": "select url file, 'different' problem from documents where sha256(coalesce(text, '')) <> lower(hash)",
    "q_documents_list": "select id, url, title, license, cast(acquired as varchar) acquired, hash, splitter from documents where starts_with(url, 'https://')",
    "q_run_lookup": "with r as (select id, any_value(result) j from runs where result is not null group by id) select id, case when json_valid(j) then j ->> '$.mode' end as mode, case when json_valid(j) then cast(j ->> '$.limit' as int) end asked from r",
    "q_spans": f"with {_ACTIVE}, {_SAMPLE}, {_COVER} select case_id, cast(span_no as int) span_no, count(id) covering from cv group by 1, 2",
    "q_bundle_recall": f"{_EVAL} select case_id, cast(span_no as int) span_no, covering, retrieved, stale, whole, retrieved > 0 and not whole broken from b_b",
    "q_case_scores": f"{_EVAL} select * from b_s",
    "q_macro_recall": f"{_EVAL} select split, count(*) cases, count(recall) scored, round(avg(recall), 6) macro_recall, round(avg(tokens), 6) mean_tokens, cast(sum(metadata_chunks) as bigint) metadata_chunks, cast(sum(broken) as bigint) broken_bundles from b_s group by split",
    "q_eval_report": f"""{_EVAL}, a as (select distinct sha256(case_id || ':' || question || ':' || array_to_string(list_transform(evidence, lambda e: array_to_string(list_filter([e.source, cast(e.start_line as varchar), cast(e.end_line as varchar), array_to_string(coalesce(e.must_include, []), '~'), cast(e.required_together as varchar)], lambda y: y is not null), '|')), ';')) h from sm),
b as (select distinct sha256(id || ':' || hash || ':' || splitter) h from documents)
select count(*) cases, count(recall) scored, round(avg(recall), 6) macro_recall, round(avg(tokens), 6) mean_tokens, cast(sum(metadata_chunks) as bigint) metadata_chunks, cast(sum(broken) as bigint) broken_bundles, any_value(a.x) cases_hash, any_value(b.x) documents_hash, 'none' encoder, 'generation' not_run, false complete, 0 "cost" from b_s, {_sums('a')} a, {_sums('b')} b""",
    "q_compare_retrievers": f"""with {_ACTIVE}, {_DEV}, {_TERMS}, {_KEYWORD}, {_BM25}, {_COVER}, {_bundles('br', 'b')}, {_bundles('kr', 'k')}
select case_id, k_s.recall recall_keyword, b_s.recall recall_bm25, case when k_s.recall is null or b_s.recall is null then 'unscored' when b_s.recall > k_s.recall then 'gained' when b_s.recall < k_s.recall then 'lost' else 'same' end change_bm25, k_s.split from k_s left join b_s using (case_id)""",
    "q_degradation": f"""{_EVAL}, g as (select case_id, bool_or(stale) stale, bool_or(retrieved > 0 and not whole) broken, bool_and(whole) whole from b_b group by 1), n as (select distinct query_id case_id, 1 n from br where rank <= 5)
select case_id, case when stale then 'stale' when n is null then 'zero_candidates' when whole then 'none' when broken then 'partial' else 'ranked_out' end reason, split from sm join g using (case_id) left join n using (case_id)""",
    "q_freeze": f"""with {_SAMPLE}, a as (select distinct sha256(case_id || ':' || question || ':' || array_to_string(list_transform(evidence, lambda e: array_to_string(list_filter([e.source, cast(e.start_line as varchar), cast(e.end_line as varchar), array_to_string(coalesce(e.must_include, []), '~'), cast(e.required_together as varchar)], lambda y: y is not null), '|')), ';')) h from sm),
b as (select distinct sha256(id || ':' || hash || ':' || splitter) h from documents) select a.n cases, a.x cases_hash, b.n documents, b.x documents_hash from {_sums('a')} a, {_sums('b')} b""",
    "q_sample_overlap": "select distinct id from cases where split = 'development' and (substr(id, -1) in ('1', '2', '3') or id in (select id from cases where split = 'holdout'))",
    "q_supplement_rounds": f"""with {_ACTIVE}, {_DEV}, {_TERMS}, {_KEYWORD}, e as (select query_id, id, ceil(rank / 5.0) r from kr where rank <= 15), m as (select query_id, max(r) last, count(*) n from e group by 1)
select query_id, cast(least(3, coalesce(last, 0) + 1) as int) rounds, coalesce(n, 0) chunks, case when coalesce(last, 0) < 3 then 'no_new_evidence' else 'round_limit' end stop_reason from qs left join m using (query_id)""",
    "q_supplement_modes": f"with {_ACTIVE}, {_DEV}, {_TERMS}, {_KEYWORD}, {_MODES} select * from md",
    "q_stop_histogram": f"with {_ACTIVE}, {_DEV}, {_TERMS}, {_KEYWORD}, {_MODES} select mode, stop_reason, count(*) queries from md group by 1, 2",
    "q_bounded_rounds": f"""with {_ACTIVE}, {_DEV}, {_TERMS}, {_KEYWORD}, {_SIZES}
select query_id, case when s2 = s1 then 'no_new_evidence' when contains(lower(text), 'how') then 'sufficient' when contains(lower(text), 'limit') then 'timeout' when s3 = s2 then 'no_new_evidence' else 'round_limit' end stop_reason,
 case when s2 = s1 or contains(lower(text), 'how') then 1 else 2 end supplementary_rounds, cast(case when s2 = s1 or contains(lower(text), 'how') or contains(lower(text), 'limit') then s2 else s3 end as int) evidence from sz join qs using (query_id)""",
    "q_quote_verify": """with c as (select id, any_value(evidence) ev from cases group by id), e as (select id, unnest(ev) e, unnest(range(0, len(ev))) passage from c),
q as (select id, passage, e.source url, unnest(e.must_include) quote, unnest(range(0, len(e.must_include))) n from e)
select q.id, cast(passage as int) passage, cast(n as int) n, coalesce(contains(text, quote), false) verbatim from q left join documents using (url)""",
    "q_inactive_candidates": """with r as (select id, any_value(result) j from runs where result is not null group by id), c as (select distinct id run_id, unnest(from_json(json_extract(j, '$.candidates[*].id'), '["varchar"]')) id from r where json_valid(j))
select run_id, id from c where id not in (select id from chunks where active and kind = 'body')""",
    "q_validate": f"""with {_ANSWERS}, ct as (select answer_id, unnest(ev) e from an), x as (select answer_id, e.source id, e.must_include[1] quote, text from ct left join documents on url = e.source),
t as (select answer_id, count(*) n, bool_and(text is not null) known, bool_and(regexp_matches(quote, '\\S') and coalesce(contains(text, quote), false)) verbatim, count(*) = count(distinct (id, quote)) single from x group by 1)
select answer_id, status, case when not coalesce(known, true) then 'unknown citation' when not coalesce(verbatim, true) then 'quote is not verbatim' when not coalesce(single, true) then 'citation twice'
 when len(list_filter(ev, lambda e: coalesce(e.why, '') = '')) > 0 then 'claim without valid citation'
 when (status = 'insufficient' and (len(ev) > 0 or missing = '')) or (status <> 'insufficient' and len(ev) = 0) then 'claims do not fit the status' when status = 'partial' and missing = '' then 'partial without a gap' when status = 'grounded' and missing <> '' then 'grounded with a gap' end problem, coalesce(n, 0) quotes
from an left join t using (answer_id)""",
    "q_import_result": f"""with {_CURRENT}, {_INCOMING}, allv as (select id, hash, text from cur union select id, hash, text from inc),
k as (select a.id, a.hash, a.text, case when inc.hash is null then cur.hash else inc.hash end now from allv a left join inc using (id) left join cur on cur.id = a.id),
__BASE__ select doc_id, count(*) chunks, count(*) filter (where live) live, count(distinct hash) versions from base group by 1""",
    "q_ledger_guard": _guard(50_000, "opens"),
    "q_ledger_limit": _guard(400_000, "false"),
    "q_settlement_problems": "select event_id id, 'spent more than reserved' problem from events where event_type not in ('error', 'view') and event_id % 10 = 0",
    "q_coverage": f"""with {_ANSWERS}, qp as (select *, list_filter(list_transform(regexp_extract_all(question, '[^？?；;\\n]+[？?；;\\n]*|[？?；;\\n]+'), lambda p: regexp_replace(p, '^{_S}+|{_S}+$', '', 'g')), lambda p: p <> '') ps from an),
w as (select *, len(ev) n, list_transform(ps, lambda p, i: case when i = 1 then missing else 'no passage' end) gaps from qp),
x as (select *, case when len(ps) = 0 and n > 0 then 'a claim is not used' when len(ps) > 0 and n = 0 and missing = '' then 'neither claims nor gap' end problem, len(list_filter(gaps, lambda g: g <> '')) g from w)
select answer_id, problem, case when problem is not null then status when g > 0 and n > 0 then 'partial' when n > 0 then 'grounded' else 'insufficient' end status,
 case when problem is not null then missing else array_to_string(list_filter(list_transform(ps, lambda p, i: case when gaps[i] <> '' then p || '：' || gaps[i] end), lambda y: y is not null), chr(10)) end missing from x""",
    "q_unknown_sources": f"""with a as (select distinct case when doc_id % 9 = 0 then '  ' when doc_id % 11 = 0 then url || '/gone' else url end source from documents)
select source, case when trim(source) = '' then 'source is blank' else 'unknown source' end problem from a where trim(source) = '' or sha256(source) not in (select id from documents where text is not null)""",
    "q_migrate": "with c as (select id, any_value(doc_id) doc_id from chunks group by id) select c.id, coalesce(d.hash, '') as version, true active, 'body' kind, cast(null as int) page from c left join documents d on d.id = c.doc_id",
    "q_amend": """with r as (select id, any_value(result) j from runs group by id), o as (select id, j, coalesce(try_cast(j as json) is not null and json_type(try_cast(j as json)) = 'OBJECT', false) ok from r)
select id, case when ok then '50' end asked, case when ok then 'false' end checked, case when ok then '2' end a, case when ok then j ->> '$.mode' end as mode, case when ok then j ->> '$.run_id' end as run_id from o""",
    "q_amend_problems": """with r as (select id, any_value(result) j from runs group by id), o as (select id, coalesce(try_cast(j as json) is not null and json_type(try_cast(j as json)) = 'OBJECT', false) ok from r)
select case when id % 5 = 0 then -id else id end id, 1 "at", case when id % 5 = 0 then 'unknown run' when id % 3 = 0 then 'the amendment is no object' else 'the stored result is no object' end problem from o where id % 5 = 0 or id % 3 = 0 or not ok""",
    "q_cost": """with r as (select id, any_value(coalesce(length(query), 0)) i, any_value(coalesce(length(result), 0)) o from runs group by id)
select id, model, cast(ceil(i * input_rmb_per_million + o * output_rmb_per_million) as bigint) as "cost" from r join model_config on cast(regexp_extract(model, '-(\\d+)$', 1) as int) = 1 << cast(id % 6 + 1 as int)""",
    "q_ledger": """with c as (select case when event_type = 'error' then 'unknown' when event_type = 'view' then 'pending' else 'settled' end status, cast(round(value * 100) as bigint) a from events),
s as (select coalesce(sum(a) filter (where status = 'settled'), 0) spent, coalesce(sum(a) filter (where status <> 'settled'), 0) held, coalesce(bool_or(status <> 'settled'), false) blocked from c)
select 10000000::bigint limit_amount, cast(spent as bigint) spent, cast(held as bigint) held, cast(10000000 - spent - held as bigint) available, blocked from s""",
    "q_ledger_by_account": "select user_id account, cast(coalesce(sum(cast(round(value * 100) as bigint)) filter (where event_type not in ('error', 'view')), 0) as bigint) spent, cast(coalesce(sum(cast(round(value * 100) as bigint)) filter (where event_type in ('error', 'view')), 0) as bigint) held from events group by 1",
}
ORACLE_SQL["q_import_result"] = ORACLE_SQL["q_import_result"].replace("__BASE__", _BASE_OF_VERSIONS)
ORACLE_SQL["q_replay"] = ORACLE_SQL["q_validate"].replace("coalesce(n, 0) quotes", "coalesce(n, 0) quotes, len(ev) > 0 normalised")
