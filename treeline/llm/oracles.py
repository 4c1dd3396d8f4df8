"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RUN = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(column: str) -> str:
    return f"regexp_extract_all({_LOWER.format(column)}, '{_WORD}')"


DECONTAMINATE = f"""
with it as (select cast(item_id as varchar) as id, {_words('text')} as w from benchmark where text is not null),
iw as (select distinct id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as k from it, unnest(range(1, len(w) - least(10, len(w)) + 2)) r(i) where len(w) > 0),
d as (select doc_id, row_number() over () as rid, {_words("coalesce(text, '')")} as w from documents),
dw as (select rid, p, n, array_to_string(w[p:p + n - 1], ' ') as k from d, (select distinct n from iw), unnest(range(1, len(w) - n + 2)) r(p)),
m as (select rid, p, n, id from dw join iw using (n, k)),
hit as (select rid, count(distinct p + o) as h from m, unnest(range(0, n)) r(o) group by rid),
found as (select rid, count(distinct id) as c, sha256(string_agg(distinct id, ',' order by id)) as s from m group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(h, 0) as n_hit, coalesce(c, 0) as n_items, coalesce(s, sha256('')) as items_sha256, h is not null as contaminated,
case when len(w) > 0 then coalesce(h, 0) / len(w) else 0.0 end as coverage from d left join hit using (rid) left join found using (rid)"""

WARC = """
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages), f as (select t, min(page_id) as first from p group by t)
select page_id, cast(octet_length(encode(p.t)) as bigint) as payload_bytes,
array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast(concat('0x', substr(h, 1 + 5 * (j // 4), 5)) as int) >> (15 - 5 * (j % 4))) & 31), 1)), '') as payload_digest,
case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from p join f on p.t = f.t"""

QUALITY = f"""
with d as (select doc_id, source, row_number() over () as rid, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_RUN}') as w from documents),
g as (select rid, p, concat(w[p], ' ', w[p + 1], ' ', w[p + 2]) as k from d, unnest(range(1, len(w) - 1)) r(p)),
rep as (select rid, count(distinct p + o) as c from (select rid, p from (select rid, p, count(*) over (partition by rid, k) as n from g) where n > 1), unnest(range(0, 3)) r(o) group by rid),
b as (select doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_RUN}')) as l, coalesce(c, 0) as n_repeat_words from d left join rep using (rid)),
q as (select doc_id, source, n_words, word_chars, n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b),
h as (select source, count(*)::double as n, (count(*) filter (base_failed))::double as f from q where source is not null group by source),
m as (select count(*) as k, sum(n) as n, sum(n * n) as nn, sum(f) as f, sum(f * f / n) as ff, sum(f) / sum(n) as m from h),
r as (select m, case when m * (1 - m) > 0 and n - nn / n - (k - 1) > 0 then ((ff - m * f) / nullif(m * (1 - m), 0) - (k - 1)) / nullif(n - nn / n - (k - 1), 0) end as r from m),
s as (select m, case when r is null then 2.0 when r <= 1 / (1 + 1e6) then 1e6 else greatest(1 / r - 1, 1) end as s from r),
v as (select source, (f + m * s) / (n + s) > 0.5 as bad from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(bad, false) as kept from q left join v using (source)"""

REPEATS = """
with d as (select doc_id, row_number() over () as rid, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select rid, p, md5(substr(h, 2 * p + 1, 400)) as k from d, unnest(range(0, n - 199)) r(p)),
c as (select rid, p from (select rid, p, count(*) over (partition by k) as c from w) where c > 1),
s as (select rid, p, case when p <= lag(p) over (partition by rid order by p) + 200 then 0 else 1 end as new from c),
g as (select rid, p, sum(new) over (partition by rid order by p) as g from s), sp as (select rid, min(p) as lo, max(p) + 200 as hi from g group by rid, g),
nx as (select rid, lo, hi, lead(lo) over (partition by rid order by lo) as nxt from sp),
k as (select rid, count(*) as spans, sum(hi - lo) as removed, concat(substr(any_value(h), 1, 2 * min(lo)), string_agg(substr(h, 2 * hi + 1, 2 * (coalesce(nxt, n) - hi)), '' order by lo)) as kept from nx join d using (rid) group by rid)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join k using (rid)"""

VARIANTS = r"""
with recursive crc(t) as (select list(c order by i) from (select i, list_reduce(range(0, 8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) as c from range(0, 256) r(i))),
r as (select doc_id, run, count(*) as k from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents) group by doc_id, run having length(run) >= 5),
b as (select run, k, flatten(list_transform(string_split(concat(coalesce(cast(doc_id as varchar), ''), ':', run), ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)) as b from r),
h as (select run, k, xor(list_reduce(b, lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8), 4294967295::bigint), 4294967295) as h from b, crc),
o as (select k, case when h % 97 = 0 then concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) else run end as word from h),
w as (select word, cast(sum(k) as bigint) as n from o where length(word) >= 5 group by word having sum(k) >= 3),
v as (select word, n, concat(substr(word, 1, i - 1), '_', substr(word, i + 1)) as a, concat(substr(word, 1, i - 1), substr(word, i + 1)) as d from w, unnest(range(1, length(word) + 1)) u(i)),
p as (select a.word, b.word as near, b.n as near_n from v a join v b on a.a = b.a and a.word <> b.word union select v.word, w.word, w.n from v join w on w.word = v.d union select w.word, v.word, v.n from v join w on w.word = v.d),
f as (select word, count(*) as n_near, min(struct_pack(n := -near_n, form := near)) as best from p group by word),
g as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -best.n >= 2 * w.n then best.form end as form, case when -best.n >= 2 * w.n then -best.n end as form_n from w left join f on f.word = w.word),
t as (select word, word as root, form as nxt from g union all select t.word, t.nxt, g.form from t join g on g.word = t.nxt where t.nxt is not null)
select g.word, g.form, t.root, g.n, g.n_near, g.form_n from g join t on t.word = g.word and t.nxt is null"""

NEGATIVES = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where label is not null and vec_id is not null and embedding is not null and list_count(embedding) = len(embedding) and list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.v::double[], b.v::double[]) as bigint) as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
q as (select p.*, s.id as negative_id, s.score as negative_score, cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as int) as rank from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from q where rank <= 3"""

ORACLE_SQL = {"op8_repeats": REPEATS, "op1_decontaminate": DECONTAMINATE, "op2_warc": WARC, "op10_quality_rules": QUALITY, "op12_variants": VARIANTS, "op13_negatives": NEGATIVES}
