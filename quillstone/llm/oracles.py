"""DuckDB SQL for the corpus queries that SQL can express."""

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 w as (select r, h, unnest(range(0, greatest(length(h) // 2 - 399, 0))) as i from d),
 x as (select r, i, hash(substr(h, 2 * i + 1, 800)) as k from w),
 g as (select r, i from (select r, i, count(*) over (partition by k) as c from x) where c > 1),
 s as (select r, i, case when i <= lag(i) over (partition by r order by i) + 400 then 0 else 1 end as b from g),
 t as (select r, i, sum(b) over (partition by r order by i) as grp from s),
 u as (select r, min(i) as a, max(i) + 400 as e from t group by r, grp),
 n as (select r, sum(e - a)::bigint as n_removed, count(*) as n_spans from u group by r),
 k as (select r, e as a, lead(a) over (partition by r order by a) as e from u union all select r, 0, min(a) from u group by r),
 p as (select k.r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(e, length(h) // 2) - a)), '' order by a) as kept from k join d using (r) group by k.r)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256, coalesce(n_removed, 0) / greatest(1, length(h) // 2) as removed_share, coalesce(n_removed, 0) > 0 as has_repeats
from d left join n using (r) left join p using (r)"""

WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2 = f"""
with d as (select row_number() over () as r, doc_id, {WORDS.format(LOWER.format('text'))} as w from documents),
 b as (select cast(item_id as varchar) as item, {WORDS.format(LOWER.format('text'))} as w from benchmark where item_id is not null),
 p as (select distinct item, list_aggregate(w[i:i + 9], 'string_agg', ' ') as s, least(len(w), 10) as n from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
 l as (select distinct n from p),
 q as (select r, i, l.n, list_aggregate(w[i:i + l.n - 1], 'string_agg', ' ') as s from (select r, w, unnest(range(1, len(w) + 1)) as i from d) x, l where i + l.n - 1 <= len(w)),
 m as (select r, i, q.n, item from q join p on p.s = q.s and p.n = q.n),
 hit as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from m) group by r),
 own as (select r, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct r, item from m) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join own using (r)"""

OP3 = """
with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 s as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda x, y: x + y) as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
 r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 20"""

_STEP = "select id, n, key, m, {0} as x from ({1})"


def _permutation(rows: str) -> str:
    """The permutation of mixing.permuted as nested selects; rows: id, n (blocks), key, m (part), x."""
    a = "case when {0} % 1048583 <> 0 then 1048583 else 2097169 end"
    for salt in (17 * 1009, 17 * 2003):
        rows = _STEP.format(f"(x * {a.format('n')} + key * 7919 + {salt}) % n", rows)
        rows = _STEP.format(f"case when x < m then (x * {a.format('m')} + key * 7919 + {salt}) % m else x end", rows)
        rows = _STEP.format("n - 1 - x", rows)
    return rows


OP7 = f"""
with d as (select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents),
 t0 as (select source, sum(size) as source_size from d group by source),
 t1 as (select *, row_number() over (order by source nulls last) - 1 as rank from t0),
 t2 as (select *, [5.0, 2.0, 1.0][(rank % 3 + 1)::int]::double as w from t1),
 t3 as (select *, 2 * source_size / w as ratio from t2),
 t4 as (select *, row_number() over (order by ratio, rank) as nth, (1.5::double * sum(source_size) over () - coalesce(sum(2 * source_size) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by ratio, rank rows between current row and unbounded following) as level from t3),
 t5 as (select *, min_by(level, case when level <= ratio then nth end) over () as lv from t4),
 t6 as (select source, source_size, rank, least((2 * source_size)::double, w * lv) as target, ceil(source_size / 128.0)::bigint as n from t5),
 t as (select *, case when source_size > 0 then least(floor(target * n / source_size + 0.5), 2 * n)::bigint else 0 end as quota from t6),
 j as (select rank, n, j // n as epoch, j % n as id from (select rank, n, unnest(range(0, quota)) as j from t where n > 0)),
 k as (select rank, n, epoch, id, rank * 2 + epoch as key, greatest(1, floor(n * 5 / 8))::bigint as m, id as x from j),
 z as (select key, x from ({_permutation('select id, n, key, m, x from k')})),
 c as (select key // 2 as rank, x as block, count(*) as copies from z group by all),
 s as (select d.*, t.rank, t.source_size, t.target, coalesce(sum(size) over (partition by t.rank order by md5(cast(doc_id as varchar)), doc_id, size rows between unbounded preceding and 1 preceding), 0) as start from d join t on t.source is not distinct from d.source),
 p as (select r, rank, block, least(start + size, (block + 1) * 128) - greatest(start, block * 128) as words from (select r, rank, start, size, unnest(range((start // 128)::bigint, ((start + size - 1) // 128)::bigint + 1)) as block from s where size > 0)),
 o as (select r, sum(words * copies)::bigint as taken from p join c using (rank, block) group by r)
select doc_id, size, source_size::bigint as source_size, target, coalesce(taken, 0) as taken from s left join o using (r)"""

OP8 = f"""
with recursive d as (select doc_id, regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') as w from documents),
 s as (select distinct doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') as t from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
 n as (select doc_id, count(*) as n from s group by doc_id),
 c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by all),
 l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
 e as (select a, b from l union all select b, a from l),
 r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on e.a = r.b),
 m as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id from d join m using (doc_id) left join n using (doc_id)"""

OP13 = f"""
with d as (select coalesce(lang, 'und') as lang, {LOWER.format('text')} as t from documents),
 p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d)),
 g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as g, count(*) as f from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p, (values (1), (2), (3), (4)) s(k) where len(w) >= k) group by all),
 n as (select lang, sum(f) as n from g where k = 1 group by lang),
 c as (select lang, k as size, g as phrase, string_split(g, ' ') as w, f as a from g where k > 1 and f >= 30),
 x as (select c.lang, c.phrase, c.a, c.k, l.f as l, r.f as r, (2000000::hugeint * c.a) // (l.f::hugeint + r.f) as s from (select *, unnest(range(1, size)) as k from c) c join g l on l.lang = c.lang and l.k = c.k and l.g = array_to_string(c.w[1:c.k], ' ') join g r on r.lang = c.lang and r.k = c.size - c.k and r.g = array_to_string(c.w[c.k + 1:], ' ')),
 b as (select * from (select *, row_number() over (partition by lang, phrase order by s, k) as nth from x) where nth = 1),
 o as (select lang, array_to_string(w[i:i + j - 1], ' ') as phrase, max(a) as most from (select *, unnest(range(1, size - j + 2)) as i from (select *, unnest(range(2, size)) as j from c)) group by all),
 f as (select b.*, row_number() over (partition by b.lang order by s desc, a desc, b.phrase) as rank from b left join o on o.lang = b.lang and o.phrase = b.phrase where most is null or 100::hugeint * most < 80::hugeint * a)
select lang, rank, phrase, a, l, r, n::bigint as n, s::bigint as score from f join n using (lang) where rank <= 2000"""

ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": OP1, "op2_decontaminate": OP2, "op3_nearest": OP3, "op7_mixing": OP7, "op8_jaccard": OP8, "op13_collocations": OP13}
