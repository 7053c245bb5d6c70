"""SQL of the operators that SQL can express, for DuckDB."""

OP9_WARC_TRANSACTIONS = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
       case when first_id is not null and first_id != page_id then 'revisit' else 'response' end as record_type,
       case when first_id != page_id then first_id end as refers_to
from d left join f using (payload_digest)
"""

OP5_BOTTOM_K_DEDUP = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (
  select distinct doc_id, unnest(case when len(words) = 0 then []::varchar[] when len(words) < 5 then [array_to_string(words, ' ')]
    else [array_to_string(words[i:i+4], ' ') for i in range(1, len(words) - 3)] end) as shingle from w),
n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b using (shingle) where a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 85 * (a.n + b.n - i)),
both_ways as (select x, y from links union all select y, x from links),
reach(node, root) as (select doc_id, doc_id from documents union select y, root from reach join both_ways on x = node),
c as (select node, min(root) as component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join n using (doc_id) join c on c.node = d.doc_id
"""

OP3_HNSW_DEDUP = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings where embedding is not null),
ok as (select * from v where list_count(e) = len(e) and list_bool_and([isfinite(x) for x in e]) and list_bool_or([x != 0 for x in e])),
links as (select a.vec_id as x, b.vec_id as y from ok a join ok b on a.vec_id != b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
n as (select x, count(*) as n from links group by 1),
reach(node, root) as (select vec_id, vec_id from embeddings union select y, root from reach join links on x = node),
c as (select node, min(root) as component_id from reach group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings left join n on x = vec_id join c on node = vec_id
"""

OP11_BAG_SEARCH = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
g as (select count(*) as texts, sum(len(w))::bigint as total from d where len(w) > 0),
t as (select doc_id, n, term, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as term from d) group by 1, 2, 3),
f as (select term, count(*) as df from t where term in (select term from q) group by 1),
s as (
  select item_id, doc_id, sum(floor(1000 * ln((2 * texts + 2)::double / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * texts) // total))))::bigint as score
  from q join t using (term) join f using (term) cross join g group by 1, 2)
select item_id, rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10
"""


def _codes(rounds: int = 4) -> str:
    """The rounds of the codebooks one after the other: distances as |x|^2 - 2 x e + |e|^2 in whole doubles, the nearest entry as the least distance * 256 + entry."""
    step = """, near{i} as materialized (
  select p.vec_id, part, min((xx - 2 * list_dot_product(x::double[], c::double[]) + list_dot_product(c::double[], c::double[]))::bigint * 256 + entry) as best
  from parts p join book{i} using (part) group by 1, 2)"""
    update = """, book{j} as materialized (
  select part, entry, coalesce(moved, c) as c from book{i} left join (
    select part, entry, list(((total - ((total % n + n) % n)) // n)::bigint order by pos) as moved from (
      select part, (best % 256)::int as entry, pos, sum(x[pos])::hugeint as total, count(*) as n
      from near{i} join parts using (vec_id, part) cross join range(1, {width}) r(pos) where pos <= len(x) group by 1, 2, 3)
    group by 1, 2) using (part, entry))"""
    sql = """
with ints as (
  select vec_id, label, [floor(1024 * a::double)::bigint for a in embedding] as z from embeddings
  where embedding is not null and list_count(embedding) = len(embedding) and coalesce(list_bool_and([isfinite(a) for a in embedding]), true)),
parts as materialized (
  select vec_id, label, part, x, list_dot_product(x::double[], x::double[]) as xx from (
    select vec_id, label, part::int as part, z[part * len(z) // 4 + 1:(part + 1) * len(z) // 4] as x from ints cross join range(4) r(part))),
book0 as materialized (
  select part, (row_number() over (partition by part order by vec_id) - 1)::int as entry, x as c from parts
  where vec_id in (select vec_id from ints order by vec_id limit 256))"""
    for i in range(rounds):
        sql += step.format(i=i) + update.format(i=i, j=i + 1, width=4097)
    return sql + step.format(i=rounds) + f""", made as (
  select vec_id, string_agg(printf('%02x', (best % 256)::int), '' order by part) as code, sum(best // 256)::bigint as error from near{rounds} group by 1),
sums as (select label, sum(error)::bigint as label_error from made join ints using (vec_id) group by 1),
hash as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, label_error, codebooks_sha256
from made join ints using (vec_id) join sums on ints.label is not distinct from sums.label cross join hash
"""


OP13_HADAMARD_CODES = _codes()
