"""SQL of the training-data queries that SQL can express, written from their contracts."""

from __future__ import annotations


def centroid_sql(clusters: int = 16, rounds: int = 3) -> str:
    def assigned(k: int) -> str:
        """Rows of ``kept`` with the nearest centroid of c{k}."""
        return f"""near{k} as (
  select row_id, vec_id, x.cluster, x.distance from (
    select k.row_id, k.vec_id, min(struct_pack(distance := list_sum(list_transform(list_zip(k.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, cluster := c.cluster)) x
    from kept k, c{k} c group by 1, 2))"""

    def moved(k: int) -> str:
        return f"""c{k + 1} as (
  select cluster, coalesce(m.q, c.q) q from c{k} c left join (
    select cluster, list(v order by d) q from (
      select cluster, d, (s - ((s % n) + n) % n) // n v from (
        select cluster, d, sum(v)::hugeint s, count(*)::hugeint n
        from (select n.cluster, unnest(k.q) v, unnest(range(1, 65)) d from near{k} n join kept k using (row_id)) group by 1, 2)) group by 1
  ) m using (cluster))"""

    steps = ",\n".join(f"{assigned(k)},\n{moved(k)}" for k in range(rounds))
    return f"""
with valid as (
  select row_number() over () row_id, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = 64),
kept as (
  select row_id, vec_id, list_transform(q, lambda x: x::bigint::hugeint) q from valid where len(list_filter(q, lambda x: abs(x) >= 134217728)) = 0),
c0 as (
  select (row_number() over (order by h, q) - 1)::int cluster, q from (
    select sha256('1:' || vec_id) h, q from kept where vec_id is not null order by 1, 2 limit {clusters})),
{steps},
{assigned(rounds)}
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint cluster_inertia, (sum(distance) over ())::bigint inertia,
  sha256(array_to_string(c.q, ',')) centroid_sha256
from near{rounds} join c{rounds} c using (cluster)"""


#: crc32 bit by bit, since DuckDB has no such function.
CRC32_STEP = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"

TRIE_SQL = f"""
with numbered as (
  select conv_id, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by conv_id order by turn nulls first, role, text) n
  from conversations where conv_id is not null),
convs as (
  select conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
    lambda c, b: {CRC32_STEP}), 4294967295) % 6 h from (select distinct conv_id from numbered)),
taken as (
  select c.conv_id, n.n, n.role, n.text, 0 own from convs c join numbered n on n.conv_id = c.conv_id - c.conv_id % 100 and n.n <= c.h
  union all
  select c.conv_id, n.n, n.role, n.text, 1 from convs c join numbered n on n.conv_id = c.conv_id and n.n > c.h),
placed as (select conv_id, row_number() over (partition by conv_id order by own, n) d, role, text from taken),
prefixes as (
  select conv_id, d, length(text) chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by d)) key from placed
  union all select conv_id, 0, 0, '' from convs),
nodes as (select key, d depth, min(conv_id) conv_id, count(*) n_convs, any_value(chars) chars from prefixes group by 1, 2),
linked as (
  select n.*, p.key parent_key from nodes n left join prefixes p on p.conv_id = n.conv_id and p.d = n.depth - 1),
children as (select parent_key key, count(*) n_children from linked where parent_key is not null group by 1),
full_nodes as (
  select l.*, coalesce(c.n_children, 0) n_children, p.conv_id parent_conv_id from linked l left join children c on c.key = l.key left join nodes p on p.key = l.parent_key),
sums as (
  select a.key, sum((f.n_children = 0)::int)::bigint n_leaves, sum((f.n_convs - 1) * f.chars)::bigint saved_tokens
  from full_nodes f join prefixes a on a.conv_id = f.conv_id and a.d <= f.depth group by 1),
lasts as (select arg_max(key, d) key, conv_id from prefixes group by conv_id),
ends as (select key, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) ends_sha256 from lasts group by 1)
select f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) ends_sha256
from full_nodes f join sums s using (key) left join ends e using (key)"""


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

WINDOW_SQL = f"""
with docs as (select row_number() over () r, doc_id, {WORDS} w from documents),
items as (select item_id, {WORDS} w from benchmark where len({WORDS}) > 0),
windows as (
  select distinct item_id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from items)),
lengths as (select distinct n from windows),
met as (
  select distinct d.r, d.i, d.n, d.s from (
    select r, n, i, array_to_string(w[i : i + n - 1], ' ') s from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from docs, lengths)) d
  where exists (select 1 from windows x where x.n = d.n and x.s = d.s)),
hits as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from met) group by 1),
listed as (select distinct m.r, x.item_id::varchar item from met m join windows x using (n, s) where x.item_id is not null),
named as (select r, count(*) n_items, sha256(string_agg(item, ',' order by item)) items_sha256 from listed group by 1)
select d.doc_id, len(d.w)::bigint n_words, coalesce(h.n_hit, 0)::bigint n_hit, coalesce(n.n_items, 0)::bigint n_items,
  coalesce(n.items_sha256, sha256('')) items_sha256, h.n_hit is not null contaminated
from docs d left join hits h using (r) left join named n using (r)"""
