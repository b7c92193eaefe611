"""SQL for op13_patricia_trie: every prefix by itself, with sums over suffixes of each conversation."""

# CRC-32 of the decimal id: eight shifts a byte.
_CRC = """xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint)), lambda a, b:
  list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b)), 4294967295), 4294967295)"""

PATRICIA_SQL = f"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null
), convs as (select distinct conv_id, {_CRC} % 6 as h from t),
parts as (
  select c.conv_id, 0 as part, b.pos, b.role, b.text from convs c join t b on b.conv_id = c.conv_id - c.conv_id % 100 and b.pos <= c.h
  union all
  select t.conv_id, 1, t.pos, t.role, t.text from t join convs c on c.conv_id = t.conv_id and t.pos > c.h
), turns as (select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, sha256(concat(length(role), ':', role, text)) as h, length(text) as chars from parts),
member as (
  select conv_id, depth, string_agg(h, '') over w as k, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as up, chars
  from turns window w as (partition by conv_id order by depth)
  union all
  select conv_id, 0, '', null, 0 from convs
), node as (select k, depth, any_value(up) as up, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs from member group by k, depth),
kids as (select up, count(*) as n from node where depth > 0 group by up),
rep as (
  select m.conv_id, m.k, case when n.conv_id = m.conv_id then (n.n_convs - 1) * n.chars else 0 end as own,
    case when n.conv_id = m.conv_id and kids.n is null then 1 else 0 end as leaf, m.depth
  from member m join node n on n.k = m.k left join kids on kids.up = m.k
), tails as (select k, sum(own) over w as own, sum(leaf) over w as leaf from rep window w as (partition by conv_id order by depth desc)),
sums as (select k, sum(own) as saved, sum(leaf) as leaves from tails group by k),
last as (select conv_id, max(depth) as depth from member group by conv_id),
ends as (select m.k, sha256(string_agg(cast(m.conv_id as varchar), ',' order by m.conv_id)) as digest from member m join last l on l.conv_id = m.conv_id and l.depth = m.depth group by m.k)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, cast(coalesce(kids.n, 0) as bigint) as n_children,
  cast(s.leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, coalesce(e.digest, sha256('')) as ends_sha256
from node n left join node p on n.depth > 0 and p.k = n.up left join kids on kids.up = n.k join sums s on s.k = n.k left join ends e on e.k = n.k
"""
