"""SQL for op11_merkle_manifest: trees as lists, level by level, in recursive queries."""

# A field as it is hashed: byte count, colon, value; "-" for null.
_FIELD = "coalesce(concat(strlen(cast({0} as varchar)), ':', cast({0} as varchar)), '-')"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


# CRC-32 of the decimal id: eight shifts a byte.
_CRC = """list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)), lambda a, b:
  list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b)), 4294967295)"""

_RUN = "list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], '')))"
_FOLD = "sha256(array_to_string(list_transform(range(pos // 3 * 3, least(pos // 3 * 3 + 3, len(nodes))), lambda i: case when i = pos then digest else nodes[i + 1] end), ''))"

MERKLE_SQL = f"""
with recursive leaves as (
  select row_number() over () as rid, doc_id, source, {_leaf("text")} as leaf,
    case when xor({_CRC}, 4294967295) % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as altered
  from documents
), d as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from leaves),
own as (
  select source, 0 as lvl, list(leaf order by pos) as nodes from d group by source
  union all
  select source, lvl + 1, {_RUN} from own where len(nodes) > 1
), subroots as (select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as pos from own where len(nodes) = 1),
top as (
  select 0 as lvl, list(subroot order by pos) as nodes from subroots
  union all
  select lvl + 1, {_RUN} from top where len(nodes) > 1
), root as (select nodes[1] as root from top where len(nodes) = 1),
own_nodes as (select source, lvl, generate_subscripts(nodes, 1) - 1 as idx, unnest(nodes) as digest from own where len(nodes) > 1),
top_nodes as (select lvl, generate_subscripts(nodes, 1) - 1 as idx, unnest(nodes) as digest from top where len(nodes) > 1),
up as (
  select d.rid, n.lvl, n.idx, n.digest from d join own_nodes n on n.source is not distinct from d.source
    and n.idx // 3 = d.pos // cast(3 ** (n.lvl + 1) as bigint) and n.idx <> d.pos // cast(3 ** n.lvl as bigint)
  union all
  select d.rid, 1000 + n.lvl, n.idx, n.digest from d join subroots s on s.source is not distinct from d.source
    join top_nodes n on n.idx // 3 = s.pos // cast(3 ** (n.lvl + 1) as bigint) and n.idx <> s.pos // cast(3 ** n.lvl as bigint)
), proofs as (select rid, sha256(string_agg(digest, '' order by lvl, idx)) as proof_sha256 from up group by rid),
fold as (
  select rid, source, 0 as lvl, pos, altered as digest from d
  union all
  select f.rid, f.source, f.lvl + 1, f.pos // 3, {_FOLD} from fold f join own o on o.source is not distinct from f.source and o.lvl = f.lvl where len(nodes) > 1
), folded as (select rid, source, arg_max(digest, lvl) as digest from fold group by rid, source),
fold_top as (
  select f.rid, 0 as lvl, s.pos, f.digest from folded f join subroots s on s.source is not distinct from f.source
  union all
  select f.rid, f.lvl + 1, f.pos // 3, {_FOLD} from fold_top f join top t on t.lvl = f.lvl where len(nodes) > 1
), ends as (select rid, arg_max(digest, lvl) as folded_root from fold_top group by rid)
select d.doc_id, d.leaf, s.subroot, r.root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = r.root as verified
from d join subroots s on s.source is not distinct from d.source join ends e on e.rid = d.rid cross join root r left join proofs p on p.rid = d.rid
"""
