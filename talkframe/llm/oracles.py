"""SQL that DuckDB runs on the same tables, for the queries that SQL can express."""

from __future__ import annotations

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACE = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
with d as (select doc_id, regexp_extract_all({_FOLDED}, {_ALNUM}) as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_FOLDED}, {_ALNUM}) as w from benchmark),
bw as (select distinct item, k, array_to_string(w[i + 1:i + k], ' ') as win from
  (select item, w, least(13, len(w)) as k, unnest(range(greatest(1, len(w) - 12))) as i from b where len(w) > 0) x),
dw as (select doc_id, i, k, array_to_string(w[i + 1:i + k], ' ') as win from
  (select doc_id, w, k, unnest(range(len(w) - k + 1)) as i from d cross join (select distinct k from bw) s where len(w) >= k) x),
hit as (select doc_id, i, k, item from dw join bw using (win, k)),
pos as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + k)) as p from hit) x group by 1),
its as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from hit) x group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(pos.n, 0) as bigint) as n_hit, cast(coalesce(its.n, 0) as bigint) as n_items,
 sha256(coalesce(its.s, '')) as items_sha256, coalesce(pos.n, 0) > 0 and 20 * coalesce(pos.n, 0) >= len(w) as contaminated
from d left join pos using (doc_id) left join its using (doc_id)"""

OP4 = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE}) as w from documents),
dw as (select doc_id, i, md5(array_to_string(w[i + 1:i + 35], ' ')) as win from
  (select doc_id, w, unnest(range(len(w) - 34)) as i from d where len(w) >= 35) x),
twice as (select win from dw group by 1 having count(*) > 1),
pos as (select distinct doc_id, unnest(range(i, i + 35)) as p from dw join twice using (win)),
words as (select doc_id, unnest(w) as word, unnest(range(len(w))) as p from d where len(w) > 0),
kept as (select doc_id, string_agg(word, ' ' order by p) as s, count(*) as n from words anti join pos using (doc_id, p) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(kept.s, '')) as kept_sha256
from d left join kept using (doc_id)"""



def _linked(shingle: int, percent: int) -> str:
    """doc_id, n_shingles and component_id of documents linked by shared shingles."""
    return f"""
with recursive d as (select doc_id, regexp_extract_all({_FOLDED}, {_SPACE}) as w from documents),
sh as (select distinct doc_id, array_to_string(w[i + 1:i + {shingle}], ' ') as s from
  (select doc_id, w, unnest(range(greatest(1, len(w) - {shingle - 1}))) as i from d where len(w) > 0) x),
sz as (select doc_id, count(*) as n from sh group by 1),
e as (select a.doc_id as a, b.doc_id as b from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id
  join sz x on x.doc_id = a.doc_id join sz y on y.doc_id = b.doc_id group by 1, 2, x.n, y.n
  having 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
reach as (select doc_id as a, doc_id as b from d union select reach.a, e.b from reach join e on e.a = reach.b),
c as (select a as doc_id, min(b) as component_id from reach group by 1)
select doc_id, cast(coalesce(sz.n, 0) as bigint) as n_shingles, component_id from c left join sz using (doc_id)"""


OP5 = f"select *, doc_id = component_id as kept from ({_linked(5, 75)}) linked"
OP12 = _linked(3, 90)


def _manifest(levels: int = 6) -> str:
    """Trees of at most 16 ** levels leaves, one common table expression per level; ``_path`` lists (left, right) from the leaf up."""
    def field(c: str) -> str:
        return f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"

    def grown(name: str) -> list[str]:
        out = []
        for k in range(levels):
            out.append(f"{name}{k + 1} as (select tree, pos // 16 as pos, (any_value(n) + 15) // 16 as n, sha256(string_agg(h, '' order by pos)) as h "
                       f"from {name}{k} where n > 1 group by tree, pos // 16)")
            out.append(f"{name}r{k} as (select tree, pos // 16 as up, list(h order by pos) as run from {name}{k} where n > 1 group by tree, pos // 16)")
        return out

    def path(name: str, tree: str, pos: str) -> tuple[str, str]:
        runs = " ".join(f"left join {name}r{k} as {name}p{k} on {name}p{k}.tree = {tree} and {name}p{k}.up = {pos} // {16 ** (k + 1)}" for k in range(levels))
        steps = []
        for k in range(levels):
            slot = f"({pos} // {16 ** k}) % 16"
            run = f"{name}p{k}.run"
            steps.append(f"case when {run} is null then [] else [{{'l': array_to_string({run}[1:{slot}], ''), "
                         f"'r': array_to_string({run}[{slot} + 2:], '')}}] end")
        return runs, " || ".join(steps)

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    # one element per byte of the decimal id, each followed by eight shifts of the register
    bits = "flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: [cast(ord(ch) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = (f"xor(list_reduce({bits}, lambda acc, x: case when x >= 0 then xor(acc, x) else "
           "xor(acc >> 1, case when acc % 2 = 1 then 3988292384 else 0 end) end, cast(4294967295 as bigint)), 4294967295)")
    leaf_runs, leaf_path = path("d", "s.tree", "s.pos")
    top_runs, top_path = path("t", "'all'", "s.place")
    return f"""
with rows as (select doc_id, source, coalesce('1' || source, '0') as tree, sha256({head} || {field('text')}) as h,
  case when {crc} % 5 = 0 then sha256({head} || {field(low)}) end as changed from documents),
s0 as (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by tree) as n from rows),
d0 as (select tree, pos, n, h from s0), {", ".join(grown("d"))},
subs as (select tree as of, h from ({" union all ".join(f"select tree, h from d{k} where n = 1" for k in range(levels + 1))}) x),
t0 as (select 'all' as tree, of, h, row_number() over (order by encode(of)) - 1 as pos, count(*) over () as n from subs), {", ".join(grown("t"))},
top as ({" union all ".join(f"select h as root from t{k} where n = 1" for k in range(levels + 1))}),
s as (select s0.*, t0.pos as place, t0.h as subroot from s0 join t0 on t0.of = s0.tree),
p as (select s.doc_id, s.h as leaf, s.changed, s.subroot, {leaf_path} || {top_path} as path from s {leaf_runs} {top_runs}),
f as (select *, (select root from top) as root, list_reduce(list_concat([{{'l': coalesce(changed, leaf), 'r': ''}}], path),
  lambda acc, x: {{'l': sha256(x.l || acc.l || x.r), 'r': ''}}).l as folded_root from p)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) as proof_sha256, folded_root,
 folded_root = root as verified from f"""


OP11 = _manifest()

OP13 = f"""
with recursive t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_SPACE}) as w from documents),
m as (select *, min(doc_id) over (partition by t) as head from t),
l as (select doc_id, max(cast(quality = 1 as int)) as g, max(cast(toxic = 1 as int)) as x from labels group by 1),
r as (select part, coalesce(g, 0) as g, coalesce(x, 0) as x, cast(len(w) < 100 as int) + 2 * cast(100 * len(list_distinct(w)) < 80 * len(w) as int)
  + 4 * cast(100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) as int)
  + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * coalesce(cast(head < m.doc_id as int), 0) as bad from m left join l on l.doc_id = m.doc_id),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as b),
o as (select f as filter_order, 0 as before, b as bit, f as f, 1 as step from f union all
  select o.filter_order || f.f, o.before + o.bit, f.b, f.f, o.step + 1 from o join f on (o.before + o.bit) & f.b = 0),
whole as (select filter_order from o where step = 5),
steps as (select w.filter_order, o.step, o.before, o.bit, o.f from whole w join o on starts_with(w.filter_order, o.filter_order)),
seen as (select distinct before, bit from steps),
c as (select part, before, bit, sum(cast(bad & (before | bit) = 0 as int)) as kept, sum(cast(bad & before = 0 and bad & bit > 0 as int)) as removed,
  sum(cast(bad & before > 0 and bad & bit > 0 as int)) as redundant, sum(cast(bad = bit as int)) as unique_fails,
  sum(case when bad & before = 0 and bad & bit > 0 then g else 0 end) as good_lost,
  sum(case when bad & before = 0 and bad & bit > 0 then x else 0 end) as toxic_lost from r cross join seen group by 1, 2, 3),
j as (select steps.*, c.* exclude (before, bit), sum(removed) over (partition by part, f) as shapley from steps join c using (before, bit))
select part, filter_order, step, {", ".join(f"cast({c} as bigint) as {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))} from j"""
