"""Check SQL of the operators on conversations, for tables whose turns are unique."""

from __future__ import annotations

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def crc32(text: str) -> str:
    """CRC-32 of an ASCII string expression, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda y: cast(ascii(y) as bigint))"
    bit = f"xor(x >> 1, {POLYNOMIAL} * (x & 1))"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {bit})"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {codes}), lambda c, b: {byte}), 4294967295)"


TRIE = f"""with own as (
  select conv_id as c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first, role, text) as l
  from conversations where conv_id is not null group by conv_id),
hashed as (select *, c - c % 100 as base, {crc32("cast(c as varchar)")} % 6 as h from own),
rebuilt as (select a.c, list_concat(coalesce(list_slice(b.l, 1, a.h), []), list_slice(a.l, a.h + 1, len(a.l))) as p
  from hashed a left join own b on b.c = a.base),
paths as (select c, d, len(p) as whole, list_slice(p, 1, d) as prefix from rebuilt, unnest(range(0, len(p) + 1)) as u(d)),
nodes as (select prefix, d, min(c) as owner, count(*) as n, coalesce(sum(length(prefix[d].t)) / count(*), 0) as chars,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (d = whole), '')) as ends
  from paths group by prefix, d),
placed as (select p.c, n.owner, n.d, n.n, n.chars from paths p join nodes n on n.prefix = p.prefix and n.d = p.d),
kids as (select a.owner, a.d, count(distinct b.owner) as n_children, any_value(a.n) as n
  from placed a left join placed b on b.c = a.c and b.d = a.d + 1 group by a.owner, a.d),
pairs as (select distinct a.owner, a.d, b.owner as o2, b.d as d2, (b.n - 1) * b.chars as saved from placed a join placed b on b.c = a.c and b.d >= a.d),
sums as (select p.owner, p.d, count(*) filter (k.n_children = 0) as n_leaves, sum(p.saved) as saved
  from pairs p join kids k on k.owner = p.o2 and k.d = p.d2 group by p.owner, p.d),
parents as (select distinct b.owner, b.d, a.owner as parent from placed a join placed b on b.c = a.c and b.d = a.d + 1)
select n.owner as conv_id, cast(n.d as bigint) as depth, r.parent as parent_conv_id, n.n as n_convs, k.n_children, s.n_leaves,
  cast(s.saved as bigint) as saved_tokens, n.ends as ends_sha256
from nodes n join kids k on k.owner = n.owner and k.d = n.d join sums s on s.owner = n.owner and s.d = n.d
left join parents r on r.owner = n.owner and r.d = n.d"""


def _best(state: int, after: dict) -> str:
    """The least of (cost, audit, text) over the edits of a row in a state: up to three
    insertions, then deleting, keeping or another role."""
    role = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    options, at, cost, edits, text = [], state, 0, "", ""
    for _ in range(4):
        rest = "b.s[{}]"
        out = rest.format(at + 1)
        pack = "struct_pack(c := {c} + {o}.c, a := '{a}' || {o}.a, t := {t} || {o}.t)"
        options.append(pack.format(c=cost + 4, o=out, a=edits + "D", t=f"'{text}'"))
        to = after[at][role[at][0]]
        more = f"{cost} + case when r.cut then 3 else 0 end"
        new = pack.format(c=f"{more} + 3", o=rest.format(to + 1), a=edits + "R", t=f"'{text}' || chr(10) || '{role[at]}:' || r.text")
        options.append(f"case when not r.forced then {new} end")
        for initial, to in after[at].items():
            keep = pack.format(c=more, o=rest.format(to + 1), a=edits + "K", t=f"'{text}' || chr(10) || r.role || ':' || r.text")
            options.append(f"case when not r.forced and r.initial = '{initial}' then {keep} end")
        text += "' || chr(10) || '" + role[at] + ":"
        at, cost, edits = after[at][role[at][0]], cost + 3, edits + "I"
    return f"list_min(list_filter([{', '.join(options)}], lambda o: o is not null))"


def repair(after: tuple) -> str:
    kind = crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")
    states = ", ".join(_best(s, after) for s in range(4))
    end = "[struct_pack(c := 0, a := '', t := ''), struct_pack(c := 6, a := 'II', t := chr(10) || 'user:' || chr(10) || 'assistant:')," \
          " struct_pack(c := 3, a := 'I', t := chr(10) || 'assistant:'), struct_pack(c := 0, a := '', t := '')]"
    return f"""with recursive hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {kind} % 20 as k from conversations),
hurt as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when k = 3 then 2 else 1 end)) as copy
  from hashed where k <> 0),
ranked as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from hurt),
faults as (select *, substring(role, 1, 1) as initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as shown,
    row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    substring(lag(role) over (partition by conv_id order by i), 1, 1) || substring(role, 1, 1) as pair, i > 1 as later from ranked),
rows_ as (select *, shown = '' as blank, shown <> '' and again as dup, shown <> '' and not again and right(shown, 1) not in ('.', '!', '?') as cut, shown = '' or again as forced from faults),
counts as (select conv_id, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) as gaps, count(*) filter (blank) as blank,
    count(*) filter (dup) as duplicate, count(*) filter (cut) as truncated, count(*) filter (later and pair not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from rows_ group by conv_id),
steps as (
  select conv_id, n as i, {end} as s from counts
  union all
  select b.conv_id, b.i - 1, [{states}] from steps b join rows_ r on r.conv_id is not distinct from b.conv_id and r.i = b.i),
done as (select conv_id, s[1] as best from steps where i = 0),
every as (select distinct conv_id from conversations)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, cast(coalesce(best.c, 0) as bigint) as cost, coalesce(best.a, '') as audit, sha256(coalesce(substring(best.t, 2), '')) as repaired_sha256
from every e left join counts c on c.conv_id is not distinct from e.conv_id left join done d on d.conv_id is not distinct from e.conv_id"""
