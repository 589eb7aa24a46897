"""DuckDB SQL for queries whose results SQL can say."""

from __future__ import annotations

# CRC-32 of a list of bytes: its table by the rule of its polynomial, and the fold over the bytes.
_CRC_TABLE = """
crc_step(i, c, k) as (
  select i, i, 0 from (select unnest(range(256)) as i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_step where k < 8
), crc_table as (select list(c order by i) as t from crc_step where k = 8)"""


def _bytes(text: str) -> str:
    """The UTF-8 bytes of a text of code points up to U+00FF."""
    return (
        f"flatten(list_transform(string_split({text}, ''), lambda ch: case when ord(ch) < 128 then [ord(ch)::bigint] "
        "else [(192 + (ord(ch) >> 6))::bigint, (128 + (ord(ch) & 63))::bigint] end))"
    )


def _crc(text: str) -> str:
    """The CRC-32 of a text, in a query that has ``crc_table`` among its tables."""
    step = "lambda a, b: xor(a >> 8, crc_table.t[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {_bytes(text)}), {step}), 4294967295)"


OP4_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then []
                      when len(w) < 4 then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) end as s
  from worded
), shingle as (
  select doc_id, unnest(s) as x from sets
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from shingle a join shingle b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2
), linked as (
  select a, b from shared join sets s on s.doc_id = a join sets t on t.doc_id = b
  where 100 * n >= 85 * (len(s.s) + len(t.s) - n)
), ways as (
  select a, b from linked union select b, a from linked
), reached as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, w.b from reached r join ways w on w.a = r.b
), least as (
  select a as doc_id, min(b) as component_id from reached group by a
)
select doc_id, len(s) as n_shingles, component_id from sets join least using (doc_id)
"""

OP11_SQL = f"""
with recursive {_CRC_TABLE}, turns as (
  select conv_id as c, md5(coalesce(role, '') || ':' || md5(coalesce(text, ''))) as turn_mark, length(coalesce(text, '')) as chars,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) - 1 as place
  from conversations where conv_id is not null
), sizes as (
  select c, n, {_crc("cast(c as varchar)")} % 6 as h from (select c, count(*) as n from turns group by c), crc_table
), info as (
  select s.*, least(s.h, coalesce(b.n, 0)) as hb from sizes s left join sizes b on b.c = s.c - s.c % 100
), rebuilt as (
  select c, hb + place - h + 1 as pos, turn_mark, chars from turns join info using (c) where place >= h
  union all
  select i.c, place + 1, turn_mark, chars from info i join turns t on t.c = i.c - i.c % 100 and t.place < i.hb
), steps as (
  select c, pos, chars, md5(string_agg(turn_mark, '') over (partition by c order by pos)) as node from rebuilt
), prefixes as (
  select c, pos, chars, node, coalesce(lag(node) over (partition by c order by pos), '') as above from steps
  union all
  select c, 0, 0, '', null from info
), nodes as (
  select node, min(c) as conv_id, any_value(pos) as depth, count(*) as n_convs, any_value(above) as above, any_value(chars) as chars
  from prefixes group by node
), children as (
  select above, count(*) as n_children from nodes where above is not null group by above
), below as (
  select p.node, count(*) filter (k.n_children is null) as n_leaves, sum((d.n_convs - 1) * d.chars) as saved_tokens
  from nodes d join prefixes p on p.c = d.conv_id and p.pos <= d.depth left join children k on k.above = d.node
  group by p.node
), ends as (
  select node, string_agg(cast(c as varchar), ',' order by c) as ids
  from (select c, arg_max(node, pos) as node from prefixes group by c) group by node
)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children,
       n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from nodes n left join nodes p on p.node = n.above left join children k on k.above = n.node
     join below b on b.node = n.node left join ends e on e.node = n.node
"""

OP13_SQL = f"""
with recursive {_CRC_TABLE}, runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') as run
  from documents
), counted as (
  select doc_id, run, count(*) as n from runs where length(run) >= 7 group by all
), marked as (
  select run, n, {_crc("coalesce(cast(doc_id as varchar), '') || ':' || run")} as h from counted, crc_table
), results as (
  select case when h % 31 = 0 then run[: h % length(run)] || run[h % length(run) + 2 :] else run end as word, n from marked
), words as (
  select word, cast(sum(n) as bigint) as n from results where length(word) >= 7 group by word having sum(n) >= 2
), skips as (
  select word, n, unnest(range(length(word))) as i from words
), keyed as (
  select word, n, i, word[: i] as before, word[i + 2 :] as after from skips
), near as (
  select a.word, b.word as other, b.n as other_n
  from keyed a join keyed b on a.i = b.i and a.before = b.before and a.after = b.after and a.word <> b.word
  union
  select k.word, w.word, w.n from keyed k join words w on w.word = k.before || k.after
  union
  select w.word, k.word, k.n from keyed k join words w on w.word = k.before || k.after
), best as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word
), formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * w.n then other end as form,
         case when other_n >= 10 * w.n then other_n end as form_n
  from words w left join best using (word)
), followed as (
  select word, word as root, form from formed
  union all
  select f.word, g.word, g.form from followed f join formed g on g.word = f.form
)
select f.word, f.form, r.root, n, n_near, form_n
from formed f join followed r on r.word = f.word and r.form is null
"""
