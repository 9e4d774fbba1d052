"""The SQL, for DuckDB, of the rows that quotation linking gives over `conversations`."""

SQL = r"""with recursive m as (select row_number() over () as rid, conv_id, turn, role, coalesce(text, '') as t from conversations),
split as (select rid, regexp_split_to_array(t, '\r?\n') as l from m),
lines as (select rid, unnest(l) as line, generate_subscripts(l, 1) as i from split),
levels as (select *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) as level from lines),
texts as (select *, case when level > 0 then ltrim(regexp_replace(line, '^((?:[ \t]*>)*)', '')) else line end as content,
  coalesce(lead(level) over (partition by rid order by i), 0) as next_level, coalesce(lag(level) over (partition by rid order by i), -1) as last_level from levels),
numbered as (select *, trim(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g')) as norm, sum((level <> last_level)::int) over (partition by rid order by i) as grp from texts),
joined as (select rid, grp, level, string_agg(content, chr(10) order by i) as t from numbered group by all),
pieces as (select rid, grp, level, list_distinct(list_filter(list_transform(list_concat([t], string_split(t, chr(10)), regexp_split_to_array(t, '\n[ \t]*\n'), regexp_split_to_array(t, '[.!?]+[ \t\n]+|\n[ \t]*\n')),
  lambda x: trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'))), lambda x: x <> '')) as parts from joined),
runs as (select * from pieces where len(parts) > 0),
stats as (select rid, max(level) as deepest from levels group by rid),
own as (select rid, string_agg(content, chr(10) order by i) as body from numbered
  where level = 0 and not (next_level > 0 and regexp_matches(line, '(?i)\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$')) group by rid),
bodies as (select m.*, case when deepest > 0 then coalesce(regexp_replace(body, '^\s+|\s+$', '', 'g'), '') else t end as body from m join stats using (rid) left join own using (rid)),
written as (select conv_id, turn, unnest(parts) as key from runs join m using (rid) where level = 0
  union all select conv_id, turn, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) from bodies),
first as (select conv_id, key, min(turn) as origin from written where turn is not null group by all),
cited as (select rid, conv_id, turn, grp, level, unnest(parts) as key from runs join m using (rid) where level > 0),
passages as (select *, dense_rank() over (partition by rid order by grp) as passage from cited),
weighed as (select c.conv_id, c.turn, passage, level, origin, sum(length(c.key)) as weight from passages c join first f on c.conv_id is not distinct from f.conv_id and c.key = f.key and origin < c.turn group by all),
chosen as (select conv_id, turn, level, origin from weighed qualify row_number() over (partition by conv_id, turn, passage, level order by weight desc, origin desc) = 1),
links as (select conv_id, turn, first(origin order by level, origin desc) as reply_to, count(*) as n_linked from chosen group by all),
chains as (select conv_id, turn, reply_to as root_turn, 1::bigint as depth from links
  union all select c.conv_id, c.turn, l.reply_to, c.depth + 1 from chains c join links l on c.conv_id is not distinct from l.conv_id and c.root_turn = l.turn),
roots as (select conv_id, turn, root_turn, depth from chains qualify row_number() over (partition by conv_id, turn order by depth desc) = 1),
quotes as (select rid, count(*) as n_quotes, max(level) as quote_depth from runs where level > 0 group by rid)
select b.conv_id, b.turn, b.role, b.body as text, coalesce(n_quotes, 0)::int as n_quotes, coalesce(quote_depth, 0)::int as quote_depth, coalesce(n_linked, 0)::bigint as n_linked, reply_to,
  coalesce(root_turn, b.turn) as root_turn, coalesce(depth, 0)::bigint as depth,
  row_number() over (partition by b.conv_id order by coalesce(root_turn, b.turn) nulls first, b.turn nulls first, b.role nulls first, b.body) - 1 as position
from bodies b left join links l on b.conv_id is not distinct from l.conv_id and b.turn = l.turn
left join roots r on b.conv_id is not distinct from r.conv_id and b.turn = r.turn left join quotes q on b.rid = q.rid"""
