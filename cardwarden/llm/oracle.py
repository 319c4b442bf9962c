"""SQL with the results of the operators that SQL can express."""

SUBSTRINGS = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), windows as (
  select doc_id, i, array_to_string(words[i:i + 49], ' ') as words
  from w, unnest(range(1, len(words) - 48)) as t(i)
), least as (
  select words, min(doc_id) as first from windows group by words
), removed as (
  select distinct doc_id, unnest(range(i, i + 50)) as p
  from windows join least using (words) where first < doc_id
), each as (
  select doc_id, unnest(range(1, len(words) + 1)) as p, unnest(words) as word from w
), kept as (
  select e.doc_id, string_agg(word, ' ' order by p) as text, count(*) as n
  from each e anti join removed r on e.doc_id = r.doc_id and e.p = r.p group by e.doc_id
)
select w.doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed,
       sha256(coalesce(text, '')) as kept_sha256
from w left join kept using (doc_id)
"""

CONTAMINATION = r"""
with d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
), b as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark
), patterns as (
  select distinct item_id, least(len(words), 10) as n, array_to_string(words[i:i + 9], ' ') as words
  from b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as t(i) where len(words) > 0
), sizes as (
  select distinct n from patterns
), windows as (
  select doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') as words
  from d, sizes, unnest(range(1, len(words) - n + 2)) as t(i)
), found as (
  select doc_id, i, n, item_id from windows join patterns using (n, words)
), hits as (
  select doc_id, count(*) as n_hit
  from (select distinct doc_id, unnest(range(i, i + n)) as p from found) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from found where item_id is not null)
  group by doc_id
)
select d.doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

LINES = r"""
with d as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), l as (
  select r, doc_id, unnest(range(1, len(lines) + 1)) as p, unnest(lines) as line from d
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), common as (
  select key, max(doc_id) as last from k where length(key) >= 20 and doc_id is not null
  group by key having count(distinct doc_id) >= 3
), judged as (
  select r, doc_id, p, line, coalesce(doc_id < last, false) as gone from k left join common using (key)
)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by p) filter (where not gone), '')) as kept_sha256
from judged group by r
"""

#: The unsigned CRC-32 of a text, eight shifts a byte; SQL has none of its own.
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)), "
    "lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)"
)

CONVERSATIONS = r"""
with turns as (
  select conv_id, turn, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] as digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
  from conversations where conv_id is not null
), own as (
  select conv_id, list({'d': digest, 'w': words} order by turn nulls first, digest, words) as turns from turns group by conv_id
), heads as (
  select *, {crc} % 4 as h from own
), rebuilt as (
  select c.conv_id, list_concat(coalesce(p.turns[1:c.h], []), c.turns[c.h + 1:]) as turns
  from heads c left join own p on p.conv_id = c.conv_id - c.conv_id % 20
), starts as (
  select conv_id, len(turns) as length, d as depth, sha256(array_to_string(list_transform(turns[1:d], lambda e: e.d), ',')) as node,
         case when d > 0 then sha256(array_to_string(list_transform(turns[1:d - 1], lambda e: e.d), ',')) end as parent,
         case when d > 0 then turns[d].w else 0 end as words
  from rebuilt, unnest(range(0, len(turns) + 1)) as t(d)
), nodes as (
  select node, depth, any_value(parent) as parent, any_value(words) as words, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where length = depth), '')) as ends_sha256
  from starts group by node, depth
), children as (
  select parent as node, depth - 1 as depth, count(*) as n_children from nodes where parent is not null group by all
), counted as (
  select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (node, depth)
), subtrees as (
  select s.node, s.depth, count(*) filter (where c.n_children = 0) as n_leaves, sum((c.n_convs - 1) * c.words)::bigint as saved_tokens
  from counted c join starts l on l.node = c.node and l.depth = c.depth and l.conv_id = c.conv_id
  join starts s on s.conv_id = c.conv_id and s.depth <= c.depth group by s.node, s.depth
)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
from counted c join subtrees using (node, depth) left join counted p on p.node = c.parent and p.depth = c.depth - 1
""".replace("{crc}", _CRC32.format(text="conv_id::varchar"))

MERKLE = r"""
with recursive d as (
  select row_number() over () as r, *, coalesce('+' || lang, '') as tree, coalesce({crc} % 3 = 0, false) as tampered from documents
), f as (
  select r, doc_id, tree, tampered, text, coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-') || coalesce(strlen(source)::varchar || ':' || source, '-')
         || coalesce(strlen(lang)::varchar || ':' || lang, '-') || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') as head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower
  from d
), h as (
  select r, doc_id, tree, sha256(head || coalesce(strlen(text)::varchar || ':' || text, '-')) as leaf,
         case when tampered then sha256(head || coalesce(strlen(lower)::varchar || ':' || lower, '-')) end as other
  from f
), leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf, r) - 1 as pos from h
), nodes(tree, level, pos, n, digest) as (
  select tree, 0, pos, count(*) over (partition by tree), leaf from leaves
  union all
  select tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)) from nodes where n > 1 group by tree, level, n, pos // 8
), tops as (
  select tree, digest, level as height, row_number() over (order by tree) - 1 as pos from nodes where n = 1
), upper(level, pos, n, digest) as (
  select 0, pos, count(*) over (), digest from tops
  union all
  select level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)) from upper where n > 1 group by level, n, pos // 8
), root as (
  select level as height, digest from upper where n = 1
), steps as (
  select r, s as step, n.pos as pos, l.pos >> (3 * s) as own, n.digest
  from leaves l join tops t using (tree), unnest(range(0, t.height)) as u(s), nodes n
  where n.tree = l.tree and n.level = s and n.pos // 8 = l.pos >> (3 * s + 3)
  union all
  select r, t.height + s, n.pos, t.pos >> (3 * s), n.digest
  from leaves l join tops t using (tree), root, unnest(range(0, root.height)) as u(s), upper n
  where n.level = s and n.pos // 8 = t.pos >> (3 * s + 3)
), sides as (
  select r, step, coalesce(string_agg(digest, '' order by pos) filter (where pos < own), '') as before, coalesce(string_agg(digest, '' order by pos) filter (where pos > own), '') as after
  from steps group by r, step
), proofs as (
  select r, string_agg(before || after, '' order by step) as proof, list({'a': before, 'b': after} order by step) as path from sides group by r
), folding(r, step, node, path) as (
  select l.r, 0, coalesce(other, leaf), coalesce(path, []) from leaves l left join proofs using (r)
  union all
  select r, step + 1, sha256(path[step + 1].a || node || path[step + 1].b), path from folding where step < len(path)
)
select l.doc_id, l.leaf, t.digest as subroot, root.digest as root, sha256(coalesce(proof, '')) as proof_sha256, k.node as folded_root, k.node = root.digest as verified
from leaves l join tops t using (tree) left join proofs using (r) join folding k on k.r = l.r and k.step = len(k.path), root
""".replace("{crc}", _CRC32.format(text="doc_id::varchar"))
