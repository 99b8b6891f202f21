"""DuckDB SQL for the results of spelling variants, conversation tries and min-hash near duplicates."""

#: The checksum of a list of byte values: eight shifts for each byte.
CRC32 = """(4294967295 - list_reduce(list_prepend(4294967295::bigint, {bytes}), lambda c, b:
  list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y:
    xor(x >> 1, (x & 1) * 3988292384))))"""


def digits_crc32(value: str) -> str:
    """The unsigned checksum of a number's decimal digits."""
    return CRC32.format(bytes=f"[ord(x)::bigint for x in string_split(({value})::varchar, '')]")


#: The 64 letters beyond ASCII become single bytes that no word has, as DuckDB counts edits of bytes.
_LATIN = "".join(map(chr, range(192, 256)))
_BYTES = "".join(map(chr, range(32, 96))).replace("'", "''")

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = f"""
with recursive runs as (
  select doc_id, run, count(*) as n from (
    select doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-zÀ-ÿ]+')) as run from documents)
  where length(run) >= 6 group by all),
coded as (
  select *, list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda x: ord(x)::bigint) as points from runs),
hashed as (
  select run, n, {CRC32.format(
      bytes="flatten([case when p < 128 then [p] else [195::bigint, p - 64] end for p in points])"
  )} as h from coded),
words as (
  select word, sum(n)::bigint as n from (
    select case when h % 199 = 0
      then run[1:(h % length(run))] || run[h % length(run) + 2:] else run end as word, n
    from hashed)
  where length(word) >= 6 group by word having sum(n) >= 5),
lettered as (select *, translate(word, '{_LATIN}', '{_BYTES}') as bytes from words),
near as (
  select a.word, a.n, b.word as near, b.n as near_n
  from lettered a join lettered b on abs(length(a.word) - length(b.word)) <= 1 and a.word <> b.word
  where levenshtein(a.bytes, b.bytes) = 1),
best as (
  select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n
  from near group by word),
formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near,
    case when near_n >= 5 * w.n then near end as form, case when near_n >= 5 * w.n then near_n end as form_n
  from words w left join best using (word)),
followed as (
  select word, word as root, form as next from formed
  union all
  select r.word, r.next, f.form from followed r join formed f on f.word = r.next
),
ends as (select word, root from followed where next is null)
select word, n, n_near, form, form_n, root from formed join ends using (word)
"""

TRIE = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as said
  from conversations where conv_id is not null),
convs as (
  select *, {digits_crc32("conv_id")} % 6 as h, conv_id - conv_id % 100 as opener
  from (select conv_id, list(said order by i) as own from turns group by conv_id)),
whole as (
  select c.conv_id, coalesce(o.own[1:c.h], []) || c.own[c.h + 1:] as path
  from convs c left join convs o on o.conv_id = c.opener),
members as (select conv_id, path, unnest(range(len(path) + 1)) as depth from whole),
nodes as (
  select depth, path[1:depth] as prefix, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(path) = depth), '') as ends
  from members group by all),
above as (select *, prefix[1:depth - 1] as up from nodes where depth > 0),
children as (select up as prefix, count(*) as n_children from above group by up),
sized as (
  select n.*, coalesce(c.n_children, 0) as n_children,
    case when depth = 0 then 0 else (n_convs - 1) * length(n.prefix[depth].text) end as saved
  from nodes n left join children c on n.prefix = c.prefix),
spread as (
  select n_children, saved, prefix[1:d] as prefix
  from (select *, unnest(range(depth + 1)) as d from sized)),
sums as (
  select prefix, count(*) filter (where n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens
  from spread group by prefix)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
  s.saved_tokens, sha256(n.ends) as ends_sha256
from sized n join sums s on n.prefix = s.prefix
left join nodes p on n.depth > 0 and p.prefix = n.prefix[1:n.depth - 1]
"""

MIN_HASH = f"""
with recursive worded as (
  select row_number() over () as r, doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') as words from documents),
sets as (
  select r, doc_id, list_sort(list_distinct(case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 1), lambda k: array_to_string(words[k:k + 2], ' ')) end)) as shingles
  from worded),
classes as (select min(r) as c, shingles, len(shingles) as n from sets where len(shingles) > 0 group by shingles),
singles as (select c, n, unnest(shingles) as s from classes),
shared as (
  select a.c as a, b.c as b, a.n as an, b.n as bn, count(*) as met
  from singles a join singles b on a.s = b.s and a.c < b.c and a.n * 85 <= b.n * 100 and b.n * 85 <= a.n * 100
  group by all),
links as (
  select a, b from shared where 100 * met >= 85 * (an + bn - met)
  union all select b, a from shared where 100 * met >= 85 * (an + bn - met)),
reached as (
  select c as a, c as b from classes union select r.a, l.b from reached r join links l on r.b = l.a),
tops as (select a as c, min(b) as root from reached group by a),
rooted as (select s.doc_id, s.shingles, root from sets s left join classes k using (shingles) left join tops t on t.c = k.c),
least as (select root, min(doc_id) as least from rooted where root is not null group by root)
select doc_id, len(shingles)::bigint as n_shingles, coalesce(least, doc_id) as component_id, doc_id = coalesce(least, doc_id) as kept
from rooted left join least using (root)
"""
