"""DuckDB SQL for the corpus operators whose results SQL can say, over the same tables."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

#: The smallest document that links of Jaccard 0.8 over five-word shingles lead to; all pairs that share a shingle are compared.
JACCARD = rf"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) = 0 then cast([] as varchar[]) when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from sh group by 1),
pr as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
ln as (select a, b from pr join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
reach as (select doc_id, doc_id as tip from documents union select reach.doc_id, ln.b from reach join ln on ln.a = reach.tip)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from documents d left join n using (doc_id) join (select doc_id, min(tip) as component_id from reach group by 1) c using (doc_id)"""

#: Words inside windows of ten words of a benchmark item (or all of a shorter one), and the items.
DECONTAMINATION = rf"""with dw as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
win as (select distinct item, span, array_to_string(w[k : k + span - 1], ' ') as g from (select item, w, least(10, len(w)) as span, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from iw where len(w) > 0)),
spans as (select distinct span from win),
dwin as (select doc_id, span, k, array_to_string(w[k : k + span - 1], ' ') as g from (select doc_id, w, span, unnest(range(1, len(w) - span + 2)) as k from dw join spans on len(w) >= span)),
hit as (select distinct doc_id, dwin.span, k, item from dwin join win on win.g = dwin.g and win.span = dwin.span),
word as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + span)) as pos from hit) group by 1),
item as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) group by 1)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from dw d left join word using (doc_id) left join item using (doc_id)"""

_LETTERS = "".join(map(chr, range(0xC0, 0x100)))
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[: len(_LETTERS)]  # one byte for each letter, as levenshtein counts bytes

#: Words, what they are one edit away from, and where their forms lead. The checksum's table is made from its polynomial.
SPELLING = rf"""with recursive crc as (select i, 0 as k, cast(i as ubigint) as v from range(256) r(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, {0xEDB88320}::ubigint) else v >> 1 end from crc where k < 8),
tab as (select list(v order by i) as t from crc where k = 8),
occ as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents) group by all),
byt as (select run, n, list_transform(regexp_extract_all(hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)), '..'), lambda h: cast('0x' || h as ubigint)) as b from occ),
sums as (select run, n, xor(list_reduce(list_prepend({0xFFFFFFFF}::ubigint, b), lambda c, x: xor(t[cast(xor(c, x) & 255 as bigint) + 1], c >> 8)), {0xFFFFFFFF}::ubigint) as h from byt, tab),
cut as (select case when h % 97 = 0 then run[1 : cast(h % length(run) as bigint)] || run[cast(h % length(run) as bigint) + 2 :] else run end as word, n from sums),
voc as (select word, cast(sum(n) as bigint) as n, length(word) as m, translate(word, '{_LETTERS}', '{_SIGNS}') as w from cut where length(word) >= 5 group by 1 having sum(n) >= 3),
ends as (select word, n, m, w, unnest(['a' || word[1 : 2], 'b' || word[m - 1 :]]) as part from voc),
near as (select distinct x.word, y.word as other, y.n as other_n from ends x join ends y on x.part = y.part and abs(x.m - y.m) <= 1 and x.word <> y.word and levenshtein(x.w, y.w) = 1),
best as (select word, count(*) over (partition by word) as n_near, other as best, other_n as best_n from near qualify row_number() over (partition by word order by other_n desc, other) = 1),
form as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * n then best end as form, case when best_n >= 2 * n then best_n end as form_n from voc v left join best using (word)),
up as (select word, word as tip, 0 as k from form union all select up.word, form.form, k + 1 from up join form on form.word = up.tip where form.form is not null)
select f.word, f.form, u.tip as root, f.n, f.n_near, f.form_n from form f join (select word, arg_max(tip, k) as tip from up group by 1) u using (word)"""
