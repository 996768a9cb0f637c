"""The exact operators as DuckDB SQL over whole tables, for small tables: every window, shingle and
pair is written out."""

from __future__ import annotations

#: Words and their places, from 1.
_WORDS = r"""
texts_ as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents)"""

OP3 = (
    "with"
    + _WORDS
    + """,
windows_ as (select doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as i from texts_)),
later_ as (select doc_id, i from windows_ qualify row_number() over (partition by g order by doc_id, i) > 1),
gone_ as (select distinct doc_id, i + k as p from later_, (select unnest(range(0, 20)) as k)),
kept_ as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from texts_) anti join gone_ using (doc_id, p) group by 1)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from texts_ left join kept_ using (doc_id)"""
)

OP10 = """
with texts_ as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows_ as (select doc_id, i, md5(substring(h, (2 * i + 1)::bigint, 200)) as g from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) as i from texts_)),
later_ as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from (select doc_id, i from windows_ qualify row_number() over (partition by g order by doc_id, i) > 1)),
runs_ as (select doc_id, i, sum((before is null or i > before + 100)::int) over (partition by doc_id order by i) as run from later_),
spans_ as (select doc_id, min(i) as a, max(i) + 100 as z from runs_ group by doc_id, run),
held_ as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as last from spans_),
parts_ as (select doc_id, a, substring(h, (2 * last + 1)::bigint, (2 * (a - last))::bigint) as part from held_ join texts_ using (doc_id) union all select doc_id, z, substring(h, (2 * z + 1)::bigint) from (select doc_id, max(z) as z from spans_ group by 1) join texts_ using (doc_id)),
kept_ as (select doc_id, string_agg(part, '' order by a) as k from parts_ group by 1),
sums_ as (select doc_id, sum(z - a) as removed, count(*) as spans from spans_ group by 1)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256 from texts_ left join sums_ using (doc_id) left join kept_ using (doc_id)"""

OP5 = (
    "with recursive"
    + _WORDS.replace("(text,", "(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),")
    + """,
sets_ as (select distinct doc_id, g from (select doc_id, array_to_string(w[i : i + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from texts_ where len(w) > 0))),
sizes_ as (select doc_id, count(*) as n from sets_ group by 1),
common_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from (select * from sets_ join sizes_ using (doc_id)) a join (select * from sets_ join sizes_ using (doc_id)) b on a.g = b.g and a.doc_id < b.doc_id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n group by all),
links_ as (select a, b from common_ join sizes_ x on x.doc_id = a join sizes_ y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
ways_ as (select a, b from links_ union all select b, a from links_),
reach_ as (select doc_id as node, doc_id as low from texts_ union select w.b, r.low from reach_ r join ways_ w on w.a = r.node where r.low < w.b)
select t.doc_id, coalesce(n, 0)::bigint as n_shingles, low as component_id from texts_ t left join sizes_ using (doc_id) join (select node, min(low) as low from reach_ group by 1) r on r.node = t.doc_id"""
)
