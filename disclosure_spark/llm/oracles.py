"""DuckDB counterparts of the registered queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op10_warc"] = """
with p as (
    select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), s as (
    select *, max(page_id) over (partition by payload_digest) as top from p
)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from s
"""

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

ORACLES["op8_benchmark_decontamination"] = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
bw as (
    select distinct item, least(13, len(w)) as size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as t
    from (select item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from b where len(w) > 0)
),
dw as (
    select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as t
    from (
        select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i
        from d, (select distinct size from bw) where len(w) >= size
    )
),
h as (select doc_id, item, i, dw.size from dw join bw using (size, t)),
n as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(i, i + size)) as p from h) group by 1),
s as (
    select doc_id, count(*)::bigint as n_items, sha256(string_agg(item, ',' order by encode(item))) as items_sha256
    from (select distinct doc_id, item from h) group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n using (doc_id) left join s using (doc_id)
"""

_CRC32 = """crc_step(k, bit, v) as (
    select k, 0, k::bigint from range(256) as r(k)
    union all
    select k, bit + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from crc_step where bit < 8
), crc_table as (select list(v order by k) as t from crc_step where bit = 8)"""  # Fixed value: the reflected polynomial of crc32


def _crc32(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)),
        lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])))"""


def _part(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"


def _leaf(count: str) -> str:
    return "sha256(" + " || ".join(map(_part, ("doc_id", "source", "lang", count, "text"))) + ")"


ORACLES["op11_merkle_manifest"] = f"""
with recursive {_CRC32}, d as (
    select row_number() over () as rid, doc_id, lang, {_leaf("n_chars")} as leaf,
        case when {_crc32("doc_id::varchar")} % 7 = 0 then {_leaf("(n_chars + 1)")} end as forged
    from documents, crc_table
), leaves as (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from d
), low(lang, lvl, pos, n, h) as (
    select lang, 0, pos, n, leaf from leaves
    union all
    select lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from low where n > 1 group by lang, lvl, n, pos // 2
), subs as (
    select lang, lvl as height, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from low where n = 1
), top(lvl, pos, n, h) as (
    select 0, pos, n, h from subs
    union all
    select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from top where n > 1 group by lvl, n, pos // 2
), whole as (select lvl as top_height, h as root from top where n = 1),
steps as (
    select rid, leaves.lang, leaves.pos as leaf_pos, subs.pos as sub_pos, height, unnest(range(height + top_height)) as step
    from leaves join subs on leaves.lang is not distinct from subs.lang, whole
), path as (
    select rid, step, (case when step < height then leaf_pos >> step else sub_pos >> (step - height) end) % 2 = 1 as is_right, coalesce(low.h, top.h) as h
    from steps
    left join low on step < height and steps.lang is not distinct from low.lang and low.lvl = step and low.pos = xor(leaf_pos >> step, 1::bigint)
    left join top on step >= height and top.lvl = step - height and top.pos = xor(sub_pos >> (step - height), 1::bigint)
), fold(rid, step, acc) as (
    select rid, 0::bigint, coalesce(forged, leaf) from leaves
    union all
    select rid, step + 1, sha256(case when h is null then acc when is_right then h || acc else acc || h end) from fold join path using (rid, step)
), proofs as (select rid, sha256(coalesce(string_agg(h, '' order by step), '')) as proof from path group by rid),
folded as (select rid, max_by(acc, step) as acc from fold group by rid)
select doc_id, leaf, subs.h as subroot, root, coalesce(proof, sha256('')) as proof_sha256, acc as folded_root, acc = root as verified
from leaves join subs on leaves.lang is not distinct from subs.lang cross join whole left join proofs using (rid) join folded using (rid)
"""

# A run of period q has at least 16 words in a row that equal those q later, so runs of 16 words that come again give all candidates.
ORACLES["op12_periodic_runs"] = rf"""
with recursive {_CRC32}, d as (
    select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
        coalesce({_crc32("doc_id::varchar")}, 0) as h
    from documents, crc_table
), e as (
    select *, len(w) as n, case when len(w) > 0 then (h // 10) % len(w) end as a, (h // 10) % 8 as g8 from d
), v as (
    select rid, doc_id, n, case when h % 10 = 0 and n > 0
        then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g8)) end]) else w end as w
    from e
), places as (select rid, n, unnest(range(n)) as i, w from v where n >= 24),
grams as (select rid, n, i, array_to_string(w[i + 1:i + 16], ' ') as t from places where i + 16 <= n),
same as (select l.rid, l.n, l.i, r.i - l.i as q from grams l join grams r on l.rid = r.rid and l.t = r.t and r.i > l.i and 3 * (r.i - l.i) <= l.n),
islands as (
    select rid, q, min(i) as s, count(*) + 15 + q as len
    from (select *, i - row_number() over (partition by rid, q order by i) as island from same) group by rid, q, island
), runs as (select rid, s, len, min(q) as q from islands where len >= greatest(24, 3 * q) group by rid, s, len),
listed as (select rid, count(*) as n_runs, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q)) as runs_sha256 from runs group by rid),
best as (select * from runs qualify row_number() over (partition by rid order by len / q desc, s, q) = 1),
dropped as (select distinct rid, unnest(range(s + q, s + len)) as i from runs),
kept as (
    select rid, string_agg(w[i + 1], ' ' order by i) as t
    from (select rid, unnest(range(n)) as i, w from v) anti join dropped using (rid, i) group by rid
)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, len::bigint as length, q::bigint as period, (1000 * len // q)::bigint as exponent_milli,
    coalesce(runs_sha256, sha256('')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from v left join listed using (rid) left join best using (rid) left join kept using (rid)
"""
