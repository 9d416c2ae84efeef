"""SQL, over the same tables, of the operators that SQL can express."""

from __future__ import annotations

_FIELD = "case when {0} is null then '-' else strlen({0}::varchar) || ':' || {0}::varchar end"
_FIELDS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: crc32 of the decimal id, bit by bit over its ASCII characters.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::bigint, 1))::bigint)), "
    "lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))))"
)

MERKLE_SQL = f"""
with recursive marked as (
    select doc_id, source, {_FIELDS} as head, text, doc_id is not null and ({_CRC}) % 2 = 0 as chosen
    from documents
), leaves as (
    select doc_id, source, sha256(head || {_FIELD.format("text")}) as leaf,
        sha256(head || {_FIELD.format("(case when chosen then replace(text, chr(10), '') else text end)")}) as altered
    from marked
), placed as (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from leaves
), nodes as (
    select source, 0 as level, pos, leaf as digest, count(*) over (partition by source) as n from placed
    union all
    select source, level + 1, pos // 3, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 2) // 3
    from nodes where n > 1 group by source, level, pos // 3
), subroots as (
    select source, digest as subroot, level as height, row_number() over (order by source nulls first) - 1 as spos from nodes where n = 1
), tops as (
    select 0 as level, spos as pos, subroot as digest, count(*) over () as n from subroots
    union all
    select level + 1, pos // 3, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 2) // 3
    from tops where n > 1 group by level, pos // 3
), top as (
    select digest as root, level as top_height from tops where n = 1
), sides as (
    -- what stands left and right of each node in its run of three, in the trees of the sources and above them
    select source, false as above, level, pos, coalesce(string_agg(digest, '' order by pos) over (w rows between unbounded preceding and 1 preceding), '') as l,
        coalesce(string_agg(digest, '' order by pos) over (w rows between 1 following and unbounded following), '') as r
    from nodes where n > 1 window w as (partition by source, level, pos // 3 order by pos)
    union all
    select null, true, level, pos, coalesce(string_agg(digest, '' order by pos) over (w rows between unbounded preceding and 1 preceding), ''),
        coalesce(string_agg(digest, '' order by pos) over (w rows between 1 following and unbounded following), '')
    from tops where n > 1 window w as (partition by level, pos // 3 order by pos)
), ways as (
    select placed.doc_id, placed.source, placed.leaf, placed.pos as row_pos, subroot, root, height, top_height, spos,
        0 as step, placed.pos as pos, altered as node, '' as proof
    from placed join subroots on placed.source is not distinct from subroots.source, top
    union all
    select w.doc_id, w.source, w.leaf, w.row_pos, w.subroot, w.root, w.height, w.top_height, w.spos, w.step + 1,
        case when w.step + 1 = w.height then w.spos else w.pos // 3 end, sha256(s.l || w.node || s.r), w.proof || s.l || s.r
    from ways w join sides s on s.above = (w.step >= w.height) and (s.above or s.source is not distinct from w.source)
        and s.level = case when w.step >= w.height then w.step - w.height else w.step end
        and s.pos = case when w.height = 0 and w.step = 0 then w.spos else w.pos end
    where w.step < w.height + w.top_height
)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, node as folded_root, node = root as verified
from ways where step = height + top_height
"""

DIVERGENCE_SQL = """
with rows_ as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), words as (
    select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
    from rows_
), kept as (
    select lang, term from words group by lang, term having count(distinct r) >= 30
), sizes as (
    select lang, count(*) as v from kept group by lang
), counts as (
    select lang, source, term, count(*) as c from words semi join kept using (lang, term) group by lang, source, term
), groups as (
    select distinct lang, source from rows_
), totals as (
    select lang, source, sum(c) as n from counts group by lang, source
), shares as (
    -- every group and every kept term of its language
    select g.lang, g.source, k.term, coalesce(c.c, 0) as c,
        1 + (1000000000::hugeint * (coalesce(c.c, 0) + 5)) // (coalesce(t.n, 0) + 5 * s.v) as p
    from groups g join kept k using (lang) join sizes s using (lang)
        left join totals t using (lang, source) left join counts c using (lang, source, term)
), whole as (
    select lang, term, 1 + (1000000000::hugeint * (sum(c) + 5)) // (any_value(n) + 5 * any_value(v)) as q
    from counts join (select lang, sum(n) as n from totals group by lang) using (lang) join sizes using (lang) group by lang, term
), distances as (
    select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(d.value, 0) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
        left join distances d on d.lang = a.lang and d.source = a.source and d.item = b.source
), terms as (
    select lang, source, 'term' as part, term as item, p - q as value from shares join whole using (lang, term) where c > 0 and p > q
), ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
    from (select * from pairs union all select * from terms)
)
select lang, source, part, item, value::bigint as value, rank::integer as rank from ranked where part = 'pair' or rank <= 50
"""
