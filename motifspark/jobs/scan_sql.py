"""The single-end scan and what follows from it in SQL, for engines that lack the kernel."""

from __future__ import annotations

from ..config import ScanConfig
from ..operators import strand
from ..sources import reads as rd

CFG = ScanConfig()
# Digits in a read are no bases.
ENC = "translate(upper(seq), 'TGCA0123', '0123xxxx')"


def canonical(motif: str) -> str:
    return f"list_min(list_transform(range(1, length({motif}) + 1), lambda i: substr({motif} || {motif}, i, length({motif}))))"


def flipped(motif: str) -> str:
    return canonical(f"reverse(translate({motif}, '0123', '3210'))")


READS = f"with reads as ({rd.SHORT_SQL})"
# Every valid window of every period over whole reads.
WINDOWS = f"""{READS}, enc as (select read_id, {ENC} as enc from reads),
tries as materialized (select read_id, k::int as k, enc from enc, range({CFG.min_mer}, {CFG.max_mer + 1}) t(k)),
starts as (select read_id, k, enc, unnest(range(1, length(enc) - k + 2))::int as pos from tries),
windows as (select read_id, k, pos, substr(enc, pos, k) as kmer from starts where not regexp_matches(substr(enc, pos, k), '[^0-3]'))"""


def _selected(parts: str) -> str:
    """CTEs after ``parts`` (read_id, part, enc, lo, hi): counted (all counts at periods that can be selected), leads, and chosen by level."""
    levels = ", ".join(f"('{v}', {b})" for v, b in CFG.baselines.items())
    return f"""
tries as materialized (select read_id, part, k::int as k, enc from {parts}, range(1, {CFG.max_mer + 1}) t(k) where k between lo and hi),
spots as (select read_id, part, k, enc, unnest(range(1, length(enc) - k + 2))::int as pos from tries),
win as (select read_id, part, k, pos, substr(enc, pos, k) as kmer from spots where not regexp_matches(substr(enc, pos, k), '[^0-3]')),
mixed as (select *, length(replace(kmer, '0', '')) * 4096 + length(replace(kmer, '1', '')) * 64 + length(replace(kmer, '2', '')) as mix from win),
mixes as (select read_id, part, k, mix, count(*) as n from mixed group by all),
usable as (select read_id, part, k, sum(n)::bigint as total from mixes group by all having max(n) >= {CFG.low_baseline} * sum(n)),
counted as (select read_id, part, k, total, {canonical("kmer")} as motif, count(*) as cnt, max(pos) as last from win join usable using (read_id, part, k) group by all),
leads as (select read_id, part, k, max(cnt) as top, max(cnt) / max(total) as share, arg_min(motif, {{'a': -cnt, 'b': last}}) as motif from counted group by all),
periods as (select read_id, part, list({{'k': k, 'share': share, 'seen': []::int[]}} order by k) as ks from leads where motif <> repeat(motif[1], k) group by all),
levels(level, base) as (values {levels}),
chosen as (select read_id, part, level, base, list_reduce(ks, lambda a, x: case when x.share >= greatest(base, a.share) and len(list_filter(a.seen, lambda t: x.k % t = 0)) = 0 then {{'k': x.k, 'share': x.share, 'seen': list_append(a.seen, x.k)}} else a end, {{'k': 0, 'share': 0.0::double, 'seen': []::int[]}}).k as k from periods, levels)"""


HALVES = f"""{READS}, enc as (select read_id, {ENC} as enc from reads),
parts as (select read_id, unnest(['L', 'R']) as part, unnest([substr(enc, 1, length(enc) // 2), substr(enc, length(enc) // 2 + 1)]) as enc, {CFG.min_mer} as lo, least(length(enc) // 4, {CFG.max_mer}) as hi from enc where length(enc) >= {4 * CFG.min_mer})"""

TARGET_K = f"""{HALVES}, {_selected("parts")}
select p.read_id, part as side, level, coalesce(c.k, 0)::int as k, coalesce(motif, '') as motif, coalesce(top, 0)::bigint as motif_count
from parts p cross join levels left join (select * from chosen where k > 0) c using (read_id, part, level) left join leads using (read_id, part, k)"""

# Halves, whole reads over their longer periods (W), and whole reads at the periods that both halves may select (T).
_SCAN = f"""{HALVES},
pieces as (select * from parts
  union all select read_id, 'W', enc, greatest(length(enc) // 4 + 1, {CFG.min_mer}), least(length(enc) // 2, {CFG.max_mer}) from enc where length(enc) between {2 * CFG.min_mer} and {4 * CFG.max_mer - 1}
  union all select read_id, 'T', enc, {CFG.min_mer}, least(length(enc) // 4, {CFG.max_mer}) from enc where length(enc) >= {4 * CFG.min_mer}), {_selected("pieces")},
sides as (select e.read_id, level, base, coalesce(max(k) filter (part = 'L'), 0) as l, coalesce(max(k) filter (part = 'R'), 0) as r, coalesce(max(k) filter (part = 'W'), 0) as w
  from enc e cross join levels left join chosen c using (read_id, level, base) group by all),
routes as (
  select read_id, level, 'T' as part, l as k, 'both' as direction, base, true as fold from sides where l > 0 and l = r
  union all select read_id, level, 'L', l, 'forward', 0, false from sides where l > 0 and l <> r
  union all select read_id, level, 'R', r, 'backward', 0, false from sides where l = 0 and r > 0
  union all select read_id, level, 'W', w, 'both', 0, false from sides where l = 0 and r = 0 and w > 0),
sums as (select {{by}}level, direction, fold, k, c.motif, sum(cnt)::bigint as cnt from routes join leads d using (read_id, part, k) join counted c using (read_id, part, k)
  where d.share >= base and d.motif <> repeat(d.motif[1], k) {{only}} group by all),
scanned as (select {{file}}level, direction, k, case when fold then least(motif, {flipped("motif")}) else motif end as kmer, sum(cnt)::bigint as cnt from sums group by all)"""


def _scan(by: str = "", file: str = "", only: str = "") -> str:
    return _SCAN.replace("{by}", by).replace("{file}", file).replace("{only}", only)


SCAN, TARGETS = _scan(), _scan(only="and fold")
# The file of a read in queries over several files.
FILE_OF = "case when read_id % 2 = 0 then 'even' else 'odd' end"
_FILES = _scan(f"{FILE_OF} as file, ", "file, ")


def short_period(motif: str, k: str = "k") -> str:
    return "(" + " or ".join(f"({k} > {p} and substr({motif}, 1, {k} - {p}) = substr({motif}, {p + 1}))" for p in range(3, CFG.min_mer)) + ")"


def _fold(by: str) -> str:
    return f"""ways as (select {by}level, k, kmer, direction, cnt, {flipped("kmer")} as flip from scanned),
keyed as (select {by}level, k, case when direction = 'both' then kmer else least(kmer, flip) end as key, case when direction = 'backward' then flip else kmer end as own, direction <> 'both' as one_way, cnt from ways),
sided as (select {by}level, k, key as kmer, coalesce(sum(cnt) filter (one_way and own = key), 0)::bigint as fwd, coalesce(sum(cnt) filter (one_way and own <> key), 0)::bigint as bwd, coalesce(sum(cnt) filter (not one_way), 0)::bigint as "both" from keyed group by all),
folded as (select {by}level, k, kmer, fwd, case when {flipped("kmer")} = kmer then -1 else bwd end as bwd, "both" from sided where not {short_period("kmer")})"""


FOLD = f"{SCAN}, {_fold('')}"
FILES = f"{_FILES}, {_fold('file, ')}, merged as (select level, k, kmer, sum(fwd)::bigint as fwd, sum(bwd)::bigint as bwd, sum(\"both\")::bigint as \"both\" from folded group by all)"
_SIGN = "case when fwd > bwd then '+' when fwd < bwd then '-' else '?' end"
REPORT = f"""{FILES} select file, level, row_number() over (partition by file, level order by fwd desc, "both" desc, k, kmer) as rank, k, translate(kmer, '0123', 'TGCA') as motif,
greatest(fwd, bwd) as most, least(fwd, bwd) as least, "both", {_SIGN} as sign from folded where fwd + bwd + "both" >= {strand.PRINT_FROM}"""

_RANKED = "row_number() over (partition by level order by {order}, k, kmer)"
VOTES = f"""{FILES}, cand as (select level, k, kmer, fwd + bwd + "both" as total, greatest(fwd, bwd) as f, least(fwd, bwd) as b from merged where fwd + bwd + "both" >= {strand.PRINT_FROM}),
two_way as (select *, {_RANKED.format(order="f desc")} as rf, {_RANKED.format(order="total desc")} as rt from cand where f > 0 and b >= 0),
votes as (select level, k, kmer from (select *, {_RANKED.format(order="f desc")} as r from cand where f > 0) where r <= {strand.TOP_FORWARD}
  union all select level, k, kmer from (select *, {_RANKED.format(order="total desc")} as r from cand) where r <= {strand.TOP_TOTAL}
  union all select level, k, kmer from (select *, {_RANKED.format(order="b / f")} as r from two_way where rf <= {strand.RATIO_CANDIDATES} or rt <= {strand.RATIO_CANDIDATES}) where r <= {strand.TOP_RATIO}),
scores as (select level, k, kmer, count(*)::int as score from votes group by all)"""
_BASES = " + ".join(f"contains(kmer, '{d}')::int" for d in "0123")
CALLS = f"""{VOTES}, both_levels as (select k, kmer, sum(score)::int as votes from scores group by all),
seen as (select s.*, coalesce(l.fwd, 0) as lf, coalesce(l.bwd, 0) as lb, coalesce(h.fwd, 0) as hf, coalesce(h.bwd, 0) as hb, sign(coalesce(l.fwd, 0) - coalesce(l.bwd, 0))::int as low, sign(coalesce(h.fwd, 0) - coalesce(h.bwd, 0))::int as high, {_BASES} as bases
  from both_levels s left join (select * from merged where level = 'low') l using (k, kmer) left join (select * from merged where level = 'high') h using (k, kmer)),
weighed as (select *, least(lf, lb) * greatest(hf, hb) as x, least(hf, hb) * greatest(lf, lb) as y from seen),
calls as (select k, kmer, (votes + (low <> 0 and low = high)::int + (bases > 2)::int)::int as score, bases,
  case when low = high then low when low = 0 then high when high = 0 then low when x = y then case when lf + lb > hf + hb then low else high end when x < y then low else high end as direction from weighed)"""
PUTATIVE = f"""{CALLS}, gate as (select coalesce(max(fwd + bwd + "both") >= {strand.ANSWER_FROM}, false) as is_open from merged)
select * from (select k, translate(kmer, '0123', 'TGCA') as motif, score, case when direction > 0 then '+' when direction < 0 then '-' else '?' end as sign from calls where (select is_open from gate) order by score desc, bases desc, k, kmer limit {strand.ANSWERS})
union all select -1, 'NO_PUTATIVE_TRM', -1, '?' where not (select is_open from gate)"""
# The motifs of the scan, on which strands and filters work.
MOTIFS = f"{SCAN}, motifs as (select distinct k, kmer from scanned)"
