"""Segment checks in SQL over many windows, with a window as a number.

A place's next 32 bases are one unsigned number of two bits a base, so its window of k
bases is a shift, its rotations are shifts and ors, and its composition is a few bit
counts. One branch for each period is written out. Motifs become digits at the end only.
"""

from __future__ import annotations

from ..config import ScanConfig
from ..sources import reads as rd
from .scan_sql import ENC, READS, flipped

CFG = ScanConfig()
_LOW_BITS = 0x5555555555555555


def _window(k: int) -> str:
    return f"(v32 >> {64 - 2 * k})" if k < 32 else "v32"


def least_rotation(v: str, k: int) -> str:
    turns = [f"((({v} & {4 ** (k - i) - 1}::ubigint) << {2 * i}) | ({v} >> {2 * (k - i)}))" for i in range(1, k)]
    return f"least({', '.join([v, *turns])})"


def _ones(v: str) -> str:
    """How many bits are set: in two halves, as a signed number holds neither sign nor more."""
    return f"(bit_count(({v} >> 32)::bigint)::int + bit_count(({v} & 4294967295::ubigint)::bigint)::int)"


def _composition(v: str) -> str:
    low, high = f"({v} & {_LOW_BITS}::ubigint)", f"(({v} >> 1) & {_LOW_BITS}::ubigint)"
    return f"({_ones(low)} * 4096 + {_ones(high)} * 64 + {_ones(f'({low} & {high})')})"


def digits(v: str, k: str = "k") -> str:
    return f"array_to_string(list_transform(range({k}::int - 1, -1, -1), lambda j: (({v} >> (2 * j)::ubigint) & 3::ubigint)::varchar), '')"


def spots(parts: str) -> str:
    """CTE spots: every place of ``parts`` (read_id, part, enc, lo, hi) with the bases from it on, and how many of them are valid."""
    double = lambda name, n: f"({name} << {2 * n}) | lead({name}, {n}, 0::ubigint) over bases as "
    return f"""places as (select read_id, part, lo, hi, unnest(string_split(enc, '')) as base, unnest(range(1, length(enc) + 1))::int as pos from {parts} where enc <> ''),
coded as (select read_id, part, lo, hi, pos, base in ('0', '1', '2', '3') as fine, case when base in ('1', '2', '3') then base::ubigint else 0::ubigint end as v1 from places),
v2s as (select *, {double("v1", 1)} v2, coalesce(min(case when not fine then pos end) over (bases rows between current row and unbounded following), max(pos) over (partition by read_id, part) + 1) - pos as valid from coded window bases as (partition by read_id, part order by pos)),
v4s as (select *, {double("v2", 2)} v4 from v2s window bases as (partition by read_id, part order by pos)),
v8s as (select *, {double("v4", 4)} v8 from v4s window bases as (partition by read_id, part order by pos)),
v16s as (select *, {double("v8", 8)} v16 from v8s window bases as (partition by read_id, part order by pos)),
spots as materialized (select read_id, part, lo, hi, pos, valid, {double("v16", 16)} v32 from v16s window bases as (partition by read_id, part order by pos))"""


def _each_k(branch) -> str:
    return " union all ".join(branch(k) for k in range(CFG.min_mer, CFG.max_mer + 1))


def _of(k: int) -> str:
    return f"from spots where valid >= {k} and {k} between lo and hi"


def selected(parts: str) -> str:
    """CTEs after ``parts``: counted (motif as a number, at periods that can be selected), leads, and chosen by level."""
    levels = ", ".join(f"('{v}', {b})" for v, b in CFG.baselines.items())
    return f"""{spots(parts)},
usable as materialized (select read_id, part, k, sum(n)::bigint as total from (
  {_each_k(lambda k: f"select read_id, part, {k} as k, {_composition(_window(k))} as mix, count(*) as n {_of(k)} group by all")}) group by all having max(n) >= {CFG.low_baseline} * sum(n)),
counted as materialized ({_each_k(lambda k: f"select read_id, part, {k} as k, total, {least_rotation('v', k)} as motif, count(*) as cnt, max(pos) as last from (select read_id, part, pos, {_window(k)} as v {_of(k)}) join (select * from usable where k = {k}) using (read_id, part) group by all")}),
leads as (select read_id, part, k, max(cnt) as top, max(cnt) / max(total) as share, arg_min(motif, {{'a': -cnt, 'b': last}}) as lead from counted group by all),
motifs as (select read_id, part, k, top, share, {digits("lead")} as motif from leads),
periods as (select read_id, part, list({{'k': k, 'share': share, 'seen': []::int[]}} order by k) as ks from motifs where motif <> repeat(motif[1], k) group by all),
levels(level, base) as (values {levels}),
chosen as (select read_id, part, level, list_reduce(ks, lambda a, x: case when x.share >= greatest(base, a.share) and len(list_filter(a.seen, lambda t: x.k % t = 0)) = 0 then {{'k': x.k, 'share': x.share, 'seen': list_append(a.seen, x.k)}} else a end, {{'k': 0, 'share': 0.0::double, 'seen': []::int[]}}).k as k from periods, levels)"""


# Distinct motifs, and sums over them that tell which ones were counted how often, of each read and period.
MODULI = (1_000_000_007, 998_244_353)
MODES = f"""{READS}, whole as (select read_id, 0 as part, {ENC} as enc, {CFG.min_mer} as lo, {CFG.max_mer} as hi from reads), {spots("whole")},
counts as ({_each_k(lambda k: f"select read_id, {k}::int as k, {least_rotation('v', k)} as motif, count(*) as cnt, max(pos) as last from (select read_id, pos, {_window(k)} as v {_of(k)}) group by all")}),
modes as (select read_id, k, sum(cnt)::bigint as total, count(*) as motifs, sum(cnt * cnt)::bigint as squares, sum(cnt * (motif % {MODULI[0]})::bigint)::bigint as by_count, sum(cnt * cnt * (motif % {MODULI[1]})::bigint)::bigint as by_square, max(cnt) as most, arg_min(motif, {{'a': -cnt, 'b': last}}) as lead from counts group by read_id, k)"""

SLICES = f"""with reads as ({rd.LONG_SQL}), sized as (select read_id, {ENC} as enc, length(seq) // {CFG.slice_length} as n, length(seq) % {CFG.slice_length} as over from reads where length(seq) >= {CFG.slice_length}),
cut as (select *, unnest(range(1, n + 1))::int as part, (n + 1) // 2 as mid from sized),
slices as (select read_id, part, n, {CFG.min_mer} as lo, {CFG.max_mer} as hi, substr(enc, (part - 1) * {CFG.slice_length} + case when part > mid then over else 0 end + 1, {CFG.slice_length} + case when part = mid then over else 0 end) as enc from cut), {selected("slices")},
found as (select s.read_id, s.part, s.n, level, coalesce(c.k, 0)::int as k from slices s cross join levels left join chosen c using (read_id, part, level))"""
SEGMENT_CHECK = f"""{SLICES} select f.read_id, f.part as slice, level, f.k, coalesce(motif, '') as motif, coalesce(top, 0)::bigint as motif_count from found f left join motifs using (read_id, part, k)"""


def _leading(ks: str) -> str:
    """How many leading periods of a list equal the first, if that is one."""
    return f"(case when len({ks}) = 0 or {ks}[1] = 0 then 0 else coalesce(nullif(list_position(list_transform({ks}, lambda x: x <> {ks}[1]), true), 0) - 1, len({ks})) end)::bigint"


RUNS = f"""{SLICES}, rows as (select read_id, level, n, list(k order by part) as ks from found group by all),
led as (select *, {_leading("ks")} as m from rows), runs as (select *, {_leading("rest")} as p from (select *, list_reverse(ks[m + 1:]) as rest from led))"""
LONG_SCAN = f"""{RUNS}, backs as (select read_id, bool_or(m < n) as back from runs group by read_id),
routes as (select read_id, level, unnest(range(1, least(n, m + 1) + 1))::int as part, case when m = n then 'both' else 'forward' end as direction, m = n as fold from runs
  union all select read_id, level, unnest(range(greatest(n - p, 1), n + 1))::int, 'backward', false from runs join backs using (read_id) where back),
sums as (select level, direction, fold, k, c.motif as lead, sum(cnt)::bigint as cnt from routes join found f using (read_id, part, level) join counted c using (read_id, part, k) group by all),
spelled as (select *, {digits("lead")} as motif from sums)
select level, direction, k, case when fold then least(motif, {flipped("motif")}) else motif end as kmer, sum(cnt)::bigint as cnt from spelled group by all"""

_N, _MIN, _MAX = "least(length(seq1), length(seq2))", CFG.min_mer, CFG.max_mer
_PART = {1: "substr(e1, 1, length(e1) // 2)", 2: "substr(e1, length(e1) // 2 + 1)", 3: "substr(e2, length(e2) // 2 + 1)", 4: "substr(e2, 1, length(e2) // 2)"}
_K = ", ".join(f"coalesce(max(k) filter (part = {i}), 0) as k{i}, coalesce(max(motif) filter (part = {i}), '') as m{i}" for i in range(1, 7))


def _same(i: int, j: int) -> str:
    other = f"m{j}" if (i < 3) == (j < 3) else f"(case when m{j} = '' then '' else {flipped(f'm{j}')} end)"
    return f"(k{i} = k{j} and m{i} = {other})"


def _in_turn(conds: list[str]) -> str:
    """How many conditions hold before the first that doesn't."""
    return "case " + " ".join(f"when not ({c}) then {i}" for i, c in enumerate(conds)) + f" else {len(conds)} end"


def _items(part: int, cond: str, direction: str, fold: str) -> str:
    return f"select read_id, level, {part} as part, k{part} as k, {direction} as direction, {fold} as fold from pos where k{part} > 0 and {cond}"


_ROUTES = [_items(i, f"m >= {i - 1}", f"case when m = 4 then 'both' else '{'forward' if i < 3 else 'backward'}' end", "m = 4") for i in range(1, 5)]
_ROUTES += [_items(j, f"m < 4 and p >= {4 - j}", f"'{'forward' if j > 2 else 'backward'}'", "false") for j in range(1, 5)]
for _i, _open in ((5, "a"), (6, "b")):
    _ROUTES += [_items(_i, _open, "'forward'", "false"), _items(_i, f"a and b and k5 > 0 and k5 = k6 and m5 = {flipped('m6')}", "'both'", "true")]
PAIRED_SCAN = f"""with reads as ({rd.SHORT_SQL}), pairs as ({rd.PAIRED_SQL}),
sized as (select read_id, {_N} as n, {ENC.replace("seq", "seq1")} as e1, {ENC.replace("seq", "seq2")} as e2 from pairs where {_N} >= {2 * _MIN}),
pieces as ({" union all ".join(f"select read_id, {i} as part, {p} as enc, {_MIN} as lo, least(n // 4, {_MAX}) as hi from sized where n >= {4 * _MIN}" for i, p in _PART.items())}
  {" ".join(f"union all select read_id, {i}, {e}, greatest(n // 4 + 1, {_MIN}), least(n // 2, {_MAX}) from sized where n < {4 * _MAX}" for i, e in ((5, "e1"), (6, "e2")))}), {selected("pieces")},
told as (select read_id, part, level, k, motif from chosen join motifs using (read_id, part, k)),
wide as (select z.read_id, z.n, level, {_K} from sized z cross join levels left join told using (read_id, level) group by all),
led as (select *, {_in_turn(["k1 > 0", _same(1, 2), _same(1, 3), _same(1, 4)])} as m from wide),
ended as (select *, {_in_turn(["m < 4 and k4 > 0", f"m < 3 and {_same(4, 3)}", f"m < 2 and {_same(4, 2)}", f"m < 1 and {_same(4, 1)}"])} as p, bool_or(m < 4) over (partition by read_id) as back from led),
pos as (select *, n < {4 * _MAX} and k1 = 0 as a, n < {4 * _MAX} and (case when m < 4 then k4 when back then 0 else k1 end) = 0 as b from ended),
routes as ({" union all ".join(_ROUTES)}),
sums as (select level, direction, fold, k, c.motif as lead, sum(cnt)::bigint as cnt from routes join counted c using (read_id, part, k) group by all),
spelled as (select *, {digits("lead")} as motif from sums)
select level, direction, k::int as k, case when fold then least(motif, {flipped("motif")}) else motif end as kmer, sum(cnt)::bigint as cnt from spelled group by all"""
