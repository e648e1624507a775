"""Motif scans: reads to segments, segments to periods, periods to counts by direction.

Reads are cut into segments, and results routed to forward, backward or both, by Column
expressions on arrays that stay in the read's row; only the counting of windows is a
numpy kernel (``kernel``). The one shuffle is that of motif sums: rows combine by
(level, direction, motif) on the map side, so it carries distinct motifs and not windows.
Strands are folded afterwards, on distinct motifs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LEVELS, ScanConfig
from ..functions import alphabet as al
from .kernel import checked, checked_slices, with_flip

_COUNTS = "array<struct<kmer:string,cnt:bigint>>"
_ITEM = f"struct<level:string,direction:string,fold:boolean,counts:{_COUNTS}>"


def segment(text: Column, lo: Column | int, hi: Column | int) -> Column:
    as_int = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("int")
    return F.struct(text.alias("seg"), as_int(lo).alias("lo"), as_int(hi).alias("hi"))


def _when(cond: Column, seg: Column) -> Column:
    """The segment where it is wanted, else one that tries no period."""
    return F.when(cond, seg).otherwise(segment(F.lit(""), 1, 0))


def halves(seq: Column) -> tuple[Column, Column]:
    half = F.floor(F.length(seq) / 2).cast("int")
    return F.substr(seq, F.lit(1), half), F.substr(seq, half + 1)


def inner_range(n: Column, cfg: ScanConfig) -> tuple[Column, Column]:
    """The periods tried in half reads."""
    return F.lit(cfg.min_mer), F.least(F.floor(n / 4).cast("int"), F.lit(cfg.max_mer))


def whole_range(n: Column, cfg: ScanConfig) -> tuple[Column, Column]:
    """The periods tried in whole reads."""
    return F.greatest(F.floor(n / 4).cast("int") + 1, F.lit(cfg.min_mer)), F.least(F.floor(n / 2).cast("int"), F.lit(cfg.max_mer))


def slices(seq: Column, length: int) -> Column:
    """An array of the slices of one length; the middle one takes what is left over."""
    n, over = F.floor(F.length(seq) / length).cast("int"), F.length(seq) % length
    mid = F.floor((n + 1) / 2).cast("int")
    start = lambda i: (i - 1) * length + F.when(i > mid, over).otherwise(0) + 1
    size = lambda i: F.lit(length) + F.when(i == mid, over).otherwise(0)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(seq, start(i), size(i)))
    return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))


def other_strand(motif: Column) -> Column:
    return al.canonical(al.reverse_complement(motif))


def _item(level: str, cond: Column, direction: Column | str, fold: Column | bool, counts: Column) -> Column:
    """Counts for a direction where cond holds, else null. fold: whether both strands count as one."""
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.when(cond, F.struct(F.lit(level).alias("level"), as_column(direction).alias("direction"), as_column(fold).alias("fold"), counts.alias("counts"))).cast(_ITEM)


def _summed(rows: DataFrame, items: Column, by: tuple[str, ...]) -> DataFrame:
    """by, level, direction, k, kmer, cnt of all items."""
    each = rows.select(*by, F.explode(F.filter(items, lambda x: x.isNotNull())).alias("i")).select(*by, "i.level", "i.direction", "i.fold", F.explode("i.counts").alias("c"))
    sums = each.groupBy(*by, "level", "direction", "fold", F.col("c.kmer").alias("kmer")).agg(F.sum("c.cnt").alias("cnt"))
    folded = with_flip(sums, "kmer", "flip").withColumn("kmer", F.when(F.col("fold"), F.least("kmer", "flip")).otherwise(F.col("kmer")))
    return folded.groupBy(*by, "level", "direction", F.length("kmer").alias("k"), "kmer").agg(F.sum("cnt").alias("cnt"))


def _k(level: str, i: int) -> Column:
    return F.coalesce(F.get(F.col(level), F.lit(i))["k"], F.lit(0))


def _counts(level: str, i: int) -> Column:
    return F.get(F.col(level), F.lit(i))["counts"]


def _halves_checked(reads: DataFrame, by: tuple[str, ...], seq: str, cfg: ScanConfig) -> DataFrame:
    """by, seq, n and the results of both halves of reads that are long enough for them."""
    rows = reads.select(*by, F.coalesce(F.col(seq), F.lit("")).alias("seq")).withColumn("n", F.length("seq")).where(F.col("n") >= 2 * cfg.min_mer)
    lo, hi = inner_range(F.col("n"), cfg)
    long_enough = F.col("n") >= 4 * cfg.min_mer
    return checked(rows, F.array(*(_when(long_enough, segment(part, lo, hi)) for part in halves(F.col("seq")))), cfg)


def _targets(rows: DataFrame) -> dict[str, Column]:
    """For each level whether both halves select one period."""
    return {v: (_k(v, 0) > 0) & (_k(v, 0) == _k(v, 1)) for v in LEVELS}


def scan_short(reads: DataFrame, cfg: ScanConfig, seq: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """by, level, direction, k, kmer, cnt summed over all single-end reads.

    A read whose halves select one period counts for both directions, at that period over
    the whole read; one whose left half selects any, forward; else backward with what the
    right half selects. Where neither does, longer periods are tried over the whole read.
    """
    first = _halves_checked(reads, by, seq, cfg)
    target = _targets(first)
    open_ = {v: (_k(v, 0) == 0) & (_k(v, 1) == 0) & (F.col("n") < 4 * cfg.max_mer) for v in LEVELS}
    kept = first.select(*by, "seq", "n", *(F.when(target[v], _k(v, 0)).otherwise(0).alias(f"k_{v}") for v in LEVELS), *(open_[v].alias(f"open_{v}") for v in LEVELS), *(F.when(target[v], F.lit(None)).otherwise(_item(v, F.lit(True), F.when(_k(v, 0) > 0, "forward").otherwise("backward"), False, F.when(_k(v, 0) > 0, _counts(v, 0)).otherwise(_counts(v, 1)))).alias(f"half_{v}") for v in LEVELS))
    at = [_when(F.col(f"k_{v}") > 0, segment(F.col("seq"), F.col(f"k_{v}"), F.col(f"k_{v}"))) for v in LEVELS]
    whole = _when(reduce(Column.__or__, (F.col(f"open_{v}") for v in LEVELS)), segment(F.col("seq"), *whole_range(F.col("n"), cfg)))
    second = checked(kept, F.array(*at, whole), cfg)
    items = [F.col(f"half_{v}") for v in LEVELS]
    items += [_item(v, F.col(f"k_{v}") > 0, "both", True, _counts(v, i)) for i, v in enumerate(LEVELS)]
    items += [_item(v, F.col(f"open_{v}"), "both", False, _counts(v, len(LEVELS))) for v in LEVELS]
    return _summed(second, F.array(*items), by)


def scan_targets(reads: DataFrame, cfg: ScanConfig, seq: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """by, level, direction, k, kmer, cnt of the reads whose halves select one period: their counts at it, strands folded."""
    first = _halves_checked(reads, by, seq, cfg)
    kept = first.select(*by, "seq", *(F.when(t, _k(v, 0)).otherwise(0).alias(f"k_{v}") for v, t in _targets(first).items()))
    second = checked(kept, F.array(*(_when(F.col(f"k_{v}") > 0, segment(F.col("seq"), F.col(f"k_{v}"), F.col(f"k_{v}"))) for v in LEVELS)), cfg)
    return _summed(second, F.array(*(_item(v, F.col(f"k_{v}") > 0, "both", True, _counts(v, i)) for i, v in enumerate(LEVELS))), by)


def _count_true(conds: list[Column]) -> Column:
    return reduce(Column.__add__, (F.coalesce(c, F.lit(False)).cast("int") for c in conds))


def _in_turn(conds: list[Column]) -> list[Column]:
    """Each condition and all before it."""
    return [reduce(Column.__and__, conds[: i + 1]) for i in range(len(conds))]


def scan_paired(pairs: DataFrame, cfg: ScanConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """by, level, direction, k, kmer, cnt summed over all pairs (seq1, seq2).

    The four half reads go from the outer end of one mate to that of the other; the run
    of leading ones with the first's period and motif counts from one side, the run of
    trailing ones with the last's from the other, each with the one that ends it.
    """
    rows = pairs.select(*by, *(F.coalesce(c, F.lit("")).alias(c) for c in ("seq1", "seq2"))).withColumn("n", F.least(F.length("seq1"), F.length("seq2"))).where(F.col("n") >= 2 * cfg.min_mer)
    lo, hi = inner_range(F.col("n"), cfg)
    parts = [*halves(F.col("seq1")), *halves(F.col("seq2"))[::-1]]
    first = checked(rows, F.array(*(_when(F.col("n") >= 4 * cfg.min_mer, segment(p, lo, hi)) for p in parts)), cfg)

    motif = lambda v, i: F.get(F.col(v), F.lit(i))["motif"]
    same = lambda v, i, j: (_k(v, i) == _k(v, j)) & (motif(v, i) == (motif(v, j) if (i < 2) == (j < 2) else other_strand(motif(v, j))))
    for v in LEVELS:
        first = first.withColumn(f"m_{v}", _count_true(_in_turn([_k(v, 0) > 0, same(v, 0, 1), same(v, 0, 2), same(v, 0, 3)])))
    for v in LEVELS:
        m = F.col(f"m_{v}")
        first = first.withColumn(f"p_{v}", _count_true(_in_turn([(m < 4) & (_k(v, 3) > 0), (m < 3) & same(v, 3, 2), (m < 2) & same(v, 3, 1), (m < 1) & same(v, 3, 0)])))
    back = reduce(Column.__or__, (F.col(f"m_{v}") < 4 for v in LEVELS))
    items = []
    for v in LEVELS:
        m, p = F.col(f"m_{v}"), F.col(f"p_{v}")
        all_ = m == 4
        items += [_item(v, m >= i, F.when(all_, "both").otherwise("forward" if i < 2 else "backward"), all_, _counts(v, i)) for i in range(4)]
        items += [_item(v, ~all_ & (p >= 3 - j), "forward" if j > 1 else "backward", False, _counts(v, j)) for j in range(4)]
    short = F.col("n") < 4 * cfg.max_mer
    kept = first.select(
        *by, "seq1", "seq2", "n", F.array(*items).alias("items"),
        *((short & (_k(v, 0) == 0)).alias(f"a_{v}") for v in LEVELS),
        *((short & (F.when(F.col(f"m_{v}") < 4, _k(v, 3)).when(back, 0).otherwise(_k(v, 0)) == 0)).alias(f"b_{v}") for v in LEVELS),
    )
    lo, hi = whole_range(F.col("n"), cfg)
    wanted = lambda side: reduce(Column.__or__, (F.col(f"{side}_{v}") for v in LEVELS))
    second = checked(kept, F.array(_when(wanted("a"), segment(F.col("seq1"), lo, hi)), _when(wanted("b"), segment(F.col("seq2"), lo, hi))), cfg)
    more = []
    for v in LEVELS:
        a, b = F.col(f"a_{v}"), F.col(f"b_{v}")
        mirrored = a & b & (_k(v, 0) > 0) & same_mates(v)
        for cond, i in ((a, 0), (b, 1)):
            more += [_item(v, cond, "forward", False, _counts(v, i)), _item(v, mirrored, "both", True, _counts(v, i))]
    return _summed(second, F.concat(F.col("items"), F.array(*more)), by)


def same_mates(level: str) -> Column:
    a, b = F.get(F.col(level), F.lit(0)), F.get(F.col(level), F.lit(1))
    return (a["k"] == b["k"]) & (a["motif"] == other_strand(b["motif"]))


def _slices_checked(reads: DataFrame, keys: tuple[str, ...], seq: str, cfg: ScanConfig, counts: bool = True) -> DataFrame:
    """keys, the results of each slice of reads that hold one, and for each level how many lead and trail with one period."""
    rows = reads.where(F.length(seq) >= cfg.slice_length).select(*keys, F.col(seq).alias("__seq"))
    found = checked_slices(rows, "__seq", cfg, counts)
    for v in LEVELS:
        found = found.withColumn(f"m_{v}", _leading(F.col(v)))
    for v in LEVELS:
        found = found.withColumn(f"p_{v}", _leading(F.reverse(F.slice(F.col(v), F.col(f"m_{v}") + 1, F.size(v) - F.col(f"m_{v}")))))
    return found


def _leading(found: Column) -> Column:
    """How many leading results have the period of the first, if that has one."""
    k = F.coalesce(F.get(found, F.lit(0))["k"], F.lit(0))
    end = F.array_position(F.transform(found, lambda t: t["k"] != k), True)
    return F.when(k == 0, 0).when(end == 0, F.size(found)).otherwise(end - 1).cast("int")


def _prefix_items(level: str) -> Column:
    m, n = F.col(f"m_{level}"), F.size(level)
    run = F.slice(F.col(level), F.lit(1), F.least(n, m + 1))
    return F.transform(run, lambda t: _item(level, F.lit(True), F.when(m == n, "both").otherwise("forward"), m == n, t["counts"]))


def _suffix_items(level: str) -> Column:
    p, n = F.col(f"p_{level}"), F.size(level)
    return F.transform(F.slice(F.col(level), n - p, p + 1), lambda t: _item(level, F.lit(True), "backward", False, t["counts"]))


def scan_long(reads: DataFrame, cfg: ScanConfig, seq: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """by, level, direction, k, kmer, cnt summed over all long reads.

    The run of leading slices with the first's period counts forward with the one that
    ends it, or for both directions where it is the whole read; the run of trailing
    slices after it, with the one before that, backward, if any level's run was cut.
    """
    found = _slices_checked(reads, by, seq, cfg)
    back = reduce(Column.__or__, (F.col(f"m_{v}") < F.size(v) for v in LEVELS))
    items = reduce(list.__add__, ([_prefix_items(v), F.when(back, _suffix_items(v)).otherwise(F.array().cast(f"array<{_ITEM}>"))] for v in LEVELS))
    return _summed(found, F.concat(*items), by)


def slice_runs(reads: DataFrame, cfg: ScanConfig, keys: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """keys, level, slices, leading and trailing: how many slices a read has, and lead and, after these, trail with one period."""
    found = _slices_checked(reads, keys, seq, cfg, counts=False)
    each = F.array(*(F.struct(F.lit(v).alias("level"), F.size(v).alias("slices"), F.col(f"m_{v}").alias("leading"), F.col(f"p_{v}").alias("trailing")) for v in LEVELS))
    return found.select(*keys, F.inline(each))


def slice_targets(reads: DataFrame, keys: tuple[str, ...], cfg: ScanConfig, seq: str = "seq") -> DataFrame:
    """keys, slice (from 1), level, k, motif, motif_count for each slice and level; k is 0 where none is selected."""
    rows = reads.where(F.length(seq) >= cfg.slice_length).select(*keys, F.col(seq).alias("__seq"))
    each = checked_slices(rows, "__seq", cfg, counts=False).select(*keys, F.inline(F.arrays_zip(F.sequence(F.lit(1), F.size(LEVELS[0])).alias("slice"), *LEVELS)).alias("slice", *LEVELS))
    return each.select(*keys, "slice", F.inline(F.array(*(F.struct(F.lit(v).alias("level"), *(F.col(v)[c].alias(c) for c in ("k", "motif", "motif_count"))) for v in LEVELS))))


def segment_targets(segments: DataFrame, keys: list[str], cfg: ScanConfig, lo: Column | int | None = None, hi: Column | int | None = None) -> DataFrame:
    """keys, level, k, motif, motif_count for each segment (column seg) and level; k is 0 where none is selected."""
    rows = segments.select(*keys, F.array(segment(F.col("seg"), cfg.min_mer if lo is None else lo, cfg.max_mer if hi is None else hi)).alias("__one"))
    found = checked(rows, F.col("__one"), cfg)
    each = F.array(*(F.struct(F.lit(v).alias("level"), *(F.get(F.col(v), F.lit(0))[c].alias(c) for c in ("k", "motif", "motif_count"))) for v in LEVELS))
    return found.select(*keys, F.inline(each))
