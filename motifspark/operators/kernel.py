"""The window counter: for each segment the period that a level selects, and its counts.

Segments come as an array column, ``struct<seg: string, lo: int, hi: int>``: a text and
the periods to try in it. Each Arrow batch is one run of base codes; for one period
after the other all windows of all segments are counted together in numpy:

* equal segments of some neighbouring rows are counted once;
* the windows of one motif of k bases begin with k different words at most, so a segment
  whose k commonest words make up too little is left out, before anything else if that
  holds for all its periods;
* windows of one canonical motif have one base composition, so a segment whose
  commonest composition is too rare for a period is left out of it;
* windows left are packed into 64-bit words (two above 32 bases), distinct ones are
  rotated to their least rotation, and (segment, motif) pairs are sorted and counted.

A level accepts a period if its leading motif has the level's share or more, no less
than the last accepted one, is no homopolymer, and no accepted period divides it. Of
equal counts the motif that reached it first leads. All counts at the last accepted
period are the segment's result.

Defined results: a null text is empty; only T, G, C and A, in either case, are bases;
windows that hold another character don't count; a null or empty array has no results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..config import LEVELS, ScanConfig

CHUNK_BASES = 1 << 20  # of distinct segments that are counted together
ROWS_BASES = 1 << 22  # of rows whose segments are compared
DIGEST_BASES = 1 << 15
WORD = 8
SLACK = 1e-6  # for shares that are equal but for rounding
_BAD = 4
_CODE = np.full(256, _BAD, np.uint8)
for _pair, _digit in (("Tt", 0), ("Gg", 1), ("Cc", 2), ("Aa", 3)):
    _CODE[[ord(c) for c in _pair]] = _digit
_U = np.uint64
FOUND = "array<struct<k:int,motif:string,motif_count:bigint,total:bigint,counts:array<struct<kmer:string,cnt:bigint>>>>"
TOLD = "array<struct<k:int,motif:string,motif_count:bigint,total:bigint>>"
_COUNT = pa.struct([("kmer", pa.string()), ("cnt", pa.int64())])


class Words:
    """Windows or motifs of k bases packed in two bits each; the bases before the last 32 in a second word."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray | None):
        self.k, self.low, self.high = k, low, high

    def take(self, i: np.ndarray) -> Words:
        return Words(self.k, self.low[i], None if self.high is None else self.high[i])

    def distinct(self) -> tuple[Words, np.ndarray]:
        """The distinct values in order, and the place of each one among them."""
        if self.high is None:
            low, inverse = np.unique(self.low, return_inverse=True)
            return Words(self.k, low, None), inverse
        order = np.lexsort((self.low, self.high))
        low, high = self.low[order], self.high[order]
        new = np.ones(len(order), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return Words(self.k, low[new], high[new]), inverse

    def least_rotation(self) -> Words:
        low, high, k = self.low, self.high, self.k
        best_low, best_high = low, high
        if high is None:
            mask, top = _U((1 << 2 * k) - 1), _U(2 * (k - 1))
            for _ in range(k - 1):
                low = ((low << _U(2)) & mask) | (low >> top)
                best_low = np.minimum(best_low, low)
            return Words(k, best_low, None)
        mask, top = _U((1 << 2 * (k - 32)) - 1), _U(2 * (k - 33))
        for _ in range(k - 1):
            low, high = (low << _U(2)) | (high >> top), ((high << _U(2)) & mask) | (low >> _U(62))
            less = (high < best_high) | ((high == best_high) & (low < best_low))
            best_low, best_high = np.where(less, low, best_low), np.where(less, high, best_high)
        return Words(k, best_low, best_high)

    def one_base(self) -> np.ndarray:
        """Which are one base throughout."""
        digit = self.low & _U(3)
        ones = lambda n: digit * _U(int("01" * n, 2))
        out = self.low == ones(min(self.k, 32))
        return out if self.high is None else out & (self.high == ones(self.k - 32))

    def modulo(self, m: int) -> np.ndarray:
        """The values as numbers of two bits a base, modulo m."""
        low = (self.low % _U(m)).astype(np.int64)
        return low if self.high is None else (low + (self.high % _U(m)).astype(np.int64) * ((1 << 64) % m)) % m

    def strings(self) -> np.ndarray:
        """Digits, one base a character, as numpy byte strings."""
        digits = np.empty((len(self.low), self.k), np.uint8)
        for j in range(self.k):
            word = self.low if j < 32 else self.high
            digits[:, self.k - 1 - j] = ((word >> _U(2 * (j % 32))) & _U(3)).astype(np.uint8) + 48
        return digits.view(f"S{self.k}").ravel()


class _Counted:
    """The counts of some segments at one period: rows (segment, motif, count) in order of segment."""

    def __init__(self, segment: np.ndarray, motif: np.ndarray, count: np.ndarray, words: Words, lead: np.ndarray, top: np.ndarray, total: np.ndarray):
        self.segment, self.motif, self.count, self.words = segment, motif, count, words
        self.lead, self.top, self.total = lead, top, total  # by segment number


class _Run:
    """Segments side by side as base codes, each ended by a character that is no base."""

    def __init__(self, texts: list[bytes]):
        self.length = np.array([len(t) for t in texts], np.int64)
        codes = _CODE[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        self.begin = np.concatenate([[0], np.cumsum(self.length + 1)])[:-1]
        self.where = np.repeat(np.arange(len(texts)), self.length + 1)
        index, bad = np.arange(len(codes)), codes == _BAD
        self.valid = np.minimum.accumulate(np.where(bad, index, len(codes))[::-1])[::-1] - index  # bases up to the next other character
        self.composition = np.concatenate([[0], np.cumsum(np.array([0, 1, 1 << 7, 1 << 14, 0], np.int64)[codes])])
        self.base = np.where(bad, 0, codes).astype(np.uint64)

    def windows(self, top_k: int) -> Iterator[tuple[int, Words]]:
        """Each k up to top_k and the windows that start at each place (those with k valid bases are meant)."""
        size = len(self.base)
        low, high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        for k in range(1, min(top_k, int(self.length.max(initial=0))) + 1):
            ahead = np.zeros(size, np.uint64)
            ahead[: size - k + 1] = self.base[k - 1 :]
            if k > 32:
                high = (high << _U(2)) | (low >> _U(62))
            low = (low << _U(2)) | ahead
            yield k, Words(k, low, high if k > 32 else None)


def _longest_equal(sorted_keys: np.ndarray, shift: int, n: int) -> np.ndarray:
    """For each of n segments (the key above shift) the length of its longest run of equal keys."""
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    size = np.diff(np.append(at, len(sorted_keys)))
    out = np.zeros(n, np.int64)
    np.maximum.at(out, sorted_keys[at] >> shift, size)
    return out


def _count(words: Words, segment: np.ndarray, place: np.ndarray, n: int, total: np.ndarray) -> _Counted:
    """place: where a window starts in its segment."""
    distinct, inverse = words.distinct()
    motifs, of_distinct = distinct.least_rotation().distinct()
    width, reach = len(motifs.low), int(place.max()) + 1
    keys = np.sort((segment * width + of_distinct[inverse]) * reach + place)
    group = keys // reach
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.append(at[1:], len(keys)) - 1
    count, last = end - at + 1, keys[end] % reach
    seg, motif = group[at] // width, group[at] % width
    # The count, then the earliest place at which it was reached.
    score = count * reach + (reach - 1 - last)
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    best = np.maximum.reduceat(score, first)
    lead, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
    is_best = score == np.repeat(best, np.diff(np.append(first, len(seg))))
    lead[seg[is_best]], top[seg[is_best]] = motif[is_best], count[is_best]
    return _Counted(seg, motif, count, motifs, lead, top, total)


def _covered(run: _Run, lo: np.ndarray, top_k: int) -> np.ndarray:
    """For each segment and k up to top_k how many places the k commonest words of min(lo, WORD) bases have."""
    n, size = len(run.length), len(run.base)
    word = run.base.astype(np.uint32)
    for j in (1, 2, 4):  # words of twice as many bases, WORD in the end
        word = (word << (2 * j)) | np.append(word[j:], np.zeros(min(j, size), np.uint32))
    bases = np.clip(lo, 1, WORD)
    word >>= (2 * (WORD - bases)).astype(np.uint32)[run.where]
    keys = np.uint32 if n <= 1 << 32 - 2 * WORD else np.uint64
    keys = np.sort(((run.where.astype(keys) << keys(2 * WORD)) | word)[run.valid >= bases[run.where]])
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    count, owner = np.diff(np.append(first, len(keys))), (keys[first] >> keys.dtype.type(2 * WORD)).astype(np.int64)
    order = np.lexsort((-count, owner))
    count, owner = count[order], owner[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner]
    out = np.zeros((n, top_k + 1), np.int64)
    few = rank < top_k
    out[owner[few], rank[few] + 1] = count[few]
    return np.cumsum(out, axis=1)


def _totals(run: _Run, top_k: int) -> np.ndarray:
    """For each segment and k up to top_k how many windows are valid."""
    n = len(run.length)
    starts = np.flatnonzero((run.valid > 0) & np.concatenate([[True], run.valid[:-1] == 0]))
    length, out = run.valid[starts], np.zeros((n, top_k + 1), np.int64)
    for k in range(1, top_k + 1):
        np.add.at(out[:, k], run.where[starts], np.maximum(length - k + 1, 0))
    return out


def may_repeat(texts: list[bytes], lo: np.ndarray, hi: np.ndarray, cfg: ScanConfig) -> np.ndarray:
    """Whether a text could have any result: false where the commonest words are too rare for all its periods."""
    run, k = _Run(texts), np.arange(int(hi.max(initial=0)) + 1)
    total = _totals(run, len(k) - 1)
    enough = (total > 0) & (_covered(run, lo, len(k) - 1) >= min(cfg.baselines.values()) * total - SLACK)
    return (enough & (lo[:, None] <= k) & (k <= hi[:, None])).any(1)


def check(texts: list[bytes], lo: np.ndarray, hi: np.ndarray, cfg: ScanConfig) -> dict[str, list[tuple[np.ndarray, _Counted]]]:
    """For each level pairs of segment numbers and the counts at the period that these select."""
    n = len(texts)
    if not n:
        return {v: [] for v in LEVELS}
    run = _Run(texts)
    where, valid, composition = run.where, run.valid, run.composition
    tk, share = {v: np.zeros(n, np.int64) for v in LEVELS}, {v: np.zeros(n) for v in LEVELS}
    taken = {v: np.zeros((n, cfg.max_mer + 1), bool) for v in LEVELS}
    kept: dict = {v: [] for v in LEVELS}
    top_k = min(int(hi.max(initial=0)), int(run.length.max(initial=0)))
    totals, covered = _totals(run, top_k), _covered(run, lo, top_k)
    for k, window in run.windows(top_k):
        tried = (lo <= k) & (k <= hi)
        if not tried.any():
            continue
        divisors = [d for d in range(1, k + 1) if k % d == 0]
        free = {v: tried & ~taken[v][:, divisors].any(1) for v in LEVELS}
        needed = np.minimum.reduce([np.where(free[v], np.maximum(cfg.baselines[v], share[v]), np.inf) for v in LEVELS])
        total = totals[:, k]
        ok = np.isfinite(needed) & (total > 0)
        ok &= covered[:, k] >= np.where(ok, needed, 0) * total - SLACK
        if not ok.any():
            continue
        at = np.flatnonzero((valid >= k) & ok[where])
        segment = where[at]
        bound = _longest_equal(np.sort((segment << 21) | (composition[at + k] - composition[at])), 21, n)
        ok &= bound >= np.where(ok, needed, 0) * total - SLACK
        mine = ok[segment]
        at, segment = at[mine], segment[mine]
        if not len(at):
            continue
        got = _count(window.take(at), segment, at - run.begin[segment], n, total)
        plain = got.words.one_base()
        found = np.divide(got.top, total, out=np.zeros(n), where=total > 0)
        for v in LEVELS:
            accepted = ok & free[v] & (got.top > 0) & (found >= np.maximum(cfg.baselines[v], share[v])) & ~plain[got.lead]
            if accepted.any():
                tk[v][accepted], share[v][accepted] = k, found[accepted]
                taken[v][accepted, k] = True
                kept[v].append((k, np.flatnonzero(accepted), got))
    return {v: [(s[tk[v][s] == k], got) for k, s, got in kept[v] if (tk[v][s] == k).any()] for v in LEVELS}


def _column(found: list[tuple[np.ndarray, _Counted]], n: int) -> pa.Array:
    """One struct of FOUND for each of n segments."""
    k, total, top = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    lead, owner, kmer, cnt = np.zeros(n, "S64"), [np.empty(0, np.int64)], [np.empty(0, "S1")], [np.empty(0, np.int64)]
    for s, got in found:
        k[s], total[s], top[s] = got.words.k, got.total[s], got.top[s]
        rows = np.flatnonzero(np.isin(got.segment, s))
        used, at = np.unique(np.concatenate([got.motif[rows], got.lead[s]]), return_inverse=True)
        text = got.words.take(used).strings()[at]
        lead[s] = text[len(rows) :]
        owner.append(got.segment[rows])
        kmer.append(text[: len(rows)])
        cnt.append(got.count[rows])
    seg = np.concatenate(owner)
    order = np.argsort(seg, kind="stable")
    kmers = pa.array([x for part in kmer for x in part.tolist()], pa.binary()).take(pa.array(order)).cast(pa.string())
    counts = pa.StructArray.from_arrays([kmers, pa.array(np.concatenate(cnt)[order])], fields=list(_COUNT))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(seg[order], np.arange(n + 1)).astype(np.int32)), counts)
    return pa.StructArray.from_arrays([pa.array(k), pa.array(lead.tolist(), pa.binary()).cast(pa.string()), pa.array(top), pa.array(total), lists], ["k", "motif", "motif_count", "total", "counts"])


def _found_once(seg: pa.Array, lo: np.ndarray, hi: np.ndarray, cfg: ScanConfig) -> tuple[dict[str, pa.Array], np.ndarray]:
    """For each level the results of distinct segments, the last one of them empty, and the place of each segment among them."""
    coded = seg.dictionary_encode()
    names = [t.encode("latin-1", "replace") for t in coded.dictionary.to_pylist()]
    # A range without a period is the same as any other.
    code, lo, hi = (np.where(lo <= hi, x, y) for x, y in ((coded.indices.to_numpy(), 0), (lo, 1), (hi, 0)))
    top = int(max(lo.max(initial=0), hi.max(initial=0))) + 1
    _, first, inverse = np.unique((code * top + lo) * top + hi, return_index=True, return_inverse=True)
    texts, lo, hi = [names[i] for i in code[first]], lo[first], hi[first]
    place, parts, done = np.full(len(texts), -1), {v: [] for v in LEVELS}, 0
    for a, b in _spans(np.cumsum([len(t) for t in texts]), CHUNK_BASES):
        some = a + np.flatnonzero(may_repeat(texts[a:b], lo[a:b], hi[a:b], cfg))
        found = check([texts[i] for i in some], lo[some], hi[some], cfg)
        place[some] = done + np.arange(len(some))
        done += len(some)
        for v in LEVELS:
            parts[v].append(_column(found[v], len(some)))
    place[place < 0] = done
    return {v: pa.concat_arrays([*parts[v], _column([], 1)]) for v in LEVELS}, place[inverse]


def checked(df: DataFrame, segments: Column, cfg: ScanConfig) -> DataFrame:
    """df and for each level an array with the result of each segment, in their order (``k`` is 0 where none is selected)."""
    return _checked(df.withColumn("__segments", segments.cast("array<struct<seg:string,lo:int,hi:int>>")), "__segments", df.columns, cfg, True)


def checked_slices(df: DataFrame, seq: str, cfg: ScanConfig, counts: bool = True) -> DataFrame:
    """df without seq, and for each level an array with the results of seq's slices. seq must hold a slice at least; counts: whether results hold them."""
    return _checked(df, seq, [c for c in df.columns if c != seq], cfg, counts)


def _slices(column: pa.Array, length: int) -> tuple[np.ndarray, pa.Array]:
    """Ends of rows' slices, from 0, and the slices: all of a text one after the other, the middle one with what is left over."""
    column = pa.compute.fill_null(column, "")
    size = pa.compute.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    n = size // length
    bound = np.concatenate([[0], np.cumsum(n)])
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(row)) - bound[row]
    at = begin[row] + i * length + np.where(i >= (n[row] + 1) // 2, size[row] % length, 0)
    text = "".join(column.to_pylist())
    at = np.append(at, len(text)).tolist()
    return bound, pa.array([text[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.string())


def _checked(df: DataFrame, segments: str, keep: list[str], cfg: ScanConfig, counts: bool) -> DataFrame:
    """segments: a column of segments, or of texts that are cut into slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(segments)
            if pa.types.is_string(rows.type):
                bound, seg = _slices(rows, cfg.slice_length)
                lo, hi = np.full(len(seg), cfg.min_mer), np.full(len(seg), cfg.max_mer)
            else:
                bound = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(rows), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
                flat = rows.flatten()
                seg = pa.compute.fill_null(flat.field("seg"), "")
                lo, hi = (pa.compute.fill_null(flat.field(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
            weight = np.concatenate([[0], np.cumsum(pa.compute.binary_length(seg).to_numpy(zero_copy_only=False), dtype=np.int64)])[bound]
            for row, to in _spans(weight[1:], ROWS_BASES):
                a, b = int(bound[row]), int(bound[to])
                found, inverse = _found_once(seg.slice(a, b - a), lo[a:b], hi[a:b], cfg)
                if not counts:
                    found = {v: pa.StructArray.from_arrays([x.field(i) for i in range(4)], ["k", "motif", "motif_count", "total"]) for v, x in found.items()}
                end = np.cumsum(np.diff(bound[row : to + 1]))
                # Results may be many times a row's text.
                for x, y in _spans(weight[row + 1 : to + 1] - weight[row], CHUNK_BASES):
                    skip = int(end[x - 1]) if x else 0
                    offsets, at = pa.array(np.concatenate([[0], end[x:y] - skip]).astype(np.int32)), pa.array(inverse[skip : int(end[y - 1])])
                    results = [pa.ListArray.from_arrays(offsets, found[v].take(at)) for v in LEVELS]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row + x, y - x) for c in keep), *results], [*keep, *LEVELS])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in keep) + ", ".join(f"{v} {FOUND if counts else TOLD}" for v in LEVELS)
    return df.mapInArrow(run, schema)


MODES = "array<struct<k:int,total:bigint,motifs:bigint,squares:bigint,by_count:bigint,by_square:bigint,most:bigint,kmer:string>>"
MODULI = (1_000_000_007, 998_244_353)  # of the sums that tell which motifs were counted


def _modes_of(texts: list[bytes], cfg: ScanConfig) -> tuple[np.ndarray, list[np.ndarray]]:
    """The segments, and the columns of MODES, of each segment and period with a window, in order of these."""
    n, run = len(texts), _Run(texts)
    owner, columns = [np.empty(0, np.int64)], [[np.empty(0, t) for t in (np.int32, *[np.int64] * 6, "S1")]]
    for k, window in run.windows(cfg.max_mer):
        at = np.flatnonzero(run.valid >= k)
        if k < cfg.min_mer or not len(at):
            continue
        segment = run.where[at]
        total = np.bincount(segment, minlength=n)
        got = _count(window.take(at), segment, at - run.begin[segment], n, total)
        some, words = np.flatnonzero(total), got.words
        sums = []
        for weight in (1, got.count**2, got.count * words.modulo(MODULI[0])[got.motif], got.count**2 * words.modulo(MODULI[1])[got.motif]):
            of = np.zeros(n, np.int64)
            np.add.at(of, got.segment, weight)
            sums.append(of[some])
        owner.append(some)
        columns.append([np.full(len(some), k, np.int32), total[some], *sums, got.top[some], got.words.take(got.lead[some]).strings()])
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(owner)[order], [np.concatenate(c).take(order) for c in zip(*columns, strict=True)]


def modes(df: DataFrame, seq: str, cfg: ScanConfig) -> DataFrame:
    """df without seq, and ``modes``: for each period with a valid window in seq the number of windows, of motifs, the sum of squared counts, of count times motif and squared count times motif (as numbers modulo MODULI), the largest count and its motif."""
    keep = [c for c in df.columns if c != seq]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            weight = np.cumsum([len(t or "") for t in whole.column(seq).to_pylist()])
            for a, b in _spans(weight, CHUNK_BASES >> 2):
                batch = whole.slice(a, b - a)
                texts = [(t or "").encode("latin-1", "replace") for t in batch.column(seq).to_pylist()]
                owner, (*numbers, kmer) = _modes_of(texts, cfg)
                arrays = [*(pa.array(x) for x in numbers), pa.array(kmer.tolist(), pa.binary()).cast(pa.string())]
                rows = pa.StructArray.from_arrays(arrays, ["k", "total", "motifs", "squares", "by_count", "by_square", "most", "kmer"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)), rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "modes"])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep) + f"modes {MODES}"
    return df.mapInArrow(run, schema)


def _spans(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of rows (weight: running sums) that weigh about so much."""
    a = 0
    while a < len(weight):
        before = int(weight[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(weight, before + most, side="right")))
        yield a, b
        a = b


def _digests_of(texts: list[bytes], cfg: ScanConfig) -> tuple[np.ndarray, list]:
    """The segments, and k, windows and digest, of each segment and period with a window, in order of these."""
    run = _Run(texts)
    digit, owner, columns = (run.base + _U(48)).astype(np.uint8), [], []
    starts = np.flatnonzero((run.valid > 0) & np.concatenate([[True], run.valid[:-1] == 0]))  # of runs of bases
    length, of = run.valid[starts], run.where[starts]
    rows = np.empty(len(digit) * (cfg.max_mer + 1), np.uint8)
    for k in range(cfg.min_mer, min(cfg.max_mer, int(length.max(initial=0))) + 1):
        # A row for each place, windows or not, so that the windows of a run lie side by side.
        places = len(digit) - k + 1
        at_k = rows[: places * (k + 1)].reshape(places, k + 1)
        at_k[:, :k] = np.lib.stride_tricks.sliding_window_view(digit, k)
        at_k[:, k] = ord(",")
        text, some = at_k.reshape(-1).data, length >= k
        begin, windows, segment = starts[some], length[some] - k + 1, of[some]
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        parts = [text[x:y] for x, y in zip((begin * (k + 1)).tolist(), ((begin + windows) * (k + 1)).tolist(), strict=True)]
        digest = []
        for x, y in zip(first.tolist(), [*first[1:].tolist(), len(parts)], strict=True):
            md5 = hashlib.md5(parts[x][:-1])
            for part in parts[x + 1 : y]:
                md5.update(b",")
                md5.update(part[:-1])
            digest.append(md5.hexdigest())
        owner.append(segment[first])
        columns.append((np.full(len(first), k, np.int32), np.add.reduceat(windows, first), digest))
    if not owner:
        return np.empty(0, np.int64), [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.string())]
    order = np.argsort(np.concatenate(owner), kind="stable")
    k, total, digest = (sum(c, []) if isinstance(c[0], list) else np.concatenate(c) for c in zip(*columns, strict=True))
    return np.concatenate(owner)[order], [pa.array(k[order]), pa.array(total[order]), pa.array(digest).take(pa.array(order))]


def digests(df: DataFrame, seq: str, cfg: ScanConfig) -> DataFrame:
    """df without seq, and for each period with a valid window in seq k, windows (how many) and digest: the MD5 of the windows as digits, in their order, between commas."""
    keep = [c for c in df.columns if c != seq]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = pa.compute.fill_null(batch.column(seq), "").dictionary_encode()
            texts = [t.encode("latin-1", "replace") for t in coded.dictionary.to_pylist()]
            parts = [(a, *_digests_of(texts[a:b], cfg)) for a, b in _spans(np.cumsum([len(t) for t in texts]), DIGEST_BASES)]
            if not parts:
                continue
            owner = np.concatenate([a + o for a, o, _ in parts])
            rows = pa.StructArray.from_arrays([pa.concat_arrays(c) for c in zip(*(c for *_, c in parts), strict=True)], ["k", "windows", "digest"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)), rows).take(coded.indices)
            row, found = pa.compute.list_parent_indices(lists), lists.flatten()
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in keep), *found.flatten()], [*keep, "k", "windows", "digest"])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep) + "k int, windows long, digest string"
    return df.mapInArrow(run, schema)


def _flips(motifs: list[str]) -> pa.Array:
    """The least rotations of the other strands of motifs of up to 64 digits."""
    size, out = np.array([len(m) for m in motifs], np.int64), np.empty(len(motifs), object)
    for k in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == k)
        digits = np.frombuffer("".join([motifs[i] for i in rows]).encode(), np.uint8).reshape(-1, k) & 3
        low, high = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
        for j in range(k):  # from the last base on
            high = (high << _U(2)) | (low >> _U(62))
            low = (low << _U(2)) | (3 - digits[:, k - 1 - j]).astype(np.uint64)
        out[rows] = Words(k, low, high if k > 32 else None).least_rotation().strings()
    out[size == 0] = b""
    return pa.array(out.tolist(), pa.binary()).cast(pa.string())


def with_flip(df: DataFrame, kmer: str, name: str) -> DataFrame:
    """df and ``name``, the canonical motif of kmer's other strand. As an expression it would be put, and done again, wherever it is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _flips(batch.column(kmer).to_pylist())], [*batch.schema.names, name])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema) + f"`{name}` string"
    return df.mapInArrow(run, schema)
