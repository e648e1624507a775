"""Suffix-array dedup of byte strings: later copies go, the first stays.

The windows that may repeat are found through content anchors (``anchors``). For
each block of comparable windows the suffix array of their first ``window`` bytes is
built, with the longest common prefixes of neighbours. The nearest entries before and
after a suffix in that order that have a smaller text position (document, offset) are
the earlier texts that agree with it longest; the longer of both agreements is its
longest previous factor. Windows whose factor is ``window`` bytes long are removed,
wherever they overlap, and the first of equals has none, so it stays.

Contexts that are equal as a whole, the bulk of exact copies, go into blocks with an
earlier one of theirs: within the chunk where they are read, else by a tree of copies.

Defined results: null text is empty; matches never cross documents; the result
doesn't depend on partitioning; for null and repeated ids see ``anchors``. The
bytes left may not be valid UTF-8, so ``kept`` is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors as an

JUMPS = 16  # rounds of pointer jumping before the tree
_PLACE_BITS = 40


def suffix_order(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at starts by their first length bytes, ties kept, and each one's common prefix with the one before it.

    Eight bytes at a time; only runs that are still equal are ordered further, and of these only the mixed ones.
    """
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, ">u8", padded, 0, (1,))  # the eight bytes from each place on
    order = np.arange(len(starts))
    lcp = np.full(len(starts), length)
    lcp[:1] = 0
    new = np.zeros(len(starts), bool)
    new[:1] = True
    open_ = np.arange(len(starts))  # places in the order that are still tied
    for at in range(0, length, 8):
        word = eight[starts[order[open_]] + at].astype(np.uint64)
        if at + 8 > length:
            word &= np.uint64((1 << 64) - (1 << 8 * (at + 8 - length)))
        first = new[open_]
        differs = (word[1:] != word[:-1]) & ~first[1:]
        if not differs.any():
            continue
        run = np.cumsum(first) - 1
        if at:
            mixed = np.zeros(run[-1] + 1, bool)
            mixed[run[1:][differs]] = True
            some = np.flatnonzero(mixed[run])
            sort = some[np.lexsort((word[some], run[some]))]
            order[open_[some]], word[some] = order[open_[sort]], word[sort]
        else:
            order = np.argsort(word, kind="stable")
            word = word[order]
        split = np.flatnonzero(np.concatenate([[False], (word[1:] != word[:-1]) & ~first[1:]]))
        new[open_[split]] = True
        apart = word[split] ^ word[split - 1]
        lcp[open_[split]] = at + sum(((apart >> np.uint64(64 - 8 * b)) == 0).astype(np.int64) for b in range(1, 8))
        tied = ~new[open_]  # equal to the one before
        tied[:-1] |= tied[1:]
        open_ = open_[tied]
        if not len(open_):
            break
    return order, lcp


def _agreement(position: np.ndarray, lcp: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """For each place of a suffix order the agreement with the nearest one before it that has a smaller text position; 0 without one.

    Pointers jump: where the place pointed at has a larger position, go on from where that one points to. Most end in a few
    rounds; the rest climb a tree of minima. Places that are known need no answer and get 0.
    """
    to = np.arange(-1, len(position) - 1)
    least = lcp.copy()
    wrong = np.flatnonzero(position[to] > position)
    wrong = wrong[to[wrong] >= 0]
    if known is not None:
        wrong = wrong[~known[wrong]]
    for _ in range(JUMPS):
        if not len(wrong):
            break
        via = to[wrong]
        least[wrong], to[wrong] = np.minimum(least[wrong], least[via]), to[via]
        wrong = wrong[(to[wrong] >= 0) & (position[to[wrong]] > position[wrong])]
    if len(wrong):
        to[wrong], least[wrong] = _climbed(position, lcp, wrong)
    least[to < 0] = 0
    if known is not None:
        least[known] = 0
    return least


def _minima(x: np.ndarray, size: int) -> np.ndarray:
    """A binary tree of minima over x, filled up to size leaves; node i has the children 2 i and 2 i + 1."""
    tree = np.full(2 * size, np.iinfo(np.int64).max)
    tree[size : size + len(x)] = x
    while size > 1:
        size //= 2
        tree[size : 2 * size] = np.minimum(tree[2 * size : 4 * size : 2], tree[2 * size + 1 : 4 * size : 2])
    return tree


def _climbed(position: np.ndarray, lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the places at: the nearest one before with a smaller position (-1 without one), and the agreement with it."""
    size = 1 << int(len(position) - 1).bit_length()
    low, agree = _minima(position, size), _minima(lcp, size)
    x, least, node = position[at], lcp[at].copy(), at + size
    climbing = np.arange(len(at))
    while len(climbing):  # up, until the neighbour on the left has a smaller position
        right = (node[climbing] & 1) == 1
        left = node[climbing] - 1
        found = right & (node[climbing] > 1) & (low[left] < x[climbing])
        passed = climbing[right & ~found]
        least[passed] = np.minimum(least[passed], agree[node[passed] - 1])
        node[climbing] = np.where(found, left, node[climbing] >> 1)
        climbing = climbing[~found]
        climbing = climbing[node[climbing] > 1]
    some = np.flatnonzero(node > 1)
    inner = some[node[some] < size]
    while len(inner):  # down, as far right as there is a smaller one
        right = 2 * node[inner] + 1
        go = low[right] < x[inner]
        passed = inner[~go]
        least[passed] = np.minimum(least[passed], agree[right[~go]])
        node[inner] = np.where(go, right, right - 1)
        inner = inner[node[inner] < size]
    to = np.full(len(at), -1)
    to[some] = node[some] - size
    return to, least


def longest_previous(order: np.ndarray, lcp: np.ndarray, position: np.ndarray, most: int) -> np.ndarray:
    """The longest previous factor of each suffix: its longest agreement, of ``most`` bytes at most, with one of a smaller position (distinct numbers)."""
    placed = position[order]
    before = _agreement(placed, lcp)
    after = _agreement(placed[::-1], np.concatenate([[0], lcp[:0:-1]]), (before >= most)[::-1])[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def kernel(window: int):
    def run(key, ident, pos, count, buf, off):
        by = np.lexsort((pos, ident))  # in order of position equal windows stay so in the suffix order, next to their factor
        ident, pos, count, begin = ident[by], pos[by], count[by], off[:-1][by]
        ctx = np.repeat(np.arange(len(count)), count)
        shift = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count)
        position = ident[ctx] << _PLACE_BITS | (pos[ctx] + shift)  # (document, place)
        if np.any(position[1:] <= position[:-1]):  # a context can be here for two meetings; each place is taken once
            position, once = np.unique(position, return_index=True)
            ctx, shift = ctx[once], shift[once]
        order, lcp = suffix_order(buf, begin[ctx] + shift, window)
        hit = longest_previous(order, lcp, position, window) >= window
        return by[ctx[hit]], shift[hit]

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, gram: int = 32) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte runs) and kept (bytes left), one row for each row of docs."""
    unit = an.Unit("byte", window, gram, same_document=True)
    own = an.own_rows(docs, id_col, text_col)

    def judge(batch, buf, off, row, start, end):
        end = np.minimum(end, np.diff(off)[row])
        start, end, row = start[start < end], end[start < end], row[start < end]
        gone = np.zeros(len(buf) + 1, np.int32)
        np.add.at(gone, off[row] + start, 1)
        np.add.at(gone, off[row] + end, -1)
        stay = np.cumsum(gone)[:-1] == 0
        left = np.concatenate([[0], np.cumsum(stay)])[off]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(left), pa.py_buffer(buf[stay].tobytes())]).cast(pa.binary())
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
        return pa.RecordBatch.from_arrays([an.true_ids(batch), pa.array(np.diff(off)), spans, kept], ["doc_id", "n_bytes", "spans", "kept"])

    return an.per_document(own, unit, an.copied_spans(own, unit, kernel(window)), judge, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
