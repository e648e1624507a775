"""Periodic runs in word sequences, found in tiles of several scales and stitched.

A run is a stretch of words with smallest period q that is at least ``least`` words and
two periods long and that no neighbouring word extends. It shows as a match interval:
consecutive places i whose word equals the word at i + q, at least q of them.

* A document is exploded into overlapping tiles, for octaves [P, 2P) of the period. Three
  octaves share a grid; tiles grow with the periods of their grid, and see as many
  places beyond their own on both sides as its largest period. So an interval that meets a tile's own
  places shows at least q of its places in it, or all.
* In a tile, boundaries stand in a row, at most half a shortest interval apart. At each
  boundary the Z-function of the text that begins there, at all shifts of the octave, is
  compared with the way to the next boundary, by hashes of the words between them. Where
  text and shifted text agree so far, the interval's ends are found on both sides of the
  boundary by comparing words; hashes never decide alone.
* What a tile finds is cut at what it sees. Intervals of one document and period that
  overlap or touch are stitched into one; then those whose first period is itself a
  repetition are dropped, as a smaller period has the same run.

Documents of up to ``long_bytes`` are one tile, solved where they are read with others of
their batch. The tiles of longer ones are dealt to tasks by document, grid and place, their
intervals shuffled by document and period and stitched there, and the runs meet the texts
of these documents only.

Defined results: words are runs of characters other than space and tab to carriage
return; word equality is that of 64-bit hashes; a null text has no words; repeated rows
have equal results; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors as an
from . import text as tx

TILE = 4096  # words of a tile's own, for the periods below an eighth of it
GRID = 8  # three octaves
_SPOTS = 1 << 20  # boundary and shift pairs compared at once
RUNS = "array<struct<start:long,length:long,period:long>>"
SCHEMA = f"doc_id long, n_words long, runs {RUNS}, kept string"


def shortest_match(q: int, least: int) -> int:
    """The places that the match interval of a run of period q has at least."""
    return max(q, least - q)


def _extent(words: np.ndarray, q: int, at: int, first: int, stop: int) -> tuple[int, int]:
    """The match interval of shift q around the place at within words[first:stop], compared in growing steps."""
    end, step = at + 1, 64
    while end < stop - q:
        to = min(end + step, stop - q)
        differ = np.flatnonzero(words[end:to] != words[end + q : to + q])
        if len(differ):
            end += int(differ[0])
            break
        end, step = to, 2 * step
    begin, step = at, 64
    while begin > first:
        low = max(first, begin - step)
        differ = np.flatnonzero(words[low:begin] != words[low + q : begin + q])
        if len(differ):
            begin = low + int(differ[-1]) + 1
            break
        begin, step = low, 2 * step
    return begin, end


def _agreeing(words: np.ndarray, sums: np.ndarray, bounds: np.ndarray, low: int, high: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Boundaries, shifts in [low, high), at most an octave, and the way to the next boundary, over which text and shifted text agree.

    bounds: where each document's words begin, with the end; both places lie in one document.
    """
    shortest = min(shortest_match(q, least) for q in range(low, min(high, max(low, least) + 1)))
    width = (shortest + 1) // 2
    n = len(words)
    if n < low + width:
        return
    starts = np.arange(n - width + 1)
    z = tx.span_hash(sums, starts, starts + width, "word")
    at = np.arange(0, n - width - low + 1, width)
    stop = bounds[np.searchsorted(bounds, at, side="right")]
    inside = at + low + width <= stop
    at, stop = at[inside], stop[inside]
    step = max(1, _SPOTS // (high - low))
    for r in range(0, len(at), step):
        far = at[r : r + step, None] + np.arange(low, high)
        of, shift = np.nonzero((z[at[r : r + step], None] == z[np.minimum(far, len(z) - 1)]) & (far + width <= stop[r : r + step, None]))
        place, q = at[r + of], shift + low
        true = (words[place] == words[place + q]) & (words[place + width - 1] == words[place + q + width - 1])
        yield place[true], q[true], width


def intervals(words: np.ndarray, bounds: np.ndarray, low: int, high: int, least: int) -> list[tuple[int, int, int]]:
    """(period, first place, place after the last) of the long enough match intervals of shifts low to high - 1 in each document.

    A multiple of a shift found before isn't followed where a run of that shift covers the
    places compared: its interval would show the same run. So multiples come or don't.
    """
    out: list[tuple[int, int, int]] = []
    sums = tx.prefix(words, "word")
    period, reach = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)  # of a run of four periods or more at each place
    longest = int(np.diff(bounds).max(initial=0))
    while low < high and 2 * low <= longest:
        top = min(2 * low, high)
        for place, q, width in _agreeing(words, sums, bounds, low, top, least):
            known = period[place]
            again = (known > 0) & (q > known) & (q % np.maximum(known, 1) == 0) & (place + q + width <= reach[place])
            place, q = place[~again], q[~again]
            order = np.lexsort((place, q))
            document = np.searchsorted(bounds, place, side="right")
            last = (0, 0)  # the last shift, and where its interval ended
            for p, s, d in zip(place[order].tolist(), q[order].tolist(), document[order].tolist(), strict=True):
                if last[0] == s and p < last[1]:
                    continue
                i, j = _extent(words, s, p, int(bounds[d - 1]), int(bounds[d]))
                last = s, j
                if j - i >= shortest_match(s, least):
                    out.append((s, i, j))
                    if j - i >= 3 * s:
                        less = reach[i:j] < j + s
                        period[i:j][less], reach[i:j][less] = s, j + s
        low = top
    return out


def _primitive(words: np.ndarray, start: int, q: int) -> bool:
    """Whether the q words from start on are no repetition of fewer words."""
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = q // p
            if (words[start : start + q - d] == words[start + d : start + q]).all():
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n_docs: int) -> pa.Array:
    """The words of each document, joined by one space."""
    size = ends - starts
    upto = np.concatenate([[0], np.cumsum(size)])
    flat = buf[np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])]
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(flat))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(tx.word_bounds(doc, n_docs).astype(np.int32)), words), pa.scalar(" ", pa.large_string())).cast(pa.string())


def _result(batch: pa.RecordBatch, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, words: np.ndarray, found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Rows of SCHEMA. found: (period, first place, place after the last) in the words of all documents; not all need be primitive."""
    bounds = tx.word_bounds(doc, batch.num_rows)
    runs = np.array(sorted({(i, j + q - i, q) for q, i, j in found if _primitive(words, i, q)}), np.int64).reshape(-1, 3)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    at = np.searchsorted(runs[:, 0], bounds)
    start = runs[:, 0] - bounds[np.searchsorted(bounds, runs[:, 0], side="right") - 1]
    rows = pa.StructArray.from_arrays([pa.array(start), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays([an.true_ids(batch), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), rows), _joined(buf, starts[stay], ends[stay], doc[stay], batch.num_rows)], ["doc_id", "n_words", "runs", "kept"])


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, their documents and hashes."""
    starts, ends, doc = tx.words(buf, off)
    return starts, ends, doc, tx.span_hash(tx.byte_prefix(buf), starts, ends, "byte")


def _whole(least: int):
    """Documents that are one tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tx.chunks(batches):
            starts, ends, doc, words = _words(buf, off)
            bounds = tx.word_bounds(doc, batch.num_rows)
            yield _result(batch, buf, starts, ends, doc, words, intervals(words, bounds, 1, len(words) + 1, least))

    return run


def grids(n: int, tile: int) -> Iterator[tuple[int, int, int]]:
    """The periods low to high - 1 of each grid for n words, and the words of its tiles' own."""
    low, high = 1, max(2, tile // GRID)
    while 2 * low <= n:
        yield low, high, tile
        low, high, tile = high, high * GRID, tile * GRID


def _tiled(tile: int, least: int):
    """Arrow batches of doc_id, row, text to tiles: the words as numbers that are equal for equal words of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tx.chunks(batches):
            _, _, doc, words = _words(buf, off)
            bounds = tx.word_bounds(doc, batch.num_rows)
            for i in range(batch.num_rows):
                number = np.unique(words[bounds[i] : bounds[i + 1]], return_inverse=True)[1].astype("<i4")
                for low, high, own in grids(len(number), tile):
                    more = max(high, least)
                    places = [max(0, t - more) for t in range(0, len(number), own)]
                    data = [number[a : t + own + more + high].tobytes() for a, t in zip(places, range(0, len(number), own), strict=True)]
                    k = len(places)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([i] * k)), batch.column("row").take(pa.array([i] * k)), pa.array(places, pa.int64()), pa.array([low] * k, pa.int64()), pa.array([high] * k, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "row", "at", "low", "high", "data"])

    return run


def _tile_intervals(least: int):
    """Tiles to doc_id, row, period, first, last: match intervals as far as the tile sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, low, high = (batch.column(c).to_pylist() for c in ("at", "low", "high"))
            of, rows = [], []
            for i, data in enumerate(batch.column("data")):
                words = tx.mix(np.frombuffer(data.as_buffer(), "<i4").astype(np.uint64))
                found = intervals(words, np.array([0, len(words)]), low[i], high[i], least)
                of += [i] * len(found)
                rows += [(q, a + at[i], b + at[i]) for q, a, b in found]
            of = pa.array(of, pa.int64())
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("row").take(of), *(pa.array(c) for c in columns)], ["doc_id", "row", "period", "first", "last"])

    return run


def stitched(found: DataFrame, least: int) -> DataFrame:
    """doc_id, row, found (array of period, first, last): overlapping or touching intervals of a document and period as one, the short ones left out."""
    of = Window.partitionBy("doc_id", "row", "period").orderBy("first", "last")
    before = F.max("last").over(of.rowsBetween(Window.unboundedPreceding, -1))
    new = found.withColumn("new", F.when(F.col("first") <= before, 0).otherwise(1))
    whole = new.withColumn("nth", F.sum("new").over(of.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "row", "period", "nth").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    long_enough = whole.where(F.col("last") - F.col("first") >= F.greatest(F.col("period"), F.lit(least) - F.col("period")))
    return long_enough.groupBy("doc_id", "row").agg(F.collect_list(F.struct("period", "first", "last")).alias("found"))


def _with_runs():
    """Arrow batches of doc_id, text, found to rows of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tx.chunks(batches):
            starts, ends, doc, words = _words(buf, off)
            bounds = tx.word_bounds(doc, batch.num_rows)
            found = [(x["period"], x["first"] + int(a), x["last"] + int(a)) for a, row in zip(bounds, batch.column("found").to_pylist(), strict=False) for x in row or ()]
            yield _result(batch, buf, starts, ends, doc, words, found)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, tile: int = TILE, long_bytes: int = 8 * TILE) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, in this order) and kept (words left when each run keeps its first period), one row for each row of docs."""
    own = an.own_rows(docs, id_col, text_col)
    is_long = F.octet_length("text") > long_bytes
    short = own.where(~is_long).mapInArrow(_whole(least), SCHEMA)
    long = own.where(is_long)
    tiles = long.mapInArrow(_tiled(tile, least), "doc_id long, row long, at long, low long, high long, data binary").repartition("doc_id", "row", "low", "at")
    found = tiles.mapInArrow(_tile_intervals(least), "doc_id long, row long, period long, first long, last long")
    return short.unionByName(long.join(stitched(found, least), ["doc_id", "row"], "left").mapInArrow(_with_runs(), SCHEMA))
