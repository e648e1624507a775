"""Finding repeated fixed-length windows over a corpus through content anchors.

A window of ``window`` symbols (bytes or words) chooses as its anchor the least
hashed ``gram``-symbol run inside it, the leftmost of equals, so equal windows
choose equal anchors at equal places. Neighbouring windows that choose the same
anchor form one context. Equal windows can only lie in contexts of one anchor:

1. ``contexts`` lists all contexts of a document (a few for each 100 symbols).
2. ``candidates`` shuffles them by anchor and lists who is to meet whom: the first
   of equal contexts meets the other contexts of its anchor; if an anchor has few,
   all of them meet at once, else equal contexts form a tree by their order, in which each one is the reference of the next ``FAN`` and
   meets the earlier one that is its own.
3. ``copied_spans`` brings the symbols of these to one task for each meeting, where
   an operator's kernel tells which windows stand earlier. An anchor with many
   different contexts (the edge of a widely shared passage) doesn't meet in one
   task: its windows travel one by one, keyed by their own hash.

Before the first shuffle, each chunk of documents is its own reference: the kernel
compares equal contexts of the chunk where they are read, and the runs that it finds
travel as spans; one of equal contexts goes on. Anchors that occur often in a chunk
send one row to the anchor's key and spread the rest by context.

Each row is a document, told apart by its id and a 64-bit hash of its text, and
ordered by them; a null id comes first. Of rows equal in both one is searched, and
each of the others is a later copy from its beginning to its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .storage import materialize

NO_ID = -(2**63)
OFTEN_IN_CHUNK = 3
MANY_CONTEXTS = 512
WITHIN_BYTES = 1 << 20
FAN = 128  # later copies that one context is the reference of
FIRST, SPREAD, COPY = 0, 1, 2
_POSITION_BITS = 24


@dataclass(frozen=True)
class Unit:
    """What a symbol is, and the window and gram lengths in symbols."""

    kind: str
    window: int
    gram: int
    same_document: bool  # whether an earlier place in the same document counts

    def symbols(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Prefix sums of symbols, document bounds in symbols, and byte starts and ends of symbols (words only)."""
        if self.kind == "byte":
            return tx.byte_prefix(buf), off, None, None
        starts, ends, doc = tx.words(buf, off)
        return tx.prefix(tx.span_hash(tx.byte_prefix(buf), starts, ends, "byte"), "word"), tx.word_bounds(doc, len(off) - 1), starts, ends


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    s = 1
    while 2 * s <= w:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: len(x) - (w - s)], x[w - s :]) if w > s else x


def contexts(sums: np.ndarray, bounds: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Document numbers, first window starts (in the document), window counts, anchor hashes and context hashes."""
    n, w, k = len(sums) - 1, unit.window, unit.gram
    step = 1 << (_POSITION_BITS - 2)
    parts = [_contexts(sums, bounds, unit, a, min(a + step, n - w + 1)) for a in range(0, max(0, n - w + 1), step)]
    if not parts:
        e = np.empty(0, np.int64)
        return e, e, e, e.view(np.uint64), e.view(np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _contexts(sums, bounds, unit, a, b):
    """The same for the windows that start in [a, b)."""
    w, k = unit.window, unit.gram
    at = np.arange(a, b + w - k)
    grams = tx.span_hash(sums, at, at + k, unit.kind)
    bits = tx.U(_POSITION_BITS)
    least = sliding_min((tx.mix(grams) >> bits << bits) | np.arange(len(at), dtype=np.uint64), w - k + 1)
    chosen = (least & tx.U((1 << _POSITION_BITS) - 1)).astype(np.int64)
    lengths = np.diff(bounds)
    fit = np.flatnonzero(lengths >= w)
    inside = np.zeros(len(sums) + 1, np.int32)
    inside[bounds[:-1][fit]] += 1
    inside[bounds[1:][fit] - w + 1] -= 1
    windows = np.flatnonzero(np.cumsum(inside)[a:b])
    if not len(windows):
        e = np.empty(0, np.int64)
        return e, e, e, e.view(np.uint64), e.view(np.uint64)
    place = chosen[windows]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(windows) > 1)]))
    run = np.diff(np.append(new, len(windows)))
    first = windows[new] + a
    anchor = place[new] + a
    doc = np.searchsorted(bounds, first, side="right") - 1
    whole = tx.span_hash(sums, first, first + run + w - 1, unit.kind)
    return doc, first - bounds[doc], run, grams[anchor - a], tx.mix(whole + (anchor - first).astype(np.uint64))


def ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)


def own_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def own_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, row: a document is told by doc_id and row."""
    return own_columns(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))


def row_hashes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("row").to_numpy(zero_copy_only=False)


def _decided(kernel: Callable, window: int, key, document, pos, count, buf, off) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that the kernel finds earlier, as runs in the order it gives them: context, start and end (in the document) of each."""
    c, p = kernel(key, document, pos, count, buf, off)
    goes_on = (c[1:] == c[:-1]) & (p[1:] == p[:-1] + 1)
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(c)), bool), ~goes_on]))
    last = np.flatnonzero(np.concatenate([~goes_on, np.ones(min(1, len(c)), bool)]))
    c, p, q = c[new], p[new], p[last]
    return c, pos[c] + p, pos[c] + q + window


def _sliced(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of [a, b) side by side, and their offsets."""
    off = np.concatenate([[0], np.cumsum(b - a)])
    return buf[np.repeat(a - off[:-1], b - a) + np.arange(off[-1])], off


def _keyed(unit: Unit, kernel: Callable) -> Callable:
    """Arrow batches of doc_id, text, row to key, ctx, doc_id, row, at (position, window count, state).

    In the rows of a span that the chunk itself has earlier (COPY), ctx is the number of windows.
    """

    def within(doc, pos, count, ctx, again, rank, bounds, buf, starts, ends):
        """Spans of the contexts ``again`` that the kernel finds in equal contexts of the chunk."""
        of_copies = np.flatnonzero(np.isin(ctx, ctx[again]))
        mine = of_copies[np.lexsort((pos[of_copies], rank[doc[of_copies]], ctx[of_copies]))]
        a = bounds[doc[mine]] + pos[mine]
        b = a + count[mine] + unit.window - 1
        a, b = (a, b) if starts is None else (starts[a], ends[b - 1])
        new = np.flatnonzero(np.concatenate([[True], ctx[mine][1:] != ctx[mine][:-1]]))
        size = np.concatenate([[0], np.cumsum(b - a)])[new] // WITHIN_BYTES
        cuts = np.append(new[np.concatenate([[True], size[1:] != size[:-1]])], len(mine)).tolist()  # whole groups, of so many bytes
        spans = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            m = mine[i:j]
            c, start, end = _decided(kernel, unit.window, ctx[m], rank[doc[m]], pos[m], count[m], *_sliced(buf, a[i:j], b[i:j]))
            spans.append((doc[m][c], start, end))
        return merged(*map(np.concatenate, zip(*spans, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tx.chunks(batches, chunk_bytes=1 << 21):
            sums, bounds, starts, ends = unit.symbols(buf, off)
            doc, pos, count, anchor, ctx = contexts(sums, bounds, unit)
            if not len(doc):
                continue
            every, text_of = ids(batch), row_hashes(batch)
            ident, text = every[doc], text_of[doc]
            order = np.lexsort((pos, text, ident, ctx))
            new = np.concatenate([[True], ctx[order][1:] != ctx[order][:-1]])
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            again = (ident[order] != ident[head]) | (text[order] != text[head])  # it has an equal context in a document before its own
            if unit.same_document:
                again |= pos[order] != pos[head]
            copies = order[again]
            spans = (np.empty(0, np.int64),) * 3
            if len(copies):
                by = np.lexsort((text_of, every))
                rank = np.empty(len(every), np.int64)  # equal rows share one
                rank[by] = np.cumsum(np.concatenate([[False], (every[by][1:] != every[by][:-1]) | (text_of[by][1:] != text_of[by][:-1])]))
                spans = within(doc, pos, count, ctx, copies, rank, bounds, buf, starts, ends)
            state = np.full(len(doc), FIRST)
            state[copies] = COPY
            left = np.flatnonzero(state == FIRST)
            _, inverse, n = np.unique(anchor[left], return_inverse=True, return_counts=True)
            head = np.zeros(len(n), np.int64)
            head[inverse[::-1]] = np.arange(len(left))[::-1]
            often = n[inverse] >= OFTEN_IN_CHUNK
            key = anchor.copy()
            state[left[often]] = SPREAD
            rest = left[often & (head[inverse] != np.arange(len(left)))]
            key[rest] = tx.mix(ctx[rest])
            of, start, end = spans
            spread = tx.mix(every[of].astype(np.uint64) * tx.U(0x9E3779B97F4A7C15) + text_of[of].view(np.uint64) + start.astype(np.uint64))
            columns = [
                (tx.signed(key[left]), tx.signed(spread)), (tx.signed(ctx[left]), end - start - unit.window + 1), (ident[left], every[of]), (text[left], text_of[of]),
                ((pos[left] << 10) | (count[left] << 2) | state[left], start << 10 | COPY),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["key", "ctx", "doc_id", "row", "at"])

    return run


def candidates(own: DataFrame, unit: Unit, kernel: Callable) -> DataFrame:
    """doc_id, row, pos, windows, meet: spans found in their own chunks (meet is empty), and contexts with all their meetings.

    A meeting has a key and alone: whether its windows travel one by one. Written to the shared folder, as it is read twice.
    """
    rows = own.mapInArrow(_keyed(unit, kernel), "key long, ctx long, doc_id long, row long, at long")
    in_order = "doc_id, row, at >> 10" if unit.same_document else "doc_id, row"
    seen = rows.selectExpr(
        "key", "ctx", "doc_id", "row", "at", "cast(at & 3 as int) as state",
        f"dense_rank() over (partition by key, ctx order by {in_order}) as nth", "count(*) over (partition by key, ctx) as equals",
        "count(*) over (partition by key) as n", "max(at & 3) over (partition by key) as state_of_key",
        "min(ctx) over (partition by key) as low", "max(ctx) over (partition by key) as high",
    )
    meeting = lambda key, alone: f"struct({key} as key, {alone} as alone)"
    with_anchor = f"if(nth = 1 and (state_of_key = {SPREAD} or low <> high), {meeting('key', f'(state_of_key = {SPREAD} or n > {MANY_CONTEXTS})')}, null)"
    with_earlier = f"if(nth > 1, {meeting(f'xxhash64(key, ctx, cast((nth - 2) div {FAN} + 1 as long))', 'false')}, null)"
    with_later = f"if(equals > {FAN} * cast(nth - 1 as long) + 1, {meeting('xxhash64(key, ctx, cast(nth as long))', 'false')}, null)"
    few = f"state_of_key <> {SPREAD} and n <= {MANY_CONTEXTS}"  # all contexts of the anchor, equal or not, meet at once
    with_all = f"if(n > 1, array({meeting('key', 'false')}), array())"
    meet = f"case when state = {COPY} then array() when {few} then {with_all} else array_compact(array({with_anchor}, {with_earlier}, {with_later})) end"
    out = seen.selectExpr("doc_id", "row", "at >> 10 as pos", f"if(state = {COPY}, ctx, (at >> 2) & 255) as windows", "state", f"{meet} as meet")
    return materialize(out.where(f"state = {COPY} or size(meet) > 0").drop("state"))


def _sent(unit: Unit) -> Callable:
    """Arrow batches of doc_id, text, row, todo to the symbols of the contexts to be compared."""
    w = unit.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, buf, off in tx.chunks([whole], chunk_bytes=1 << 21):
                sums, bounds, starts, ends = unit.symbols(buf, off)
                todo = batch.column("todo")
                row = np.repeat(np.arange(batch.num_rows), np.diff(todo.offsets.to_numpy()))
                flat = todo.flatten()
                pos, count, key, alone = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "windows", "key", "alone"))
                fits = bounds[row] + pos + count + w - 1 <= bounds[row + 1]
                row, pos, count, key, alone = (x[fits] for x in (row, pos, count.astype(np.int64), key, alone.astype(bool)))
                # The windows of "alone" contexts become contexts of one window, keyed by their hash, equal ones once.
                each = np.repeat(np.flatnonzero(alone), count[alone])
                shift = np.arange(len(each)) - np.repeat(np.cumsum(count[alone]) - count[alone], count[alone])
                one_row, one_pos = row[each], pos[each] + shift
                at = bounds[one_row] + one_pos
                one_key = tx.span_hash(sums, at, at + w, unit.kind)
                row, pos, key = np.concatenate([row[~alone], one_row]), np.concatenate([pos[~alone], one_pos]), np.concatenate([key[~alone], tx.signed(one_key)])
                count = np.concatenate([count[~alone], np.ones(len(each), np.int64)])
                known = np.zeros(len(row), bool)
                ident, text = ids(batch)[row], row_hashes(batch)[row]
                mine = np.arange(len(row) - len(each), len(row))
                order = mine[np.lexsort((pos[mine], text[mine], ident[mine], key[mine]))]
                if len(order):
                    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
                    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                    known[order] = (ident[order] != ident[head]) | (text[order] != text[head])
                    if unit.same_document:
                        known[order] |= pos[order] != pos[head]
                # Known windows travel as runs.
                run = np.flatnonzero(known)
                run = run[np.lexsort((pos[run], row[run]))]
                begins = np.ones(len(run), bool)
                begins[1:] = (row[run][1:] != row[run][:-1]) | (pos[run][1:] > pos[run][:-1] + 1)
                if len(run):
                    head = np.flatnonzero(begins)
                    count[run[head]] = pos[run[np.append(head[1:], len(run)) - 1]] - pos[run[head]] + 1
                    stay = ~known
                    stay[run[head]] = True
                    row, pos, count, key, known, ident, text = (x[stay] for x in (row, pos, count, key, known, ident, text))
                a = bounds[row] + pos
                b = a + count + w - 1
                a, b = (a, b) if starts is None else (starts[np.minimum(a, len(starts) - 1)], ends[np.maximum(b - 1, 0)] if len(ends) else b)
                data = pa.array([None if k else buf[i:j].tobytes() for i, j, k in zip(a.tolist(), b.tolist(), known.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ident), pa.array(text), pa.array(pos), pa.array(count.astype(np.int32)), data], ["key", "doc_id", "row", "pos", "windows", "data"])

    return run


def _compared(unit: Unit, kernel: Callable, block_bytes: int) -> Callable:
    """Blocks of whole keys to the windows that stand earlier, as runs."""
    names = ["key", "doc_id", "row", "pos", "windows", "data"]

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        key, ident, text, pos, count = (t.column(c).to_numpy() for c in names[:5])
        known = t.column("data").is_null().to_numpy()
        order = np.lexsort((pos, text, ident, known, key))
        same = lambda x: x[order][1:] == x[order][:-1]
        first = np.zeros(len(key), bool)
        first[order] = np.concatenate([[True], ~(same(key) & same(known) & same(ident) & same(text) & same(pos))])  # equal rows send the same
        at = np.flatnonzero(~known & first)
        known = np.flatnonzero(known & first)
        out = [np.stack([ident[known], text[known], pos[known], pos[known] + count[known] + unit.window - 1])]
        if len(at):
            buf, off = tx.raw(t.column("data").take(pa.array(at)).cast(pa.large_binary()).combine_chunks().view(pa.large_string()))
            document = np.empty(len(at), np.int64)  # its place in the order of documents
            order = np.lexsort((text[at], ident[at]))
            document[order] = np.cumsum(np.concatenate([[False], (ident[at][order][1:] != ident[at][order][:-1]) | (text[at][order][1:] != text[at][order][:-1])]))
            c, start, end = _decided(kernel, unit.window, key[at], document, pos[at], count[at].astype(np.int64), buf, off)
            out.append(np.stack([ident[at][c], text[at][c], start, end]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.hstack(out)], ["doc_id", "row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= block_bytes:
                key = batch.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # rows come in order of key; its last may go on
                if cut:
                    held[-1] = batch.slice(0, cut)
                    yield block(held)
                    held = [batch.slice(cut)]
                    size = held[0].nbytes
        if held:
            yield block(held)

    return run


def merged(ident: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of overlapping or touching spans of each document."""
    order = np.lexsort((start, ident))
    ident, start, end = ident[order], start[order], end[order]
    if not len(ident):
        return ident, start, end
    new_doc = np.concatenate([[True], ident[1:] != ident[:-1]])
    group = np.cumsum(new_doc) - 1
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far
    new = new_doc | np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return ident[at], start[at], np.maximum.reduceat(end, at)


def copied_spans(own: DataFrame, unit: Unit, kernel: Callable, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, row, spans: for each document with copied windows, spans of symbols that they cover (not merged).

    What is sent is written before it is dealt out by key, and the spans too, so that the shuffle files of one step are gone before the next.
    """
    found = candidates(own, unit, kernel)
    meetings = found.select("doc_id", "row", "pos", "windows", F.explode("meet").alias("m")).select("doc_id", "row", "pos", F.col("windows").cast("int").alias("windows"), "m.key", "m.alone")
    todo = meetings.groupBy("doc_id", "row").agg(F.collect_set(F.struct("pos", "windows", "key", "alone")).alias("todo"))
    sent = materialize(own.join(todo, ["doc_id", "row"]).mapInArrow(_sent(unit), "key long, doc_id long, row long, pos long, windows int, data binary"))
    spans = sent.repartition("key").sortWithinPartitions("key").mapInArrow(_compared(unit, kernel, block_bytes), "doc_id long, row long, start long, end long")
    near = found.where("size(meet) = 0").selectExpr("doc_id", "row", "pos as start", f"pos + windows + {unit.window - 1} as end")
    return materialize(spans.unionByName(near).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def per_document(own: DataFrame, unit: Unit, spans: DataFrame, judge: Callable, schema: str) -> DataFrame:
    """judge(batch, buf, off, row, start, end) over all documents with the spans (row numbers in the chunk) found in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tx.chunks(batches, chunk_bytes=1 << 21):
            col = batch.column("spans")
            lens = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0))
            flat = col.flatten()
            row = np.repeat(np.arange(batch.num_rows), lens)
            start, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            later = np.flatnonzero(batch.column("nth").to_numpy() > 1)
            if len(later):
                size = np.diff(unit.symbols(buf, off)[1])[later]
                later, size = later[size >= unit.window], size[size >= unit.window]
                row, start, end = np.concatenate([row, later]), np.concatenate([start, np.zeros(len(later), np.int64)]), np.concatenate([end, size])
            yield judge(batch, buf, off, *merged(row, start, end))

    numbered = own.join(spans, ["doc_id", "row"], "left").withColumn("nth", F.expr("row_number() over (partition by doc_id, row order by doc_id)"))
    return numbered.mapInArrow(run, schema)


def true_ids(batch: pa.RecordBatch) -> pa.Array:
    ident = batch.column("doc_id")
    return pa.compute.if_else(pa.compute.equal(ident, NO_ID), None, ident)
