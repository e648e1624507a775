"""Packing token sequences into windows of one length by best-fit decreasing.

Each document is its text's token ids and one end id. Full windows are cut from it
first; what is left (less than a window) is packed with what is left of others: longest
first, each into the open window with the least room that holds it. A segment tree over
remaining capacities finds that window in a few steps, whatever their number.

A task packs the rows it reads, in blocks of ``block_tokens`` left-over ids, so nothing
is shuffled, no key is hot and memory is that of one block. When a block ends, its
emptiest windows are cut to fill the gaps of the others; then at most one window is
partly filled, and it is cut at powers of two, the lengths that take no padding. So a
block ends with a few short sequences and no padding.

Defined results: a null text is empty and has its end id alone; a null id stays null;
repeated rows are packed as so many documents; each id lies in one piece, pieces of one
sequence adjoin from offset 0; sequence ids are unique, and the same in every attempt of
a task that reads the same rows; special tokens' strings are ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import encode, public_path

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_COUNTER_BITS = 40
ROWS_OUT = 1024


class OpenWindows:
    """Windows by the room left in them, in a segment tree whose leaves count the windows of each capacity."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, window: int, room: int) -> None:
        self.at[room].append(window)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The window with the least room of size or more, and its room; it is taken out."""
        node = size + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up to where a subtree to the right has windows
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.at[room].pop(), room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """The items (numbers into sizes, each at most length) of each window, longest items first."""
    open_, windows = OpenWindows(length), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = open_.take(sizes[item])
        if found is None:
            found = len(windows), length
            windows.append([])
        window, room = found
        windows[window].append(item)
        if room > sizes[item]:
            open_.add(window, room - sizes[item])
    return windows


def filled(windows: list[list[int]], sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Windows as pieces (item, start, size): the emptiest are cut into the others' gaps, and a last one at powers of two."""
    out = [[(i, 0, sizes[i]) for i in w] for w in windows]
    fill = [sum(sizes[i] for i in w) for w in windows]
    order = sorted((w for w in range(len(out)) if fill[w] < length), key=lambda w: -fill[w])
    a, b = 0, len(order) - 1
    while a < b:  # from the emptiest, order[b], into the fullest, order[a]
        full, low = order[a], order[b]
        item, start, size = out[low].pop()
        part = min(size, length - fill[full])
        out[full].append((item, start + size - part, part))
        if part < size:
            out[low].append((item, start, size - part))
        fill[full] += part
        fill[low] -= part
        a += fill[full] == length
        b -= fill[low] == 0
    out = [w for w in out if w]
    rest = next((w for w in out if sum(p[2] for p in w) < length), None)
    if rest is None:
        return out
    out.remove(rest)
    while rest:
        room = 1 << (sum(p[2] for p in rest).bit_length() - 1)
        out.append([])
        while room:
            item, start, size = rest.pop(0)
            part = min(size, room)
            out[-1].append((item, start, part))
            if part < size:
                rest.insert(0, (item, start + part, size - part))
            room -= part
    return out


def _pack(path: str, length: int, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << _COUNTER_BITS
        rows: list[tuple] = []
        held: list[tuple] = []  # doc_id, start, size, ids, doc_tokens of what is left of documents
        tokens = 0

        def emitted() -> pa.RecordBatch:
            doc_id, start, ids, total, seq, offset = zip(*rows, strict=True)
            data = pa.array([x.tobytes() for x in ids], pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), data, pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        def packed() -> None:
            nonlocal sequence
            sizes = [len(h[2]) for h in held]
            for window in filled(best_fit(sizes, length), sizes, length):
                offset = 0
                for item, a, size in window:
                    doc_id, start, ids, total = held[item]
                    rows.append((doc_id, start + a, ids[a : a + size], total, sequence, offset))
                    offset += size
                sequence += 1
            held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(path, text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                cut = len(ids) // length * length
                for p in range(0, cut, length):
                    rows.append((doc_id, p, ids[p : p + length], len(ids), sequence, 0))
                    sequence += 1
                if cut < len(ids):
                    held.append((doc_id, cut, ids[cut:], len(ids)))
                    tokens += len(ids) - cut
                if len(rows) >= ROWS_OUT:
                    yield emitted()
                if tokens >= block_tokens:
                    packed()
                    tokens = 0
        packed()
        if rows:
            yield emitted()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = 1024, end_id: int = 0, block_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start (in its document's ids), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (in the sequence).

    tokenizer: a rank file that every executor can open; the public byte-level one by default.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_pack(tokenizer or public_path(), length, end_id, block_tokens), SCHEMA)


def padded_size(size: Column, length: int) -> Column:
    """A sequence's length with padding: a power of two stays, all else goes to length."""
    return F.when(F.bit_count(size) == 1, size).otherwise(F.lit(length).cast("long"))


def sequences(packed: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (padded), n_tokens, pieces (doc_id, start, offset, length, in order). A group is one window."""
    piece = F.struct("offset", "length", "doc_id", "start", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("length").alias("n_tokens"))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (padded_size(F.col("n_tokens"), length) - F.col("n_tokens")).cast("int")))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return rows.select("sequence_id", F.concat(joined, pad).alias("ids"), "n_tokens", F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("pieces"))
