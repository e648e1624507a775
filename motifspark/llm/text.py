"""Vectorised text helpers for Arrow batches: words, lines and rolling hashes.

A batch of texts is handled as one UTF-8 byte buffer with offsets, cut into
chunks of about ``chunk_bytes`` (a longer text makes a chunk of its own), so
memory follows the chunk and not the partition. Null texts count as empty.
Hashes are 64-bit: a polynomial over randomly mapped symbols, taken from prefix
sums, then mixed. They are equal in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_WORD = np.ones(256, bool)
IS_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_BYTE = np.random.default_rng(20240521).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_STEP = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, at least n of them."""
    if kind not in _POWERS or len(_POWERS[kind][0]) < n:
        size = max(n, 1 << 16)
        step = _STEP[kind]
        pair = []
        for base in (step, pow(step, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _POWERS[kind] = tuple(pair)
    up, down = _POWERS[kind]
    return up[:n], down[:n]


def prefix(values: np.ndarray, kind: str) -> np.ndarray:
    """Prefix sums of value * step**position, with a leading 0."""
    up, _ = _powers(kind, len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """Hash of the symbols in [start, end), the same wherever they stand."""
    _, down = _powers(kind, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + U(0x632BE59BD9B4E019) * (ends - starts).astype(np.uint64))


def byte_prefix(buf: np.ndarray) -> np.ndarray:
    return prefix(_BYTE[buf], "byte")


def ngrams(word_hash: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of k words that lie in one document."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    starts = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return starts, span_hash(prefix(word_hash, "word"), starts, starts + k, "word")


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and document numbers of the maximal word runs."""
    if not len(buf):
        e = np.empty(0, np.int64)
        return e, e, e
    w = IS_WORD[buf]
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    first = offsets[:-1]
    before[first[first < len(buf)]] = False
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Where each document's words begin; one more at the end."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and document numbers of the lines between newlines."""
    nl = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([offsets[:-1], nl + 1]))
    ends = np.sort(np.concatenate([nl, offsets[1:]]))
    per_doc = np.searchsorted(nl, offsets[1:]) - np.searchsorted(nl, offsets[:-1]) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per_doc)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.empty(0, np.uint8)
    return buf, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", chunk_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = raw(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + chunk_bytes, side="right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys stand twice or more, and which are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    many = again.copy()
    many[order[:-1][same]] = True
    return many, again
