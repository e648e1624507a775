"""Substring dedup of word sequences by relative Lempel-Ziv parsing.

Each document is factored against the documents with smaller ids. The reference
reaches a task in blocks: the different contexts of one anchor (``anchors``) from every
document, or a context and later ones equal to it, indexed by their windows of
``window`` words. A document's context is
parsed greedily: where a window stands in the reference the factor is extended
word by word as far as its source agrees; factors of ``window`` words or more are
duplicate spans. Parsing goes on ``window`` - 1 words before a factor's end, so
windows that straddle its boundary are checked against all sources too.

Defined results: words are runs of characters other than space and tab to carriage
return; null text has none; repeats inside one document alone are no duplicates;
windows are judged on the input; word equality is that of 64-bit hashes; for null
and repeated ids see ``anchors``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors as an
from . import text as tx


def parse(doc: int, words: list, windows: list, at: int, n: int, index: dict, all_words: list, ends: list, owner: list, window: int) -> list[tuple[int, int]]:
    """Factors (first window, number of windows) of the n windows from word ``at`` on that the reference of smaller ids has.

    index: a window's hash to its first place in the block by id.
    """
    out, p = [], 0
    while p < n:
        source = index.get(windows[p])
        if source is None or owner[source[0]] >= doc:
            p += 1
            continue
        have, stop = source[1] + window, ends[source[0]]
        length = window
        while p + length < n + window - 1 and have < stop and words[at + p + length] == all_words[have]:
            length += 1
            have += 1
        out.append((p, length - window + 1))
        p += length - window + 1
    return out


def kernel(window: int):
    def run(key, ident, pos, count, buf, off):
        starts, ends, doc = tx.words(buf, off)
        word = tx.span_hash(tx.byte_prefix(buf), starts, ends, "byte")
        bounds = tx.word_bounds(doc, len(off) - 1)
        at, grams = tx.ngrams(word, doc, window)
        first = np.searchsorted(at, bounds[:-1])  # a context's windows stand in a row
        order = np.argsort(ident, kind="stable")
        word_list, owner, stops = word.tolist(), ident.tolist(), bounds[1:].tolist()
        gram_of = [grams[f : f + c].tolist() for f, c in zip(first.tolist(), count.tolist(), strict=True)]
        hit_ctx, hit_at = [], []
        group_start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() + [len(key)]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.arange(len(key))
        for a, b in zip(group_start, group_start[1:], strict=False):
            index: dict = {}
            for c in a + np.argsort(rank[a:b]):
                base = int(bounds[c])
                for p, n in parse(owner[c], word_list, gram_of[c], base, int(count[c]), index, word_list, stops, owner, window):
                    hit_ctx += [c] * n
                    hit_at += range(p, p + n)
                for p, g in enumerate(gram_of[c]):
                    index.setdefault(g, (c, base + p))
        return np.array(hit_ctx, np.int64), np.array(hit_at, np.int64)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 24) -> DataFrame:
    """doc_id, n_words, spans (removed word runs) and kept (words left, joined by spaces), one row for each row of docs."""
    unit = an.Unit("word", window, gram, same_document=False)
    own = an.own_rows(docs, id_col, text_col)

    def judge(batch, buf, off, row, start, end):
        starts, ends, doc = tx.words(buf, off)
        bounds = tx.word_bounds(doc, batch.num_rows)
        end = np.minimum(end, np.diff(bounds)[row])
        start, end, row = start[start < end], end[start < end], row[start < end]
        gone = np.zeros(len(starts) + 1, np.int32)
        np.add.at(gone, bounds[row] + start, 1)
        np.add.at(gone, bounds[row] + end, -1)
        stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
        # Kept words and one separator after each but a document's last.
        mask = np.zeros(len(buf) + 1, np.int32)
        np.add.at(mask, starts[stay], 1)
        np.add.at(mask, ends[stay], -1)
        size = ends[stay] - starts[stay]
        spaced = np.append(buf, np.uint8(32))
        source = np.repeat(starts[stay] - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1) + np.arange(int((size + 1).sum()))
        flat = spaced[np.minimum(source, len(buf))]
        tail = np.cumsum(size + 1) - 1
        flat[tail] = 32
        last = np.concatenate([doc[stay][1:] != doc[stay][:-1], [True]]) if len(stay) else np.empty(0, bool)
        keep = np.ones(len(flat), bool)
        keep[tail[last]] = False
        n_out = np.bincount(doc[stay], weights=size + ~last, minlength=batch.num_rows).astype(np.int64)
        left = np.concatenate([[0], np.cumsum(n_out)]).astype(np.int64)
        kept = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(left), pa.py_buffer(flat[keep].tobytes())).cast(pa.string())
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
        return pa.RecordBatch.from_arrays([an.true_ids(batch), pa.array(np.diff(bounds)), spans, kept], ["doc_id", "n_words", "spans", "kept"])

    return an.per_document(own, unit, an.copied_spans(own, unit, kernel(window)), judge, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string")
