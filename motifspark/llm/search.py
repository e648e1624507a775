"""Ranked lexical search the reversed way: the queries are indexed, the documents stream by.

The items (queries) are few beside the documents, so an inverted index over the items'
terms is broadcast, block by block of at most ``BLOCK_BYTES`` of item text, and each
document is read once a pass and dropped. Two passes over the documents for a block:

1. Statistics: documents and terms in all, and for each term of the block the documents
   that hold it. Tasks count, Spark sums: one row for each task and term.
2. Scores: each document's counts of indexed terms go through the postings, which gives
   its scores for all items; an item keeps a heap of its best documents, and only scores
   that beat the heap's least are put in. A task ends with its heaps as rows.

Heaps merge by windows, first by item and a salt of the task, then by item, so the rows
of an item never meet in one task before each salt has cut them to ``top``.

All is exact: integer scores, no candidate is skipped. Term equality is that of 64-bit
hashes. Defined results: terms are runs of ASCII letters, digits and characters beyond
ASCII, of which A-Z alone are lower-cased; a null or empty text has no terms, is not
counted and scores for no item; each row of items is an item of its own and each row of
docs a document of its own, also where ids repeat; a null id comes before all others
among equal scores; an item without a scoring document has no row.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

BLOCK_BYTES = 4 << 20
SALTS = 64
NO_ID = -(2**63)
_TABLE = 1 << 21  # postings and scores held at once
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms in order, and the text that each stands in."""
    low = np.where(_TERM[buf], tx.LOWER[buf], np.uint8(32))
    starts, ends, doc = tx.words(low, off)
    return tx.span_hash(tx.byte_prefix(low), starts, ends, "byte"), doc


class Index:
    """The inverted index of a block of items: distinct terms in order of hash, and for each the items that hold it, with how often."""

    def __init__(self, texts: list[str | None]):
        data = [(t or "").encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        found, item = terms(np.frombuffer(b"".join(data), np.uint8), off)
        self.n_items = len(texts)
        self.terms, of = np.unique(found, return_inverse=True)
        keys, self.times = np.unique(of * self.n_items + item, return_counts=True)
        self.item = keys % max(self.n_items, 1)
        self.first = np.searchsorted(keys, np.arange(len(self.terms) + 1) * self.n_items)

    def counts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text its number of terms; and rows (text, term of the index, times it is met) in order of text."""
        found, doc = terms(buf, off)
        n = np.bincount(doc, minlength=len(off) - 1)
        if not len(self.terms):
            e = np.empty(0, np.int64)
            return n, e, e, e
        at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
        met = self.terms[at] == found
        keys, tf = np.unique(doc[met] * len(self.terms) + at[met], return_counts=True)
        return n, keys // len(self.terms), keys % len(self.terms), tf


def _statistics(index):
    """Arrow batches of doc_id, text to (term, n): documents that hold each term; documents with a term as -1, terms in all as -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        df, docs, length = np.zeros(len(ix.terms), np.int64), 0, 0
        for _, buf, off in tx.chunks(batches):
            n, _, term, _ = ix.counts(buf, off)
            docs, length = docs + int((n > 0).sum()), length + int(n.sum())
            df += np.bincount(term, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([df[some], [docs, length]]))], ["term", "n"])

    return run


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Heaps:
    """For each item the best (score, -id) met so far, at most ``top``; floor: what a score must reach to go in."""

    def __init__(self, n_items: int, top: int):
        self.top, self.floor = top, np.ones(n_items, np.int64)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: (documents, items)."""
        doc, item = np.nonzero(scores >= self.floor)
        for d, i, s in zip(ids[doc].tolist(), item.tolist(), scores[doc, item].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.top:
                heapq.heappush(heap, (s, -d))
            else:
                heapq.heappushpop(heap, (s, -d))
            if len(heap) == self.top:
                self.floor[i] = heap[0][0]


def _scored(index, weight, n_docs: int, length: int, top: int):
    """Arrow batches of doc_id, text to the heaps of a task: item (number in the block), doc_id, score, salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, w = index.value, weight.value
        heaps = Heaps(ix.n_items, top)
        for batch, buf, off in tx.chunks(batches):
            ident = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n, doc, term, tf = ix.counts(buf, off)
            m = 75 + 25 * n[doc] * n_docs // max(length, 1)
            part = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            width = ix.first[term + 1] - ix.first[term]  # a row's postings
            load = np.concatenate([[0], np.cumsum(np.bincount(doc, width, batch.num_rows) + ix.n_items)])
            a = 0
            while a < batch.num_rows:  # documents whose postings and scores fit together; one has no more than the whole index
                b = max(a + 1, int(np.searchsorted(load, load[a] + _TABLE, side="right")) - 1)
                rows = slice(*np.searchsorted(doc, [a, b]))
                wide = width[rows]
                upto = np.cumsum(wide)
                posting = np.repeat(ix.first[term[rows]] - (upto - wide), wide) + np.arange(int(wide.sum()))
                scores = np.zeros((b - a, ix.n_items), np.int64)
                np.add.at(scores.reshape(-1), np.repeat((doc[rows] - a) * ix.n_items, wide) + ix.item[posting], np.repeat(part[rows], wide) * ix.times[posting])
                heaps.offer(scores, ident[a:b])
                a = b
        rows = [(i, -d, s) for i, heap in enumerate(heaps.heaps) for s, d in heap]
        item, ids, score = (pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], [])))
        yield pa.RecordBatch.from_arrays([item, pa.compute.if_else(pa.compute.equal(ids, NO_ID), None, ids), score, pa.array([TaskContext.get().partitionId() % SALTS] * len(rows), pa.int64())], ["item", "doc_id", "score", "salt"])

    return run


def _merged(heaps: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = heaps.withColumn("rank", rank("item", "salt")).where(F.col("rank") <= top).drop("rank", "salt")
    return first.withColumn("rank", rank("item")).where(F.col("rank") <= top)


def _blocks(items: DataFrame) -> list[DataFrame]:
    """items (item_id, text) in parts of about BLOCK_BYTES; each item's size is counted, and parts are made smaller until they hold or have one item."""
    sized = items.select("item_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    total = sized.agg(F.sum("bytes"), F.count("*")).first()
    n = max(1, math.ceil((total[0] or 0) / BLOCK_BYTES))
    while True:
        dealt = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        largest = dealt.groupBy("block").agg(F.sum("bytes").alias("b"), F.countDistinct("item_id", "text").alias("n")).where(F.col("n") > 1).agg(F.max("b")).first()[0]
        if n == 1 or (largest or 0) <= 2 * BLOCK_BYTES:
            return [dealt.where(F.col("block") == b).select("item_id", "text") for b in range(n)]
        n *= 2


def search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each item its ``top`` documents with a score above 0."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    schema, out = items.schema["item_id"], []
    for block in _blocks(items):
        rows = block.collect()  # BLOCK_BYTES of text bound it
        index = spark.sparkContext.broadcast(Index([r["text"] for r in rows]))
        counted = dict(own.mapInArrow(_statistics(index), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
        n_docs, length = counted.pop(-1, 0), counted.pop(-2, 0)
        df = np.zeros(len(index.value.terms), np.int64)
        df[list(counted)] = list(counted.values())
        weight = spark.sparkContext.broadcast(weights(df, n_docs))
        best = _merged(own.mapInArrow(_scored(index, weight, n_docs, length, top), "item long, doc_id long, score long, salt long"), top)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {schema.dataType.simpleString()}")
        out.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)
