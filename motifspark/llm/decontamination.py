"""Benchmark decontamination by CGK embedding, bit-sampling LSH and edit verification.

Texts and items are sequences of lower-cased words without outer punctuation; the
distance is edit distance in words, and a document is contaminated by an item where
some stretch of it is within ``floor(rate * item words)`` edits.

Item-sized windows of a document are embedded by CGK random walks: a step reads a
symbol, and stays on it or moves on by a random bit of (step, symbol), so strings at
a small edit distance meet again and end at a small Hamming distance. Each repetition
has a walk of its own and samples ``bits`` of its places; the samples of all items,
keyed by size class and repetition, are the LSH index, and every item that a window's key
finds is a candidate. The number of repetitions follows from the target recall: it
is measured on seeded edits, at the full number allowed, of the items themselves.
Candidates are verified by an exact edit distance to any stretch around the window.

Which windows to embed: those that start where the document shares enough runs of q
words with an item of that size near one diagonal. Within e edits an item of n words
keeps n - q + 1 - q * e of its runs, and q is 3, 2 or 1, the largest that leaves one,
so no window is lost by this at any item size.

Items are a stated query set: they are taken in blocks of ``block_bytes`` of text and
each block goes to all tasks; documents are read once a block and never shuffled.

Defined results: a null or empty text or item matches nothing; of several stretches
the best is given (least distance, then first found); repeated items and rows each
give their rows; other columns than the named ones are not read by ``contaminated``
and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b".,;:!?\"'()[]{}*_")] = True


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without outer punctuation, and their document numbers; words of punctuation alone are left out."""
    starts, ends, doc = tx.words(buf, off)
    plain = np.concatenate([[0], np.cumsum(~PUNCTUATION[buf])])
    keep = plain[ends] > plain[starts]
    starts, ends, doc = starts[keep], ends[keep], doc[keep]
    inner = np.flatnonzero(~PUNCTUATION[buf])
    if len(starts):
        starts = inner[np.searchsorted(inner, starts)]
        ends = inner[np.searchsorted(inner, ends) - 1] + 1
    return tx.span_hash(tx.byte_prefix(tx.LOWER[buf]), starts, ends, "byte"), doc


def allowed(n_words: int, rate: float) -> int:
    return int(rate * n_words + 1e-9)


def run_length(n_words: int, edits: int) -> int:
    """The largest q up to 3 for which so many edits always leave a run of q words whole."""
    return next((q for q in (3, 2) if n_words - q + 1 > q * edits), 1)


def size_class(size: int) -> int:
    """The least size of those, alike within a quarter, that walk together."""
    least = 1
    while (above := max(least + 1, least * 5 // 4)) <= size:
        least = above
    return least


class Walks:
    """CGK walks for strings of at least one size: random bits for each repetition, and the places that it samples."""

    def __init__(self, size: int, repeats: int, bits: int, seed: int):
        rng = np.random.default_rng([seed, size])
        places = max(1, (9 * size + 4) // 5)  # a walk moves on at every other step, so these lie before its end
        self.bits = bits
        self.salts = rng.integers(0, 2**63, (places, repeats), dtype=np.uint64) * tx.U(2) + tx.U(1)
        self.sampled = np.zeros((places, repeats), bool)
        for r in range(repeats):
            self.sampled[rng.choice(places, min(bits, places), replace=False), r] = True

    def places(self, rows: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each step and the symbols that the walks of all rows and repetitions read at it; 0 after a row's end."""
        each = np.arange(len(rows))[:, None]
        at = np.zeros((len(rows), self.salts.shape[1]), np.int64)
        for step, salt in enumerate(self.salts):
            symbol = np.where(at < lengths[:, None], rows[each, np.minimum(at, rows.shape[1] - 1)], tx.U(0))
            yield step, symbol
            at += ((symbol * salt) >> tx.U(63)).astype(np.int64)

    def samples(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each row and repetition a hash of the sampled places."""
        out = np.zeros((len(rows), self.salts.shape[1]), np.uint64)
        for step, symbol in self.places(rows, lengths):
            take = np.flatnonzero(self.sampled[step])
            if len(take):
                out[:, take] = tx.mix(out[:, take] ^ symbol[:, take]) + tx.U(1)
        return out


def edited(rng: np.random.Generator, item: np.ndarray, edits: int) -> np.ndarray:
    """The item with so many words replaced, left out or put in, at random."""
    out = item.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(len(out) + 1)), int(rng.integers(3))
        if kind == 0 or at == len(out):
            out.insert(at, int(rng.integers(1, 2**63)))
        elif kind == 1:
            out[at] = int(rng.integers(1, 2**63))
        else:
            del out[at]
    return np.array(out, np.uint64)


def repetitions(words: list[np.ndarray], edits: list[int], recall: float, bits: int, seed: int, trials: int = 400, most: int = 512, steps: int = 200_000) -> int:
    """How many walks find so many of the edited items, measured on seeded edits of items drawn at random: ``trials`` of them, or as many as so many steps allow, but 20 at least."""
    rng = np.random.default_rng(seed)
    some = [i for i, w in enumerate(words) if len(w) > 1]
    if not some:
        return 1
    missed = []
    for i in rng.choice(some, trials).tolist():
        n = len(words[i])
        steps -= 2 * n
        if steps < 0 and len(missed) >= 20:
            break
        other = edited(rng, words[i], edits[i])[:n]
        rows = np.zeros((2, n), np.uint64)
        rows[0], rows[1, : len(other)] = words[i], other
        walks = Walks(size_class(n), 16, bits, seed + 1)
        same = np.mean([x[0] == x[1] for _, x in walks.places(rows, np.array([n, len(other)]))], axis=0)
        missed.append(1 - np.mean(same**bits))
    r = 1
    while r < most and np.mean(np.array(missed) ** r) > 1 - recall:
        r += 1
    return r


def best_stretch(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the part of stretch nearest to item in edits; free ends in stretch."""
    n = len(stretch)
    cost, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    column = np.arange(n + 1)
    for i, symbol in enumerate(item.tolist(), 1):
        sub = cost[:-1] + (stretch != symbol)
        drop = cost[1:] + 1
        best = np.concatenate([[i], np.minimum(sub, drop)])
        source = np.concatenate([[0], np.where(sub <= drop, origin[:-1], origin[1:])])
        # Insertions run along the row: the least of best[j] - j up to j, plus j.
        run = best - column
        least = np.minimum.accumulate(run)
        head = np.maximum.accumulate(np.where(run == least, column, 0))
        cost, origin = least + column, source[head]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


class Items:
    """A block of items as the tasks use it: their runs, and the LSH index of their samples."""

    def __init__(self, item_ids: list, texts: list, rate: float, recall: float, bits: int, seed: int):
        buf, off = tx.raw(pa.array([t or "" for t in texts], pa.string()))
        word, doc = word_hashes(buf, off)
        bounds = tx.word_bounds(doc, len(texts))
        self.ids = item_ids
        self.words = [word[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([allowed(len(w), rate) for w in self.words], np.int64)
        runs = np.array([run_length(n, e) for n, e in zip(self.sizes.tolist(), self.edits.tolist(), strict=True)], np.int64)
        self.need = self.sizes - runs + 1 - runs * self.edits
        self.grams = []
        for q in np.unique(runs[self.sizes > 0]).tolist():
            at, grams = tx.ngrams(word, doc, q)
            mine = runs[doc[at]] == q
            at, grams = at[mine], grams[mine]
            order = np.argsort(grams, kind="stable")
            self.grams.append((q, grams[order], doc[at][order], (at - bounds[doc[at]])[order]))
        self.seed, self.bits = seed, bits
        self.repeats = repetitions(self.words, self.edits.tolist(), recall, bits, seed)
        self.index: dict = {}
        self.classes = np.array([size_class(n) for n in self.sizes.tolist()], np.int64)
        for size in np.unique(self.classes[self.sizes > 0]).tolist():
            mine = np.flatnonzero((self.classes == size) & (self.sizes > 0))
            rows = np.zeros((len(mine), int(self.sizes[mine].max())), np.uint64)
            for row, i in zip(rows, mine.tolist(), strict=True):
                row[: self.sizes[i]] = self.words[i]
            keys = self._keys(size, rows, self.sizes[mine])
            order = np.argsort(keys.ravel(), kind="stable")
            self.index[size] = keys.ravel()[order], mine[order // self.repeats]

    def _keys(self, size: int, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """LSH keys by row and repetition."""
        walks = Walks(size, self.repeats, self.bits, self.seed)
        part = max(1, (1 << 21) // max(size, self.repeats))
        samples = np.concatenate([walks.samples(rows[a : a + part], lengths[a : a + part]) for a in range(0, len(rows), part)])
        return tx.mix(samples + np.arange(self.repeats, dtype=np.uint64) * tx.U(0x9E3779B97F4A7C15))

    def _windows(self, word: np.ndarray, doc: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Size classes, and sizes, documents and first words (some before the document) of the windows worth embedding."""
        found = []
        for q, gram, gram_item, gram_at in self.grams:
            at, grams = tx.ngrams(word, doc, q)
            low = np.searchsorted(gram, grams)
            met = np.flatnonzero(gram[np.minimum(low, len(gram) - 1)] == grams)
            many = np.searchsorted(gram, grams[met], side="right") - low[met]
            entry = np.repeat(low[met], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            item, place, owner = gram_item[entry], np.repeat(at[met], many) - gram_at[entry], np.repeat(doc[at[met]], many)
            # The runs that an item keeps lie on diagonals at most its edits apart.
            edits = self.edits[item]
            wide = 4 * (len(word) + int(self.sizes.max()) + 1)
            key = (item * n_docs + owner) * wide + place + wide // 2
            order = np.argsort(key)
            item, owner, place, key, edits = item[order], owner[order], place[order], key[order], edits[order]
            enough = np.searchsorted(key, key + edits, side="right") - np.searchsorted(key, key - edits) >= self.need[item]
            found.append(np.stack([self.classes[item], self.sizes[item], owner, place])[:, enough])
        classes, sizes, owner, place = np.unique(np.hstack(found), axis=1) if found else np.empty((4, 0), np.int64)
        for size in np.unique(classes).tolist():
            mine = classes == size
            yield size, sizes[mine], owner[mine], place[mine]

    def hits(self, word: np.ndarray, doc: np.ndarray, n_docs: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, distance, start word, end word) of the best stretch of each pair."""
        bounds = tx.word_bounds(doc, n_docs)
        best: dict = {}
        for size, sizes, owner, place in self._windows(word, doc, n_docs):
            index, index_item = self.index[size]
            part = max(1, (1 << 21) // int(sizes.max()))
            for o in range(0, len(place), part):
                d, p, n = owner[o : o + part], place[o : o + part], sizes[o : o + part]
                a, b = np.maximum(p, bounds[d]), np.minimum(p + n, bounds[d + 1])
                rows = word[np.minimum(a[:, None] + np.arange(int(n.max())), len(word) - 1)]
                keys = self._keys(size, rows, b - a).ravel()
                low, high = np.searchsorted(index, keys), np.searchsorted(index, keys, side="right")
                many = high - low
                entry = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                pairs = np.unique(np.stack([index_item[entry], np.repeat(np.arange(len(keys)), many) // self.repeats]), axis=1)
                for i, k in pairs.T.tolist():
                    self._verify(best, word, bounds, i, int(d[k]), int(p[k]))
        for (d, i), (distance, s, e, *_) in sorted(best.items()):
            yield d, i, distance, s, e

    def _verify(self, best: dict, word: np.ndarray, bounds: np.ndarray, i: int, d: int, p: int) -> None:
        lo, n, e = int(bounds[d]), int(self.sizes[i]), int(self.edits[i])
        left, right = max(lo, p - e), min(int(bounds[d + 1]), p + n + e)
        have = best.get((d, i))
        if have and (have[0] == 0 or have[3] <= left and right <= have[4]):
            return
        distance, s, t = best_stretch(self.words[i], word[left:right])
        if distance <= e and (have is None or distance < have[0]):
            best[d, i] = (distance, left - lo + s, left - lo + t, left, right)


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int, options: dict) -> Iterator[Items]:
    held: list = []
    size = 0
    for row in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        held.append(row)
        size += len(row[1] or "") + 64
        if size >= block_bytes:
            yield Items([r[0] for r in held], [r[1] for r in held], **options)
            held, size = [], 0
    if held:
        yield Items([r[0] for r in held], [r[1] for r in held], **options)


DEFAULTS = {"rate": 0.2, "recall": 0.995, "bits": 4, "seed": 11}


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20, **options) -> DataFrame:
    """doc_id, item_id, distance, start_word, end_word for each contaminated document and item (words as counted by ``word_hashes``)."""
    schema = "doc_id long, item_id long, distance long, start_word long, end_word long"
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, item_id_col, item_text_col, block_bytes, DEFAULTS | options):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch, buf, off in tx.chunks(batches):
                rows = list(block.hits(*word_hashes(buf, off), batch.num_rows))
                if rows:
                    d, i, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array([block.ids[x] for x in i], pa.int64()), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "distance", "start_word", "end_word"])

        out = out.unionByName(own.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20, **options) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns; no join and no shuffle of texts."""
    for block in _blocks(items, item_id_col, item_text_col, block_bytes, DEFAULTS | options):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch, buf, off in tx.chunks(batches, text_col):
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, *_ in block.hits(*word_hashes(buf, off), batch.num_rows)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
