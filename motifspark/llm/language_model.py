"""LM scoring with Elias-Fano n-gram tries.

Tokens are words (A-Z lower-cased) and one end for each text. Base probabilities
are add-half unigrams over all training tokens. The model is a trigram over all
words, whatever their counts. Conditional probabilities are smoothed towards the
shorter context with a Dirichlet prior of ``strength``: an n-gram that training has
not seen has its shorter one's probability times its context's back-off weight.

All counts are taken over all training documents. Documents go to blocks of about
``block_tokens`` tokens by a hash of their id and text. A block asks for the distinct
words and n-grams that it holds, by their hashes; the same rows carry its own counts,
so one shuffle by n-gram both sums and answers. The hashes of a block travel sorted
and Elias-Fano coded, a run of them to each range of hashes, and only what other
blocks hold too is answered: the rest is the block's own. As every text has an end, a
context's count is that of its own n-gram (at a text's start, the number of texts), so
contexts need no rows.

A block numbers its own words; of the n-grams that it asked for, those that training
has seen make its trie: sorted levels of symbols and child pointers in Elias-Fano
code, probabilities and back-off weights quantised to 16 bits, in one anonymous
memory map, from which lookups read packed bits where they stand. A lookup walks from
context to context: the successor of a symbol inside its parent's range; where there
is none, it backs off. No task holds more of the model than its block uses.

Defined results: null text has its end token only; a null id is hashed as empty;
repeated rows each count and each get their row; with no training text N and V are
0 and unseen words share the whole mass. Words compare by 64-bit hashes, so counts of
words and base scores are whole. The model's n-grams compare by ``SPARE_BITS`` more
bits than the logarithm of their number (64 at most), so that at any size of corpus one
in 2**SPARE_BITS is expected to meet a stranger.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

SPARE_BITS = 24
END = tx.mix(np.array([0x0E4D], np.uint64))[0]
PAD = 0  # the symbol and the hash of a place before the text


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits (under 64) side by side in 64-bit words, one spare word at the end."""
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros((len(values) * bits >> 6) + 2, np.uint64)
    if bits and len(values):
        v = values.astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(v << shift, first)
        over = np.flatnonzero(shift + tx.U(bits) > tx.U(64))  # one value at most goes on into each next word
        out[word[over] + 1] |= v[over] >> (tx.U(64) - shift[over])
    return out


def unpack(words: np.ndarray, i: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), np.int64)
    at = i * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    v = words[word] >> shift
    over = np.flatnonzero(shift + tx.U(bits) > tx.U(64))
    v[over] |= words[word[over] + 1] << (tx.U(64) - shift[over])
    return (v & tx.U((1 << bits) - 1)).astype(np.int64)


#: The place of each one of each byte, eight to a byte.
_IN_BYTE = np.array([([b for b in range(8) if byte >> b & 1] + [0] * 8)[:8] for byte in range(256)], np.uint8).ravel()


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with the number of ones before each word of these."""

    @staticmethod
    def build(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Words of low bits, words of high bits, counts of ones before these, number of low bits."""
        n = max(1, len(values))
        low_bits = max(0, int(bound // n).bit_length() - 1)
        v = values.astype(np.uint64)
        size = ((len(v) + (bound >> low_bits) + 2) >> 6) + 1
        unary = np.zeros(size * 64, np.uint8)
        unary[(v >> tx.U(low_bits)).astype(np.int64) + np.arange(len(v))] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        before = np.cumsum(np.bitwise_count(high), dtype=np.uint64) - np.bitwise_count(high)
        return pack(v & tx.U((1 << low_bits) - 1), low_bits), high, before, low_bits

    def __init__(self, low: np.ndarray, high: np.ndarray, before: np.ndarray, low_bits: int, n: int):
        self.low, self.high, self.before, self.bits, self.n = low, high, before, low_bits, n
        self.zeros = np.arange(len(high), dtype=np.uint64) * tx.U(64) - before

    def _select(self, i: np.ndarray, one: bool = True) -> np.ndarray:
        """Places of the ones (or zeros) number i: the word by its count, then halves of the word, then its byte."""
        before = self.before if one else self.zeros
        i = i.astype(np.uint64)
        at = np.searchsorted(before, i, side="right") - 1
        word, left = self.high[at] if one else ~self.high[at], (i - before[at]).astype(np.uint8)
        at <<= 6
        shift = np.zeros(len(i), np.uint8)
        for half in (32, 16, 8):
            ones = np.bitwise_count(word & tx.U((1 << half) - 1))
            up = left >= ones
            left -= ones * up
            shift += np.uint8(half) * up
            word = np.where(up, word >> tx.U(half), word)
        at += shift + _IN_BYTE[(word.astype(np.uint8).astype(np.uint16) << np.uint16(3)) | left]
        return at

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i) - i) << self.bits) | unpack(self.low, i, self.bits)

    def _from_high(self, high: np.ndarray) -> np.ndarray:
        """The first places whose high bits are at least these."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        out[some] = self._select(high[some] - 1, one=False) - high[some] + 1
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each range [lo, hi) the first place whose value is at least x (under the bound): by its high bits, then by halves."""
        lo, hi = lo.copy(), hi.copy()
        wide = np.flatnonzero(hi - lo > 3)
        high = x[wide] >> self.bits
        lo[wide] = np.minimum(np.maximum(lo[wide], self._from_high(high)), hi[wide])
        hi[wide] = np.maximum(np.minimum(hi[wide], self._from_high(high + 1)), lo[wide])
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self[mid] < x[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo


class Trie:
    """Levels of n-grams in one anonymous memory map. A level's symbols are kept relative to their parents (parent place << bits | symbol), so that the level is monotone."""

    LOW = -12.0

    @classmethod
    def quantised(cls, log10p: np.ndarray) -> np.ndarray:
        return np.round(np.clip(log10p, cls.LOW, 0) / cls.LOW * 65535).astype(np.uint16)

    def __init__(self, bits: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """levels: for each order its sorted keys, their log10 probabilities and back-off weights. The first has all symbols, so places there are symbols."""
        self.bits = bits
        parts, shapes, above = [], [], 1
        for keys, logp, backoff in levels:
            first = np.searchsorted(keys >> bits, np.arange(above + 1))
            codes = EliasFano.build(keys, above << bits), EliasFano.build(first, len(keys) + 1)
            parts += [*codes[0][:3], *codes[1][:3], self.quantised(logp), self.quantised(backoff)]
            shapes.append((len(keys), codes[0][3], len(first), codes[1][3]))
            above = len(keys)
        size = [-(-p.nbytes // 8) * 8 for p in parts]
        place = np.concatenate([[0], np.cumsum(size)]).tolist()
        self.map = mmap.mmap(-1, max(1, place[-1]))
        views = []
        for p, at in zip(parts, place, strict=False):
            view = np.frombuffer(self.map, p.dtype, len(p), at)
            view[:] = p
            views.append(view)
        self.levels = []
        for k, (n, low, n_first, first_low) in enumerate(shapes):
            v = views[8 * k : 8 * k + 8]
            self.levels.append((EliasFano(*v[:3], low, n), EliasFano(*v[3:6], first_low, n_first), v[6], v[7], n))

    def _value(self, q: np.ndarray) -> np.ndarray:
        return q.astype(float) / 65535 * self.LOW

    def find(self, depth: int, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The places at a level of symbols under parents; -1 where there is no such n-gram."""
        level, first, _, _, n = self.levels[depth]
        out = np.full(len(parent), -1)
        have = np.flatnonzero(parent >= 0)
        if n and len(have):
            x = (parent[have] << self.bits) | symbol[have]
            hi = first[parent[have] + 1]
            at = level.successor(first[parent[have]], hi, x)
            inside = np.flatnonzero(at < hi)
            ok = inside[level[at[inside]] == x[inside]]
            out[have[ok]] = at[ok]
        return out

    def score(self, context: np.ndarray, v: np.ndarray, two: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 probability of w after v: of the longest n-gram there is, with the back-off weights of the contexts left.

        context: places of the bigrams that end in v; two: those of v, w.
        """
        (_, _, p1, b1, _), (_, _, p2, b2, _), (_, _, p3, _, _) = self.levels
        three = self.find(2, context, w)
        out = np.empty(len(w))
        for chosen, p, at in ((three >= 0, p3, three), ((three < 0) & (two >= 0), p2, two), ((three < 0) & (two < 0), p1, w)):
            out[chosen] = self._value(p[at[chosen]])
        for chosen, b, at in (((three < 0) & (context >= 0), b2, context), ((three < 0) & (two < 0), b1, v)):
            out[chosen] += self._value(b[at[chosen]])
        return out

    def log10(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.score(self.find(1, u, v), v, self.find(1, v, w), w)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, and their document numbers."""
    starts, ends, doc = tx.words(buf, off)
    word = tx.span_hash(tx.byte_prefix(tx.LOWER[buf]), starts, ends, "byte")
    n = len(off) - 1
    all_doc = np.concatenate([doc, np.arange(n)])
    order = np.argsort(all_doc, kind="stable")
    return np.concatenate([word, np.full(n, END)])[order], all_doc[order]


def _before(token: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """For each token the one k places before it in its document, else PAD."""
    out = np.full(len(token), PAD, token.dtype)
    out[k:] = np.where(doc[k:] == doc[:-k], token[:-k], token.dtype.type(PAD))
    return out


def gram_hash(*words: np.ndarray) -> np.ndarray:
    """Hash of the n-grams whose word hashes are given as columns, oldest first."""
    total = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        total = total * tx.U(0xD6E8FEB86659FD93) + w
    return tx.mix(total)


def _counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their weights."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(weight[order], at) if len(at) else np.empty(0, np.int64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and for each place the number of its value."""
    order = np.argsort(x)
    new = np.concatenate([np.ones(min(1, len(x)), bool), x[order][1:] != x[order][:-1]])
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    at = order[new]
    return x[at], at, number


Counted = tuple[np.ndarray, np.ndarray]


class Asked:
    """What a block asks for: distinct hashes of its n-grams (without the last ``drop`` bits) and of its words (whole), and their counts in its training texts."""

    def __init__(self, drop: int):
        self.drop = drop
        self.grams: list[Counted] = []
        self.words: list[Counted] = []

    def add(self, token: np.ndarray, doc: np.ndarray, train: np.ndarray) -> None:
        u, v = _before(token, doc, 2), _before(token, doc, 1)
        c = train.astype(np.int64)
        self.words = _added(self.words, _counted(token, c))
        self.grams = _added(self.grams, _counted(np.concatenate([gram_hash(v, token), gram_hash(u, v, token)]) >> tx.U(self.drop), np.tile(c, 2)))

    def merged(self) -> tuple[Counted, Counted]:
        return _merge(self.grams), _merge(self.words)


def _slim(x: np.ndarray) -> bytes:
    """Counts as their running sums, in Elias-Fano code; the last of these first."""
    total = np.cumsum(x)
    return np.append(total[-1:], 0)[:1].astype(np.int64).tobytes() + _run(total, int(x.sum()) + 1)


def _counts(data: bytes, n: int) -> np.ndarray:
    total = int(np.frombuffer(data[:8], np.int64)[0])
    return np.diff(_from_run(data[8:], n, total + 1), prepend=0)


def _run(keys: np.ndarray, bound: int) -> bytes:
    """Sorted values under bound in Elias-Fano code."""
    low, high, _, _ = EliasFano.build(keys, bound)
    return low.tobytes() + high.tobytes()


def _from_run(data: bytes, n: int, bound: int) -> np.ndarray:
    low_bits = max(0, int(bound // max(1, n)).bit_length() - 1)
    words = np.frombuffer(data, np.uint64)
    n_low = (n * low_bits >> 6) + 2
    i = np.arange(n)
    high = np.flatnonzero(np.unpackbits(words[n_low:].view(np.uint8), bitorder="little")) - i
    return high.astype(np.int64) << low_bits | unpack(words[:n_low], i, low_bits)


class Ranges:
    """Equal ranges of n-gram hashes, numbered from 0, and after them as many of word hashes."""

    def __init__(self, bits: int, ranges: int):
        self.ranges = ranges
        self.bounds = -(-(1 << bits) // ranges), -(-(1 << 64) // ranges)

    def bound(self, part: int) -> int:
        return self.bounds[part >= self.ranges]

    def cut(self, grams: Counted, words: Counted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of a range, its hashes counted from its start, and their counts."""
        for (k, c), bound, first in zip((grams, words), self.bounds, (0, self.ranges), strict=True):
            part = (k // tx.U(bound)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(k) else np.empty(0, np.int64)
            for a, b in zip(at.tolist(), np.append(at[1:], len(k)).tolist(), strict=True):
                yield int(part[a]) + first, k[a:b] - tx.U(int(part[a]) * bound), c[a:b]


def _answered(ranges: Ranges):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        """One range of hashes: for each block which of its hashes other blocks hold too, and their sums."""
        bound = ranges.bound(key[0].as_py())
        n = t.column("n").to_pylist()
        cut = np.concatenate([[0], np.cumsum(n)]).tolist()
        k = np.concatenate([_from_run(x, m, bound) for x, m in zip(t.column("keys").to_pylist(), n, strict=True)])
        c = np.concatenate([_counts(x, m) for x, m in zip(t.column("c").to_pylist(), n, strict=True)])
        order = np.argsort(k)
        new = np.concatenate([[True], k[order][1:] != k[order][:-1]])
        start = np.flatnonzero(new)
        group = np.empty(len(k), np.int64)
        group[order] = np.cumsum(new) - 1
        sums, many = np.add.reduceat(c[order], start)[group], (np.diff(np.append(start, len(k))) > 1)[group]
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        return pa.table({
            "block": t.column("block"), "part": t.column("part"), "n": t.column("n"),
            "shared": pa.array([np.packbits(many[a:b]).tobytes() for a, b in spans], pa.binary()),
            "c": pa.array([_slim(sums[a:b][many[a:b]]) for a, b in spans], pa.binary()),
        })

    return run


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _added(parts: list[tuple[np.ndarray, np.ndarray]], part: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """parts and one more; the small ones are merged as soon as they are as many as the large one, so that repeats don't pile up."""
    parts.append(part)
    return [_merge(parts)] if sum(len(k) for k, _ in parts[1:]) > max(1 << 19, len(parts[0][0]) // 2) else parts


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strength: float = 40.0, block_tokens: int = 1 << 20, fold: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    A document is held out of training where crc32 of its id as text, modulo fold, is held.
    """
    ident = F.col(id_col).cast("long")
    hold = F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(fold)) == held
    own = docs.select(ident.alias("doc_id"), hold.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(parts):
            k, c = _merge(parts)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["word", "c"])

        parts, size, every = [], 0, 0
        for batch, buf, off in tx.chunks(batches):
            token, doc = tokens(buf, off)
            every += len(token)
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            token = token[train[doc]]
            parts.append(_counted(token, np.ones(len(token), np.int64)))
            size += len(parts[-1][0])
            if size > 2_000_000:
                parts = [_merge(parts)]
                size = len(parts[0][0])
                if size > 1_000_000:
                    yield send(parts)
                    parts, size = [], 0
        if parts:
            yield send(parts)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([every], pa.int64())], ["word", "c"])  # all tokens, held out or not

    counts = own.mapInArrow(words, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    total, distinct, texts, every = counts.agg(of(F.col("word").isNotNull()), F.count("word"), of(F.col("word") == int(END.view(np.int64))), of(F.col("word").isNull())).first()
    mass = total + 0.5 * (distinct + 1)
    blocks = max(1, -(-every // block_tokens))
    placed = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    bits = min(64, (3 * every).bit_length() + SPARE_BITS)
    ranges = Ranges(bits, max(16, 2 * blocks))

    def asked(key: tuple, t: pa.Table) -> pa.Table:
        own = Asked(64 - bits)
        for batch, buf, off in tx.chunks(t.to_batches()):
            token, doc = tokens(buf, off)
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            own.add(token, doc, train[doc])
        rows = [(p, len(k), _run(k, ranges.bound(p)), _slim(c)) for p, k, c in ranges.cut(*own.merged())]
        part, n, keys, c = zip(*rows, strict=True)
        return pa.table({"block": pa.array(np.full(len(rows), key[0].as_py(), np.int32)), "part": pa.array(part, pa.int32()), "n": pa.array(n, pa.int32()), "keys": pa.array(keys, pa.binary()), "c": pa.array(c, pa.binary())})

    rows = placed.groupBy("block").applyInArrow(asked, "block int, part int, n int, keys binary, c binary")
    answers = rows.groupBy("part").applyInArrow(_answered(ranges), "block int, part int, n int, shared binary, c binary")

    def scored(key: tuple, t: pa.Table, a: pa.Table) -> pa.Table:
        return _scored(t, a, total, texts, mass, strength, 64 - bits)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)


def _scored(t: pa.Table, a: pa.Table, total: int, texts: int, mass: float, strength: float, drop: int) -> pa.Table:
    """texts: the number of training texts; drop: bits left out of hashes."""
    if not t.num_rows:
        return pa.table({n: pa.array([], kind) for n, kind in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
    token, doc, train = [], [], []
    n = 0
    for batch, buf, off in tx.chunks(t.to_batches()):
        of_chunk, row = tokens(buf, off)
        token.append(of_chunk)
        doc.append((row + n).astype(np.int32))
        train.append(~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)[row])
        n += batch.num_rows
    token, doc, train = np.concatenate(token), np.concatenate(doc), np.concatenate(train)

    # Symbols 1.. are the block's words; a level's place 0 is that of texts' starts.
    word, _, symbol = _distinct(token)
    symbol += 1
    bits = int(len(word)).bit_length()
    v = _before(symbol, doc, 1)
    keys2, at2, pair = _distinct(v << bits | symbol)
    pair += 1
    above = _before(pair, doc, 1)
    keys3, at3, each = _distinct(above << bits | symbol)
    one, two = _before(token, doc, 1), _before(token, doc, 2)
    # What the block asked for, in order as the ranges of hashes are: n-grams, then words.
    key, _, gram = _distinct(np.concatenate([gram_hash(one[at2], token[at2]), gram_hash(two[at3], one[at3], token[at3])]) >> tx.U(drop))
    own = np.concatenate([np.bincount(pair - 1, train, len(keys2)), np.bincount(each, train, len(keys3))])
    c = np.concatenate([np.bincount(gram, own, len(key)), np.bincount(symbol - 1, train, len(word))]).astype(np.int64)
    n_key = len(key)
    del token, train, key, one, two, own
    a = a.sort_by("part")
    shared = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(a.column("shared").to_pylist(), a.column("n").to_pylist(), strict=True)])
    c[shared.astype(bool)] = np.concatenate([_counts(x, int(np.unpackbits(np.frombuffer(y, np.uint8), count=k).sum())) for x, y, k in zip(a.column("c").to_pylist(), a.column("shared").to_pylist(), a.column("n").to_pylist(), strict=True)])

    word_c, n2, n3 = c[n_key:], c[gram[: len(keys2)]], c[gram[len(keys2) :]]
    base = np.log10((word_c + 0.5) / mass)
    p1 = np.concatenate([[1.0], (word_c + 0.5) / mass])
    c1 = np.concatenate([[texts], word_c])
    p2 = np.concatenate([[1.0], (n2 + strength * p1[keys2 & ((1 << bits) - 1)]) / (c1[keys2 >> bits] + strength)])
    c2, keys2 = np.concatenate([[texts], n2]), np.concatenate([[0], keys2])
    p3 = (n3 + strength * p2[pair[at3]]) / (c2[keys3 >> bits] + strength)
    columns = above[at3], pair[at3], v[at3], symbol[at3]
    del c, gram, v, pair, above, at2, at3

    # The model has what training has seen.
    seen2 = c2 > 0
    seen2[0] = True
    seen3 = n3 > 0
    place2 = np.cumsum(seen2) - 1
    keys3 = place2[keys3[seen3] >> bits] << bits | keys3[seen3] & ((1 << bits) - 1)
    weight = lambda n: np.log10(strength / (n + strength))
    trie = Trie(bits, [(np.arange(len(word) + 1), np.log10(p1), weight(c1)), (keys2[seen2], np.log10(p2[seen2]), weight(c2[seen2])), (keys3, np.log10(p3[seen3]), np.zeros(len(keys3)))])
    places = trie.find(1, keys2 >> bits, keys2 & ((1 << bits) - 1))

    def looked_up(at: slice) -> np.ndarray:
        context, two, before, last = (x[at] for x in columns)
        return trie.score(places[context], before, places[two], last)

    p = np.concatenate([looked_up(slice(i, i + (1 << 18))) for i in range(0, len(n3), 1 << 18)])
    sums = lambda x: np.bincount(doc, x, n)
    known = sums((word_c > 0)[symbol - 1]).astype(np.int64)
    return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": pa.array(np.bincount(doc, minlength=n)), "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, total, np.int64)), "base_score": pa.array(sums(base[symbol - 1])), "score": pa.array(sums(p[each]))})
