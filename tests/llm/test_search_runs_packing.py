import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from motifspark.llm import packing, periodic, queries, search, tokens
from motifspark.llm import text as tx

from .test_operators import SCHEMA, WORD, docs, empty, rows  # noqa: F401

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ODD_ITEMS = [(1, "the of THE and w30"), (2, None), (3, ""), (3, "boiler plate line"), (None, "ñ é ü"), (4, "... !"), (1, "the of THE and w30"), (5, "w1 " * 3000)]


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(rows, items, top=20):
    tf = [Counter(terms_of(t)) for _, t in rows]
    n_docs, length = sum(bool(c) for c in tf), sum(map(Counter.total, tf))
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for (d, _), c in zip(rows, tf, strict=True):
            m = 75 + 25 * c.total() * n_docs // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                scored.append((-s, -(2**63) if d is None else d))
        out += [(item, k, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, -(2**63) if r.doc_id is None else r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [search.BLOCK_BYTES, 3000])
def test_search_equals_brute_force(spark, docs, rows, monkeypatch, block):  # noqa: F811
    """Nulls, repeated rows and items, ties, items over several blocks; other columns of the tables don't matter."""
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    items = spark.createDataFrame([(*i, "x", 1) for i in ODD_ITEMS], "item_id long, text string, doc_id string, score long")
    same = [(*r[:2],) for r in rows] + [(30 + i, "w30 tie tie") for i in range(30)] + [(None, "w30 tie tie")]
    extra = spark.createDataFrame([(*r, None, None, None, None, None, None) for r in same[len(rows) :]], SCHEMA)
    assert found(search.search(docs.unionByName(extra), items)) == plain_search(same, ODD_ITEMS)


def test_search_in_small_steps(spark, docs, rows, monkeypatch):  # noqa: F811
    """Documents whose postings don't fit together are scored one by one, and heaps drop what falls out."""
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    index = search.Index([t for _, t in ODD_ITEMS])
    assert (np.diff(index.first) > 0).all() and index.times.max() == 3000
    assert found(search.search(docs, items, top=2)) == plain_search([r[:2] for r in rows], ODD_ITEMS, 2)
    heaps = search.Heaps(1, 3)
    r = random.Random(2)
    scores = [r.randrange(1, 9) for _ in range(200)]
    for a in range(0, 200, 7):
        heaps.offer(np.array(scores[a : a + 7])[:, None], np.arange(a, min(a + 7, 200)))
    assert sorted(heaps.heaps[0], reverse=True) == [(s, -d) for s, d in sorted(((s, d) for d, s in enumerate(scores)), key=lambda x: (-x[0], x[1]))[:3]]


def test_search_of_empty_tables(spark, docs, empty):  # noqa: F811
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    assert found(search.search(empty, items)) == []
    assert found(search.search(docs, items.limit(0))) == []
    assert search.search(docs, items).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_search_query_equals_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.op11_lexical_search(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(queries.OP11_SQL).fetchall())


def plain_runs(words, least=12):
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.add((i, j - i + q, q))
            i = j + 1
    least_of = {}
    for s, length, q in sorted(out, key=lambda x: x[2]):
        least_of.setdefault((s, length), q)
    return sorted((s, length, q) for (s, length), q in least_of.items())


def plain_kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def periodic_cases():
    r = random.Random(5)
    cases = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 50, ["a", "b"] * 90, fibonacci(377), [str(i.bit_count() % 2) for i in range(600)]]
    for _ in range(120):
        size = r.choice([1, 2, 3, 5, 50])
        w = [str(r.randrange(size)) for _ in range(r.randrange(1, 120))]
        a, p = r.randrange(len(w)), r.randrange(1, 40)
        cases.append(w[:a] + [w[a + i % min(p, len(w) - a)] for i in range(r.randrange(200))] + w[r.randrange(len(w)) :])
    return cases


@pytest.mark.parametrize(("tile", "long_bytes"), [(periodic.TILE, 8 * periodic.TILE), (16, -1), (32, 100), (64, -1)])
def test_periodic_runs_equal_brute_force(spark, tile, long_bytes):
    """In one tile, and in tiles so small that runs reach over many of them."""
    cases = periodic_cases()
    texts = [(i, "  ".join(w) + "\n") for i, w in enumerate(cases)]
    got = periodic.periodic_runs(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), tile=tile, long_bytes=long_bytes).collect()
    assert len(got) == len(cases)
    for g in got:
        words = cases[g.doc_id]
        want = plain_runs(words)
        assert [tuple(x) for x in g.runs] == want, (g.doc_id, tile)
        assert g.kept == plain_kept(words, want) and g.n_words == len(words)


@pytest.mark.parametrize("long_bytes", [-1, 1 << 20])
def test_periodic_runs_of_odd_rows(docs, empty, rows, long_bytes):  # noqa: F811
    """Null and repeated ids and texts, very long texts, extra columns, empty tables."""
    got = periodic.periodic_runs(docs, long_bytes=long_bytes).collect()
    want = []
    for r in rows:
        words = WORD.findall(r[1] or "")
        if len(set(words)) == 1:
            found = [(0, len(words), 1)] if len(words) >= 12 else []
        else:
            found = plain_runs(words)
        want.append((r[0], len(words), found, plain_kept(words, found)))
    assert sorted(((g.doc_id, g.n_words, [tuple(x) for x in g.runs], g.kept) for g in got), key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(empty, long_bytes=long_bytes).collect() == []


def test_hashes_alone_decide_no_run():
    """Words whose stretches of two powers have equal hashes without being equal, and the work of repeated words."""
    words = tx.mix(np.array([i.bit_count() % 2 for i in range(1 << 14)], np.uint64))
    for q, i, j in periodic.intervals(words, np.array([0, len(words)]), 1, len(words), 12):
        assert (words[i:j] == words[i + q : j + q]).all() and (i == 0 or words[i - 1] != words[i + q - 1])
    assert len(periodic.intervals(tx.mix(np.zeros(200_000, np.uint64)), np.array([0, 200_000]), 1, 200_000, 12)) == 1


def test_periodic_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(table)
    planted = 0
    for row in table:
        words, h = WORD.findall(row.text or ""), zlib.crc32(str(row.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        want = [tuple(map(int, x)) for x in fast_runs(words)]
        r = got[row.doc_id]
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best), row.doc_id
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_kept(words, want).encode()).hexdigest()
    assert planted > 5


def fast_runs(words):
    """All periods of longer texts, one comparison each."""
    x = np.unique(words, return_inverse=True)[1]
    found = {}
    for q in range(1, len(x) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]])))
        for i, j in edge.reshape(-1, 2):
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


ODD_TEXTS = ["", None, "a  b", "a \n b", "a\n  b c", " lead", "trail ", "a b　c", "é è à", "x" * 9000, " " * 5000 + "a b", "<|endoftext|> b", "Привет мир как дела", "中文 字 符", "a\x7f b", "\x1c \x1d", "it's we'll  's", "q" + "\n" * 300, "q" + "\n" * 300 + "x", "q" + " \n" * 300 + " x" + " " * 300 + "\x1c" + "　" * 300, " " * 300, "a" + " " * 256 + "b", " " * 255 + "b", "é" * 400]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check_pieces(pieces, texts, tokenizer, length=1024):
    """texts: id to the texts of its rows. Whole documents come back from the pieces, sequences are gapless."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length * 4 == len(p.ids)
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
    for p in of_sequence.values():
        at = 0
        for x in sorted(p, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at == length or at & (at - 1) == 0 and at < length
    assert set(of_doc) == set(texts)
    for i, of in texts.items():
        whole = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in of]
        want = Counter((len(ids), ids[k]) for ids in whole for k in range(len(ids)))
        assert Counter((p.doc_tokens, int(x)) for p in of_doc[i] for x in np.frombuffer(p.ids, "<u4")) == want
        if len(of) == 1:
            parts = sorted(of_doc[i], key=lambda p: p.start)
            assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
            assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist() == whole[0]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    path = tokens.public_path()
    for t in ODD_TEXTS:
        assert tokens.encode(path, t or "").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t
    assert len(tokens.encode(path, " " * 1_000_000 + "b")) == 1_000_000


@pytest.mark.parametrize("block", [1 << 22, 500])
def test_packing_keeps_every_id_once(spark, docs, rows, tokenizer, block):  # noqa: F811
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    for i, t in enumerate(ODD_TEXTS):
        texts[1000 + i].append(t)
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    packed = packing.pack(docs.unionByName(odd, allowMissingColumns=True), block_tokens=block)
    check_pieces(packed.collect(), texts, tokenizer)


def test_packing_query_and_sequences(spark, tokenizer):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.pack(table).cache()
    pieces = packed.collect()
    check_pieces(pieces, {r.doc_id: [r.text] for r in table.collect()}, tokenizer)
    got = queries.op13_packing(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in got) == sorted((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, p.sequence_id, p.offset) for p in pieces)
    whole = packing.sequences(packed, pad_id=7).collect()
    assert sum(s.n_tokens for s in whole) == sum(p.length for p in pieces)
    for s in whole:
        ids = np.frombuffer(s.ids, "<u4")
        assert len(ids) == (s.n_tokens if s.n_tokens & (s.n_tokens - 1) == 0 else 1024) and (ids[s.n_tokens :] == 7).all()
        assert [x.offset for x in s.pieces] == [sum(y.length for y in s.pieces[:k]) for k in range(len(s.pieces))]
    assert packing.pack(table.limit(0)).collect() == []


def test_best_fit_takes_the_tightest_window():
    r = random.Random(3)
    for length in (1, 7, 64, 1024):
        for n in (0, 1, 30, 400):
            sizes = [r.randrange(1, length + 1) for _ in range(n)]
            windows = packing.best_fit(sizes, length)
            rooms = []
            for i in sorted(range(n), key=lambda i: -sizes[i]):
                fit = min((x for x in rooms if x >= sizes[i]), default=None)
                if fit is not None:
                    rooms.remove(fit)
                rooms.append((length if fit is None else fit) - sizes[i])
            assert sorted(length - sum(sizes[i] for i in w) for w in windows) == sorted(rooms)
            cut = packing.filled(windows, sizes, length)
            for i in range(n):
                mine = sorted(p[1:] for w in cut for p in w if p[0] == i)
                assert [a for a, _ in mine] == [sum(b for _, b in mine[:k]) for k in range(len(mine))] and sum(b for _, b in mine) == sizes[i]
            assert sum(sum(p[2] for p in w) != length for w in cut) <= length.bit_length()
            assert all(0 < sum(p[2] for p in w) <= length for w in cut)
