import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.config import ScanConfig
from motifspark.functions import alphabet as al
from motifspark.jobs import registry
from motifspark.operators import kernel, scan, strand
from motifspark.sources import reads as rd

CFG = ScanConfig()


_FLIP = str.maketrans("0123", "3210")


def encode(seq):
    return "".join({"T": "0", "G": "1", "C": "2", "A": "3"}.get(c.upper(), "x") for c in seq)


def canon(w):
    return min((w + w)[i : i + len(w)] for i in range(len(w)))


def found(texts, lo, hi, cfg):
    """Each text's selected period, leading motif and counts by level."""
    n = len(texts)
    got = kernel.check([t.encode() for t in texts], np.broadcast_to(lo, n), np.broadcast_to(hi, n), cfg)
    out = [{level: (0, "", {}) for level in got} for _ in texts]
    for level, parts in got.items():
        for segments, c in parts:
            names = [x.decode() for x in c.words.strings()]
            for i in segments:
                rows = np.flatnonzero(c.segment == i)
                out[i][level] = (c.words.k, names[c.lead[i]], {names[c.motif[r]]: int(c.count[r]) for r in rows})
    return out


# Known rotations of single motifs.
@pytest.mark.parametrize(("motif", "least"), [("ATATATTTT", "TTTTATATA"), ("GCGACTTGACGC", "TTGACGCGCGAC"), ("GGGGGGGTGGG", "TGGGGGGGGGG")])
def test_least_rotation(spark, motif, least):
    assert canon(encode(motif)) == encode(least)
    row = spark.range(1).select(al.decode(al.canonical(al.encode(F.lit(motif)))).alias("m")).first()
    assert row.m == least


def test_digits_in_a_read_are_no_bases(spark):
    assert spark.range(1).select(al.encode(F.lit("tG0123NcA"))).first()[0] == "01xxxxN23"
    assert found(["TTAGGG" * 5 + "0123" * 9], 5, 32, CFG)[0]["low"][2] == found(["TTAGGG" * 5 + "N" * 36], 5, 32, CFG)[0]["low"][2]


def test_homopolymers(spark):
    df = spark.createDataFrame([(m,) for m in ("ATTTTTTT", "ATTTTTTTGC", "AAAAA", "TTT")], "m string")
    assert [r[0] for r in df.select(al.is_homopolymer(al.encode(F.col("m")))).collect()] == [False, False, True, True]


@pytest.mark.parametrize(("motif", "copies", "top", "count"), [("TTGCATCACACCCTCGCCG", 20, 32, 362), ("TTAGGG", 20, 32, 115), ("TTAGAGCCCACA", 20, 32, 229), ("TTTTGCCCTCATCACACCCTCGCCTCCTTCGC", 20, 32, 609), ("TGC" + "A" * 51, 10, 64, 487), ("TTAGGG", 10, 64, 55)])
def test_segment_check_finds_the_planted_motif(motif, copies, top, count):
    k, _, counts = found([motif * copies], 5, top, ScanConfig(5, top))[0]["high"]
    assert k == len(motif) and list(counts.values()) == [count]


def plain_check(s, lo, hi, cfg):
    out = {}
    for level, base in cfg.baselines.items():
        best, tf, seen = (0, "", {}), 0.0, []
        for k in range(lo, hi + 1):
            counts, lead, top = Counter(), "", 0
            for i in range(len(s) - k + 1):
                if "x" not in s[i : i + k]:
                    c = canon(s[i : i + k])
                    counts[c] += 1
                    if counts[c] > top:
                        lead, top = c, counts[c]
            total = sum(counts.values())
            if total and top / total >= max(base, tf) and len(set(lead)) > 1 and not any(k % t == 0 for t in seen):
                best, tf = (k, lead, dict(counts)), top / total
                seen.append(k)
        out[level] = best
    return out


@pytest.mark.parametrize(("low", "high", "motif_to"), [(3, 12, 9), (5, 32, 20), (3, 64, 45)])
def test_kernel_equals_plain_counting(low, high, motif_to):
    r = random.Random(high)
    cfg = ScanConfig(low, high)
    texts = []
    for _ in range(120):
        motif = "".join(r.choice("TGCA") for _ in range(r.randint(2, motif_to)))
        texts.append("".join(r.choice("TGCANtgca0") if r.random() < 0.05 else c for c in motif * 30)[: r.randint(0, 3 * high)])
    lo, hi = np.array([r.randint(low, low + 3) for _ in texts]), np.array([r.randint(2, high) for _ in texts])
    got = found(texts, lo, hi, cfg)
    for t, a, b, g in zip(texts, lo.tolist(), hi.tolist(), got, strict=True):
        assert g == plain_check(encode(t), a, b, cfg), t


def test_modes_equal_plain_counting(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("TGCAN" if i % 2 else "TTTGA") for _ in range(r.randint(0, 90))) for i in range(60)] + [None]
    cfg = ScanConfig(3, 40)
    out = kernel.modes(spark.createDataFrame(list(enumerate(texts)), "id long, seq string"), "seq", cfg).select("id", F.inline("modes"))
    got = {(x.id, x.k): (x.total, x.motifs, x.squares, x.most, x.kmer) for x in out.collect()}
    want = {}
    for i, t in enumerate(texts):
        s = encode(t or "")
        for k in range(3, 41):
            windows = [canon(s[j : j + k]) for j in range(len(s) - k + 1) if "x" not in s[j : j + k]]
            if windows:
                c, seen, lead, top = Counter(windows), Counter(), "", 0
                for w in windows:
                    seen[w] += 1
                    if seen[w] > top:
                        lead, top = w, seen[w]
                want[i, k] = (len(windows), len(c), sum(x * x for x in c.values()), top, lead)
    assert got == want


def rows_of(scanned):
    out: dict = {}
    for r in scanned.collect():
        out.setdefault((r.level, r.direction), {})[r.kmer] = r.cnt
    return out


def short(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "seq string")


def test_short_read_gates(spark):
    assert not rows_of(scan.scan_short(short(spark, "T" * 9, "", None), CFG))
    assert set(rows_of(scan.scan_short(short(spark, "TTAGGG" * 20), CFG))) == {("high", "both"), ("low", "both")}


@pytest.mark.parametrize("motif", ["TTAGGG", "CCCTAA", "ATCGAT", "TTTAGGG"])
def test_read_target_counts_strand_canonical_windows(spark, motif):
    read = motif * 15 + "N" + motif * 6
    s, k = encode(read), len(motif)
    windows = [canon(s[i : i + k]) for i in range(len(s) - k + 1) if "x" not in s[i : i + k]]
    want = dict(Counter(min(w, canon(w[::-1].translate(_FLIP))) for w in windows))
    assert rows_of(scan.scan_targets(short(spark, read, "T" * 100, read[:19]), CFG)) == {(level, "both"): want for level in ("high", "low")}


def test_read_target_over_reads_is_part_of_the_scan(spark):
    reads = rd.short_reads(spark, "/root/testdata/sf0.001").where("read_id < 40")
    got = {(r.level, r.k, r.kmer): r.cnt for r in scan.scan_targets(reads, CFG).collect()}
    both = {(r.level, r.k, r.kmer): r.cnt for r in scan.scan_short(reads, CFG).where("direction = 'both'").collect()}
    assert got and all(both[key] >= c for key, c in got.items())


def test_reads_of_the_fixture_give_its_table(spark):
    reads = rd.short_reads(spark, "/root/testdata/sf0.01").where("read_id < 2000")
    folded = strand.strand_fold(scan.scan_short(reads, CFG), CFG)
    assert {r.level: r["count"] for r in folded.groupBy("level").count().collect()} == {"high": 489, "low": 1572}
    top = [tuple(r) for r in strand.report(folded).where("level = 'high' and rank <= 4").orderBy("rank").select("k", "motif", "most", "least", "both").collect()]
    assert top == [(6, "TCGATA", 8431, -1, 23380), (6, "TTAGGG", 8380, 0, 23490), (7, "TTTAGGG", 6770, 0, 26125), (19, "TTGCATCACACCCTCGCCG", 1869, 0, 30156)]


def test_long_reads_of_the_fixture_give_its_table(spark):
    folded = strand.strand_fold(scan.scan_long(rd.long_reads(spark, "/root/testdata/sf0.01").where("read_id < 60"), CFG), CFG)
    top = [tuple(r) for r in strand.report(folded).where("level = 'low'").orderBy("rank").select("k", "most", "least", "both").collect()]
    assert top == [(19, 10141, 0, 8420), (7, 4025, 0, 3380), (6, 2900, 0, 2900)]


def test_no_frequent_motif_gives_the_default_row(spark):
    merged = spark.createDataFrame([("high", 6, "003111", 5, 0, 3)], "level string, k int, kmer string, fwd long, bwd long, both long")
    assert [tuple(r) for r in strand.putative(merged).drop("rank").collect()] == [(-1, "NO_PUTATIVE_TRM", -1, "?")]


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("bad", [{"min_mer": 2}, {"min_mer": 9, "max_mer": 8}, {"low_baseline": 0.9}, {"slice_length": 20}])
def test_config_is_validated(bad):
    with pytest.raises(ValueError):
        ScanConfig(**bad)
