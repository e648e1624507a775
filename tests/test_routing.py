"""Routing of built pairs and long reads whose counts can be told by hand."""

import random
from collections import Counter

from pyspark.sql import functions as F

from motifspark.config import LEVELS, ScanConfig
from motifspark.operators import scan

from .test_motifs import found

CFG = ScanConfig()


def flip(seq):
    return seq[::-1].translate(str.maketrans("TGCA", "ACGT"))


def noise(n, seed=5):
    rng = random.Random(seed)
    return "".join(rng.choices("TGCA", k=n))


def total(scanned):
    """Counts by level, direction and motif."""
    out: dict = {}
    for r in scanned.collect():
        out.setdefault((r.level, r.direction), {})[r.kmer] = r.cnt
    return out


def pair(spark, a, b):
    return total(scan.scan_paired(spark.createDataFrame([(a, b)], "seq1 string, seq2 string"), CFG))


def long(spark, seq):
    return total(scan.scan_long(spark.createDataFrame([(seq,)], "seq string"), CFG))


def canon(w):
    return min((w + w)[i : i + len(w)] for i in range(len(w)))


def encoded(seq):
    return seq.translate(str.maketrans("TGCA", "0123"))


MOTIF = canon(encoded("TTAGGG"))
STRAND = min(MOTIF, canon(encoded(flip("TTAGGG"))))


def test_a_pair_that_repeats_throughout_counts_for_both_strands(spark):
    read = "TTAGGG" * 25
    # Four halves of 75 bases with 70 windows each.
    assert pair(spark, read, flip(read)) == {(level, "both"): {STRAND: 280} for level in LEVELS}


def test_a_pair_with_one_repeating_mate_counts_forward(spark):
    assert pair(spark, "TTAGGG" * 25, noise(150)) == {(level, "forward"): {MOTIF: 140} for level in LEVELS}


def test_short_pairs_and_noise_give_nothing(spark):
    assert not pair(spark, "TTAG", "TTAGGG" * 25) and not pair(spark, noise(150), noise(150, 6)) and not pair(spark, None, "TTAGGG" * 9)


def test_pairs_of_the_table_equal_plain_routing(spark):
    """Routing by the closed form of the paired rules, over counts of the kernel's own."""
    r = random.Random(11)
    motifs = ["TTAGGG", "CCCTAA", "TTTAGGG", "ACGTACGG"]
    piece = lambda n: (r.choice(motifs) * 40)[:n] if r.random() < 0.75 else noise(n, r.random())
    pairs = [tuple(piece(h) + piece(h) for h in (r.randint(8, 75), r.randint(8, 75))) for _ in range(60)]

    def check(s, lo, hi):
        return found([s], lo, hi, CFG)[0]

    want: dict = {}

    def add(level, direction, counts, fold=False):
        for w, c in counts.items():
            w = min(w, other(w)) if fold else w
            key = want.setdefault((level, direction), Counter())
            key[w] += c

    other = lambda w: canon(w[::-1].translate(str.maketrans("0123", "3210")))
    for a, b in pairs:
        n = min(len(a), len(b))
        if n < 2 * CFG.min_mer:
            continue
        parts = [a[: len(a) // 2], a[len(a) // 2 :], b[len(b) // 2 :], b[: len(b) // 2]]
        got = [check(p, CFG.min_mer, min(n // 4, CFG.max_mer)) if n >= 4 * CFG.min_mer else {v: (0, "", {}) for v in LEVELS} for p in parts]
        m, p = {}, {}
        for v in LEVELS:
            t = [g[v] for g in got]
            like = lambda i, j, t=t: t[i][0] == t[j][0] > 0 and t[i][1] == (t[j][1] if (i < 2) == (j < 2) else other(t[j][1]))
            m[v] = next((i for i in range(4) if not like(0, i)), 4)
            rest = range(3, m[v] - 1, -1)
            p[v] = next((k for k, j in enumerate(rest) if not like(3, j)), len(rest))
        for v in LEVELS:
            t = [g[v] for g in got]
            for i in range(min(4, m[v] + 1)):
                add(v, "both" if m[v] == 4 else "forward" if i < 2 else "backward", t[i][2], m[v] == 4)
            if m[v] < 4:
                for j in range(3 - p[v], 4):
                    add(v, "forward" if j > 1 else "backward", t[j][2])
        if n < 4 * CFG.max_mer:
            lo, hi = max(n // 4 + 1, CFG.min_mer), min(n // 2, CFG.max_mer)
            x, y = check(a, lo, hi), check(b, lo, hi)
            back = any(k < 4 for k in m.values())
            for v in LEVELS:
                use_a = got[0][v][0] == 0
                use_b = (got[3][v][0] if m[v] < 4 else 0 if back else got[0][v][0]) == 0
                both = use_a and use_b and x[v][0] == y[v][0] > 0 and x[v][1] == other(y[v][1])
                for use, z in ((use_a, x), (use_b, y)):
                    if use:
                        add(v, "forward", z[v][2])
                        if both:
                            add(v, "both", z[v][2], True)
    got = total(scan.scan_paired(spark.createDataFrame(pairs, "seq1 string, seq2 string"), CFG))
    assert got == {k: dict(c) for k, c in want.items() if c}


def test_a_long_read_that_repeats_throughout(spark):
    assert long(spark, "TTAGGG" * 100) == {(level, "both"): {STRAND: 4 * 145} for level in LEVELS}


def test_a_long_read_that_repeats_at_either_end(spark):
    start, end = "TTAGGG" * 50 + noise(300), noise(300) + "TTAGGG" * 50
    assert long(spark, start) == {(level, "forward"): {MOTIF: 290} for level in LEVELS}
    assert long(spark, end) == {(level, "backward"): {MOTIF: 290} for level in LEVELS}


def test_runs_of_slices_stop_at_each_other(spark):
    texts = ["TTAGGG" * 100, "TTAGGG" * 50 + noise(300), noise(300) + "TTAGGG" * 50, "TTAGGG" * 25 + noise(150) + "TTAGGG" * 25, noise(150), "T" * 149]
    rows = scan.slice_runs(spark.createDataFrame(list(enumerate(texts)), "id long, seq string"), CFG, ("id",)).where("level = 'high'").orderBy("id").collect()
    assert [(r.id, r.slices, r.leading, r.trailing) for r in rows] == [(0, 4, 4, 0), (1, 4, 2, 0), (2, 4, 0, 2), (3, 3, 1, 1), (4, 1, 0, 0)]


def test_the_middle_slice_takes_what_is_left_over(spark):
    for n, over in ((1, 7), (2, 149), (3, 1), (4, 0)):
        text = noise(150 * n + over)
        parts = spark.createDataFrame([(text,)], "s string").select(scan.slices(F.col("s"), 150)).first()[0]
        assert [len(p) for p in parts] == [150 + over * (i == (n + 1) // 2) for i in range(1, n + 1)]
        assert "".join(parts) == text


def test_case_does_not_matter(spark):
    lower, upper = (total(scan.scan_short(spark.createDataFrame([(s * 20,)], "seq string"), CFG)) for s in ("ttaggg", "TTAGGG"))
    assert lower == upper and lower
