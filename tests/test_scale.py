"""Work that grew faster than the reads, or was done again for equal ones."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifspark.config import ScanConfig
from motifspark.functions import alphabet as al
from motifspark.jobs import registry
from motifspark.operators import kernel, scan
from motifspark.sources import reads as rd

from .test_motifs import _FLIP, canon, encode, plain_check

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("reads", "sql", "salts"), [(rd.short_reads, rd.SHORT_SQL, 5), (rd.long_reads, rd.LONG_SQL, 10)])
def test_reads_are_those_of_their_sql_and_hash_once(spark, reads, sql, salts):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id").unionByName(spark.createDataFrame([(-1,), (-5,), (None,), (10**15 + 4,)], "event_id long"))
    got, want = reads(spark, SF), spark.sql(sql.replace("from events)", "from {events})"), events=events)
    assert got.schema == want.schema and got.count() == 1000
    assert not got.exceptAll(want).count() and want.exceptAll(got).count() == 4
    assert plan(reads(spark, SF).where("length(seq) >= 150")).count("md5(") == salts


def test_digests_equal_plain_windows(spark):
    r = random.Random(7)
    texts = ["".join(r.choices("TGCANtg3", weights=[9, 9, 9, 9, 1, 1, 1, 1], k=r.randrange(0, 120))) for _ in range(60)] + ["TTAGGG" * 20] * 50 + ["", None, "N" * 40, "TTAGG", "NTTAGGN"]
    out = kernel.digests(spark.createDataFrame(list(enumerate(texts)), "id long, seq string"), "seq", ScanConfig(3, 40))
    want = {}
    for i, t in enumerate(texts):
        s = encode(t or "")
        for k in range(3, 41):
            windows = [s[j : j + k] for j in range(len(s) - k + 1) if "x" not in s[j : j + k]]
            if windows:
                want[i, k] = (len(windows), hashlib.md5(",".join(windows).encode()).hexdigest())
    rows = out.collect()
    assert len(rows) == len(want) and {(x.id, x.k): (x.windows, x.digest) for x in rows} == want


def test_valid_windows_are_counted_without_making_them(spark):
    query = registry.QUERIES["valid_windows"](spark, SF)
    assert "Generate" not in plan(query) and "substr(run" not in plan(query)
    totals = registry.QUERIES["window_totals"](spark, SF).groupBy("read_id").agg(F.sum("total").alias("windows")).where("windows > 0")
    assert not query.exceptAll(totals).count() and not totals.exceptAll(query).count()


def test_palindromes_equal_their_definition(spark):
    r = random.Random(3)
    halves = ["".join(r.choices("0123", k=r.randrange(1, 9))) for _ in range(80)]
    motifs = sorted({canon(m) for h in halves for m in (h + h[::-1].translate(_FLIP), h + "0", h + h, h)})
    rows = spark.createDataFrame([(m,) for m in motifs], "m string").select("m", al.is_palindrome(F.col("m"))).collect()
    want = {m: canon(m[::-1].translate(_FLIP)) == m for m in motifs}
    assert {m: p for m, p in rows} == want and {True, False} == set(want.values())


def test_palindromes_are_told_of_distinct_motifs_alone(spark):
    tree = registry.QUERIES["palindromes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" in tree and "array_min" not in tree[tree.rindex("Aggregate [") :].split("\n", 1)[1]


def test_only_texts_without_a_result_are_left_out():
    r, cfg = random.Random(8), ScanConfig()
    noise = lambda n: "".join(r.choices("TGCA", k=n))
    motif = lambda: noise(r.randint(2, 40))
    texts = [(motif() * 40)[: r.randint(0, 90)] + r.choice(["", "N", "tag"]) + noise(r.randint(0, 60)) for _ in range(120)] + [noise(150) for _ in range(100)]
    lo, hi = np.array([r.randint(3, 26) for _ in texts]), np.array([r.randint(2, 32) for _ in texts])
    lo[-100:], hi[-100:] = 5, 32
    kept = kernel.may_repeat([t.encode() for t in texts], lo, hi, cfg)
    results = [any(k for k, *_ in plain_check(encode(t), a, b, cfg).values()) for t, a, b in zip(texts[:120], lo.tolist(), hi.tolist(), strict=False)]
    assert all(kept[i] for i, x in enumerate(results) if x) and 15 < sum(results) < sum(kept) and not kept[-100:].any()


def test_equal_segments_are_counted_once():
    texts = ["TTAGGG" * 25, "", None, "N" * 150] * 50 + ["TTAGGG" * 24 + "CCCTAA"] * 3
    seg = pa.array(texts).fill_null("")
    lo, hi = np.full(len(texts), 5), np.array([32, 32, 32, 32] * 50 + [32, 32, 0])
    out, at = kernel._found_once(seg, lo, hi, ScanConfig())
    assert len(out["high"]) == 3  # two texts, and what has no result
    assert [out["high"][i]["k"].as_py() for i in at[[0, 1, 2, 3, 4, 200, 201, 202]]] == [6, 0, 0, 0, 6, 6, 6, 0]


def test_slices_of_the_kernel_are_those_of_the_column(spark):
    r = random.Random(5)
    texts = ["".join(r.choices("TGCAéN", k=r.randrange(150, 1400))) for _ in range(40)] + ["T" * 150, "TTAGGG" * 100]
    bound, parts = kernel._slices(pa.array(texts), 150)
    want = [x.s for x in spark.createDataFrame([(t,) for t in texts], "t string").select(scan.slices(F.col("t"), 150).alias("s")).collect()]
    assert parts.to_pylist() == sum(want, []) and np.diff(bound).tolist() == [len(w) for w in want]


@pytest.mark.parametrize("query", ["segment_check", "prefix_run", "suffix_run"])
def test_slices_are_cut_in_the_kernel_and_told_without_counts(spark, query):
    tree = plan(registry.QUERIES[query](spark, SF))
    assert "cnt" not in tree and "transform(sequence" not in tree and "substr" not in tree.split("MapInArrow")[0]
    tree = plan(scan.scan_long(rd.long_reads(spark, SF), ScanConfig()))
    assert "__segments" not in tree


@pytest.mark.parametrize("query", ["vote_scores", "direction_call", "putative_trm"])
def test_a_scan_runs_once_whatever_reads_its_motifs(spark, query):
    assert "MapInArrow" not in plan(registry.QUERIES[query](spark, SF))


def test_other_strands_are_made_once_in_the_kernel(spark):
    r = random.Random(6)
    motifs = [canon("".join(r.choices("0123", k=r.randint(1, 64)))) for _ in range(300)] + ["0", "3", "0" * 64, "01" * 16]
    assert kernel._flips(motifs).to_pylist() == [canon(m[::-1].translate(_FLIP)) for m in motifs]
    tree = plan(registry.QUERIES["strand_fold"](spark, SF))
    assert tree[tree.index("MapInArrow") :].count("array_min") == 0
