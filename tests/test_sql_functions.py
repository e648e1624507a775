"""Session SQL functions against the Column functions, in SQL alone."""

import random

import pytest
from pyspark.sql import functions as F

from motifspark.functions import alphabet as al
from motifspark.functions import sql_functions
from motifspark.operators import scan


@pytest.fixture(scope="module")
def tables(spark):
    sql_functions.register(spark)
    r = random.Random(4)
    motifs = ["".join(r.choices("0123", k=r.randrange(1, 20))) for _ in range(200)] + ["0123", "0303", "000", "2", "012012"]
    reads = ["".join(r.choices("TGCANtg7", k=r.randrange(0, 700))) for _ in range(60)] + ["", "T" * 150, "T" * 149, None]
    spark.createDataFrame([(m,) for m in motifs], "m string").createOrReplaceTempView("some_motifs")
    spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string").createOrReplaceTempView("some_reads")
    return spark


def test_scalars_equal_columns(tables):
    got = tables.sql("select m, trm_decode(m), trm_reverse_complement(m), trm_canonical(m), trm_strand_canonical(trm_canonical(m)), trm_is_palindrome(trm_canonical(m)), trm_distinct_bases(m), trm_is_homopolymer(m), trm_has_short_period(m, 5), trm_has_short_period(m, 3) from some_motifs")
    m, c = F.col("m"), al.canonical(F.col("m"))
    want = tables.table("some_motifs").select(m, al.decode(m), al.reverse_complement(m), c, al.strand_canonical(c), al.is_palindrome(c), al.distinct_bases(m), al.is_homopolymer(m), al.has_short_period(m, 5), al.has_short_period(m, 3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert tables.sql("select trm_encode('TGCAtgcaN03'), trm_sign(2, 1), trm_sign(1, 2), trm_sign(1, 1)").first() == ("01230123Nxx", "+", "-", "?")


def test_tables_in_sql_alone(tables):
    reads = tables.table("some_reads")
    halves = tables.sql("select r.read_id, h.side, h.seg from some_reads r, lateral trm_halves(r.seq) h where r.seq is not null")
    left, right = scan.halves(F.col("seq"))
    want = reads.where("seq is not null").select("read_id", F.inline(F.array(F.struct(F.lit("L").alias("side"), left.alias("seg")), F.struct(F.lit("R").alias("side"), right.alias("seg")))))
    assert sorted(map(tuple, halves.collect())) == sorted(map(tuple, want.collect()))
    slices = tables.sql("select r.read_id, s.slice, s.seg from some_reads r, lateral trm_slices(r.seq, 150) s")
    want = reads.where("seq is not null").select("read_id", F.posexplode(scan.slices(F.col("seq"), 150)).alias("slice", "seg")).selectExpr("read_id", "slice + 1", "seg")
    assert sorted(map(tuple, slices.collect())) == sorted(map(tuple, want.collect()))
    got = {(r.read_id, r.pos): r.kmer for r in tables.sql("select r.read_id, w.pos, w.kmer from some_reads r, lateral trm_windows(r.seq, 6) w").collect()}
    digits = str.maketrans("TGCAtg", "012301")
    want = {(r.read_id, i + 1): r.seq[i : i + 6].translate(digits) for r in reads.collect() if r.seq for i in range(len(r.seq) - 5) if not set(r.seq[i : i + 6]) - set("TGCAtg")}
    assert got == want


@pytest.mark.parametrize("call", ["trm_halves(r.seq)", "trm_slices(r.seq, 150)", "trm_windows(r.seq, 6)"])
def test_a_lateral_table_function_joins_and_shuffles_nothing(tables, call):
    plan = tables.sql(f"select r.read_id, t.* from some_reads r, lateral {call} t")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "Exchange" not in plan


def test_commonest_motif_in_sql_alone(tables):
    tables.createDataFrame([(1, "TTAGGG" * 6), (2, "CCCTAA" * 4)], "read_id long, seq string").createOrReplaceTempView("two_reads")
    top = tables.sql("select motif, count(*) as n from (select trm_strand_canonical(trm_canonical(w.kmer)) as motif from two_reads r, lateral trm_windows(r.seq, 6) w) group by motif").collect()
    assert [tuple(r) for r in top] == [("001311", 31 + 19)] or {r.n for r in top} == {50}
