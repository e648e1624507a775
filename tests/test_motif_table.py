"""Ranks over several parts, the motif table file by file, and the stream into it."""

import random

import pytest
from pyspark.sql import functions as F

from motifspark.config import ScanConfig
from motifspark.jobs import fastq_job, motif_table
from motifspark.operators.ranks import with_rank
from motifspark.streaming import motif_stream

from .test_fastq_job import fastq, lines

CFG = ScanConfig()


def text(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_go_on_over_parts(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, id int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_rank(df, ("g",), [F.desc("x"), "id"])
        assert got.columns == ["g", "x", "id", "rank"]
        rank = {r.id: r.rank for r in got.collect()}
        spread = with_rank(df, ("g",), [F.desc("x"), "id"], "n").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread == 3000
    for g in ("a", "b", None):
        mine = sorted((-x, i) for h, x, i in rows if h == g)
        assert [rank[i] for _, i in mine] == list(range(1, len(mine) + 1))
    assert with_rank(df.limit(0), ("g",), ["id"]).collect() == []


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, seqs in (("a.fastq", ["TTAGGG" * 20] * 3), ("b.fastq", ["CCCTAA" * 20, "ACGT"]), ("c.fastq", ["ACGT"]), ("d e%20+f.fastq", ["TTTAGGG" * 18] * 4)):
        (tmp_path / "in" / name).write_text(fastq(seqs))
    return tmp_path


def names(folder):
    return sorted(str(p) for p in (folder / "in").iterdir())


def test_file_by_file_equals_one_run(spark, folder):
    files, table = names(folder), str(folder / "table")
    fastq_job.run(spark, "short", files, CFG, str(folder / "out"))
    for f in files:
        motif_table.add_files(spark, table, "short", [f], CFG)
    whole = spark.read.parquet(str(folder / "out/motifs"))
    assert text(motif_table.motifs(spark, table).drop("file")) == text(whole.drop("file")) and whole.count() > 2
    sums = text(motif_table.merged(spark, table))
    motif_table.write_report(spark, table, str(folder / "again"))
    for part in ("report", "answers"):
        assert lines(spark, str(folder / "again" / part)) == lines(spark, str(folder / "out" / part))
    assert f">H:{files[-1]}" in lines(spark, str(folder / "again/report"))
    motif_table.add_files(spark, table, "short", files[1:3], CFG)
    assert text(motif_table.merged(spark, table)) == sums


def test_a_changed_file_takes_the_place_of_its_old_motifs(spark, folder):
    files, table = names(folder), str(folder / "table")
    motif_table.add_files(spark, table, "short", files, CFG)
    (folder / "in/a.fastq").write_text(fastq(["ACGT"]))
    motif_table.add_files(spark, table, "short", [files[0]], CFG)
    assert {r.file for r in motif_table.motifs(spark, table).collect()} == {files[1], files[3]}
    with pytest.raises(ValueError, match="differently"):
        motif_table.add_files(spark, table, "short", [files[1]], ScanConfig(5, 12))
        motif_table.merged(spark, table)


def test_pairs_go_into_the_table(spark, folder):
    table = str(folder / "table")
    motif_table.add_files(spark, table, "paired", [(names(folder)[0], names(folder)[0])], CFG)
    motif_table.add_files(spark, table, "short", [names(folder)[1]], CFG)
    assert {r.file for r in motif_table.motifs(spark, table).collect()} == set(names(folder)[:2])


def test_a_stream_broken_in_its_middle_ends_as_one_run(spark, folder):
    table, checkpoint = str(folder / "table"), str(folder / "checkpoint")
    start = lambda **more: motif_stream.watch(spark, str(folder / "in"), table, checkpoint, "short", CFG, files_per_batch=2, **more)

    def fail(number):
        if number == 1:
            raise RuntimeError("lost after its files were written")

    query = start(then=fail)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination(120)
        raise query.exception() or AssertionError("it didn't fail")
    seen = []
    start(then=seen.append).awaitTermination(120)
    assert seen == [1]
    (folder / "in/z.fastq").write_text(fastq(["TTAGGG" * 20]))
    start(then=seen.append).awaitTermination(120)
    assert seen == [1, 2]
    fastq_job.run(spark, "short", names(folder), CFG, str(folder / "out"))
    assert text(motif_table.motifs(spark, table).drop("file")) == text(spark.read.parquet(str(folder / "out/motifs")).drop("file"))
    with pytest.raises(ValueError):
        motif_stream.watch(spark, str(folder / "in"), table, checkpoint, "paired", CFG)
