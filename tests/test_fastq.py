"""FASTQ files read by splits, by codec and as packed blocks, against plain reading."""

import gzip
import random

import pytest

from motifspark.sources import fastq


def records(seqs, tail="\n"):
    return "\n".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}" for i, s in enumerate(seqs)) + tail


@pytest.fixture(scope="module")
def seqs():
    rng = random.Random(3)
    return ["".join(rng.choices("TGCAN", k=rng.randint(0, 200))) for _ in range(3000)]


def got(df):
    return sorted((r.read_id, r.seq) for r in df.collect())


@pytest.mark.parametrize("tail", ["\n", ""])
def test_splits_number_lines_as_the_whole_file_does(spark, tmp_path, seqs, tail):
    (tmp_path / "a.fastq").write_text(records(seqs, tail))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        df = fastq.read_fastq(spark, str(tmp_path / "a.fastq"))
        assert got(df) == list(enumerate(seqs))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_packed_files(spark, tmp_path, seqs):
    data = records(seqs).encode()
    (tmp_path / "a.fastq.gz").write_bytes(gzip.compress(data))
    # Many members, as block-packed files have.
    (tmp_path / "b.fastq.bgz").write_bytes(b"".join(gzip.compress(data[i : i + 65536]) for i in range(0, len(data), 65536)))
    for name in ("a.fastq.gz", "b.fastq.bgz"):
        assert got(fastq.read_fastq(spark, str(tmp_path / name))) == list(enumerate(seqs))
    both = fastq.read_fastq(spark, *(str(tmp_path / n) for n in ("a.fastq.gz", "b.fastq.bgz")))
    assert both.groupBy("file").count().count() == 2 and both.count() == 2 * len(seqs)


def test_empty_and_cut_files(spark, tmp_path):
    for name, text, want in (("e", "", []), ("h", "@r0\n", []), ("s", "@r0\nTGCA", [(0, "TGCA")])):
        (tmp_path / name).write_text(text)
        assert got(fastq.read_fastq(spark, str(tmp_path / name))) == want


def test_length_rules(spark, tmp_path):
    (tmp_path / "a").write_text(records(["T" * 1000, "G" * 149, "C" * 150]))
    path = str(tmp_path / "a")
    assert [n for n, _ in got(fastq.long_reads(spark, path))] == [0, 2]
    assert len(got(fastq.short_reads(spark, path))) == 3
    with pytest.raises(Exception, match="too long"):
        fastq.short_reads(spark, path, longest=999).collect()


def test_pairs_meet_by_place_and_unequal_files_fail(spark, tmp_path, seqs):
    (tmp_path / "1").write_text(records(seqs))
    (tmp_path / "2").write_text(records(seqs[::-1]))
    (tmp_path / "3").write_text(records(seqs[1:]))
    one, two, three = (str(tmp_path / n) for n in "123")
    pairs = sorted((r.read_id, r.seq1, r.seq2) for r in fastq.paired_reads(spark, (one, two)).collect())
    assert pairs == [(i, a, b) for i, (a, b) in enumerate(zip(seqs, seqs[::-1], strict=True))]
    for bad in ((one, three), (three, one)):
        with pytest.raises(Exception, match="unequal"):
            fastq.paired_reads(spark, bad).collect()


def test_written_reads_come_back(spark, tmp_path, seqs):
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(3)
    fastq.write_fastq(reads, str(tmp_path / "out"))
    assert sorted(s for _, s in got(fastq.read_fastq(spark, str(tmp_path / "out")))) == sorted(seqs)
