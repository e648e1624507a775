"""The job over files of all kinds, to its written report."""

import gzip
import os
import pathlib
import random

import pytest

from motifspark.config import ScanConfig
from motifspark.jobs import fastq_job

SAMPLES = os.environ.get("FASTQ_SAMPLES", "")  # a folder of FASTQ samples


def lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def fastq(seqs):
    return "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs))


def test_report_of_short_files(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(fastq(["TTAGGG" * 20] * 3 + ["ACGT"]))
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(fastq(["CCCTAA" * 20]).encode()))
    (tmp_path / "c.fastq.bgz").write_bytes(gzip.compress(fastq(["ACGT"]).encode()))
    files = [str(tmp_path / n) for n in ("a.fastq", "b.fastq.gz", "c.fastq.bgz")]
    fastq_job.run(spark, "short", files, ScanConfig(), str(tmp_path / "out"))
    a, b, c = (os.path.realpath(f) for f in files)
    assert lines(spark, str(tmp_path / "out/report")) == [f">H:{a}", "6,TTAGGG,0,0,345,?", f">L:{a}", "6,TTAGGG,0,0,345,?", f">H:{b}", "6,TTAGGG,0,0,115,?", f">L:{b}", "6,TTAGGG,0,0,115,?", f">H:{c}", f">L:{c}"]
    assert lines(spark, str(tmp_path / "out/answers")) == [">Putative_TRM", "6,TTAGGG,3,?"]


def test_report_of_pairs_and_of_a_folder(spark, tmp_path):
    flip = str.maketrans("TGCA", "ACGT")
    read = "TTAGGG" * 25
    (tmp_path / "1.fq").write_text(fastq([read]))
    (tmp_path / "2.fq").write_text(fastq([read[::-1].translate(flip)]))
    one, two = str(tmp_path / "1.fq"), str(tmp_path / "2.fq")
    fastq_job.run(spark, "paired", [(one, two)], ScanConfig(), str(tmp_path / "out"))
    assert lines(spark, str(tmp_path / "out/report"))[:2] == [f">H:{os.path.realpath(one)}", "6,TTAGGG,0,0,280,?"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.bgz").write_bytes(gzip.compress(fastq(["TTAGGG" * 20]).encode()))
    (tmp_path / "in/y.fastq").write_text(fastq(["TTAGGG" * 20]))
    rows = fastq_job.scan_fastq(spark, "short", [str(tmp_path / "in")], ScanConfig()).where("level = 'high'").collect()
    assert sorted((os.path.basename(r.file), r.cnt) for r in rows) == [("x.bgz", 115), ("y.fastq", 115)]


@pytest.mark.parametrize("kind", ["short", "long"])
@pytest.mark.parametrize("top", [32, 64])
@pytest.mark.skipif(not SAMPLES, reason="FASTQ_SAMPLES names no folder")
def test_samples_hold_no_motif(spark, tmp_path, kind, top):
    """Files named *long* are long reads; none of the samples repeats."""
    files = sorted(str(p) for p in pathlib.Path(SAMPLES).glob("*.fastq") if ("long" in p.name) == (kind == "long"))
    for f in list(files):
        packed = tmp_path / (os.path.basename(f) + ".gz")
        packed.write_bytes(gzip.compress(pathlib.Path(f).read_bytes()))
        files.append(str(packed))
    fastq_job.run(spark, kind, files, ScanConfig(5, top), str(tmp_path / "out"))
    assert files and lines(spark, str(tmp_path / "out/answers")) == [">Putative_TRM", "NO_PUTATIVE_TRM,-1"]
    assert all(x.startswith(">") for x in lines(spark, str(tmp_path / "out/report")))


@pytest.mark.parametrize(("kind", "reads", "size"), [("short", 100, 150), ("long", 10, 1500)])
@pytest.mark.parametrize("top", [32, 64])
def test_reads_without_repeats_hold_no_motif(spark, tmp_path, kind, reads, size, top):
    """Files of the shape of small samples: plain and packed, of reads without motifs."""
    r = random.Random(size)
    text = fastq(["".join(r.choices("ACGT", k=size)) for _ in range(reads)]).encode()
    (tmp_path / "a.fastq").write_bytes(text)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(text))
    files = [str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq.gz")]
    fastq_job.run(spark, kind, files, ScanConfig(5, top), str(tmp_path / "out"))
    assert lines(spark, str(tmp_path / "out/answers")) == [">Putative_TRM", "NO_PUTATIVE_TRM,-1"]
    assert lines(spark, str(tmp_path / "out/report")) == [f">{level}:{os.path.realpath(f)}" for f in files for level in "HL"]


@pytest.mark.parametrize("argv", [["short", "5", "32", "--out", "x"], ["long", "5", "32", "--fq1", "a", "--fq2", "b", "--out", "x"], ["short", "5", "32", "--fq1", "a", "--out", "x"], ["short", "2", "32", "a", "--out", "x"]])
def test_wrong_arguments(argv):
    with pytest.raises(SystemExit):
        fastq_job.parsed(argv)


def test_arguments():
    kind, files, cfg, out = fastq_job.parsed(["short", "5", "64", "--fq1", "a", "c", "--fq2", "b", "d", "-L", "0.4", "--out", "o"])
    assert (kind, files, cfg.max_mer, cfg.low_baseline, out) == ("paired", [("a", "b"), ("c", "d")], 64, 0.4, "o")
