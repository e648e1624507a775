"""The report as one file, committed whole or not at all."""

import pytest
from pyspark.sql import functions as F

from motifspark.config import ScanConfig
from motifspark.jobs import fastq_job
from motifspark.sources import report_sink

from .test_fastq_job import fastq, lines


def test_the_report_is_one_file_equal_to_its_parts(spark, tmp_path):
    for name, seqs in (("a.fastq", ["TTAGGG" * 20] * 3), ("b.fastq", ["TTTAGGG" * 18] * 4 + ["ACGT"])):
        (tmp_path / name).write_text(fastq(seqs))
    files = [str(tmp_path / n) for n in ("a.fastq", "b.fastq")]
    fastq_job.run(spark, "short", files, ScanConfig(), str(tmp_path / "parts"))
    for _ in range(2):  # a second run takes the report's place
        fastq_job.run(spark, "short", files, ScanConfig(), str(tmp_path / "one"), one_file=True)
        want = lines(spark, str(tmp_path / "parts/report")) + lines(spark, str(tmp_path / "parts/answers"))
        assert (tmp_path / "one/report.txt").read_bytes() == "".join(x + "\n" for x in want).encode()
        assert sorted(p.name for p in (tmp_path / "one").iterdir()) == ["motifs", "report.txt"]


def test_lines_of_many_tasks_stay_in_order(spark, tmp_path):
    rows = spark.range(5000, numPartitions=7).withColumn("line", F.format_string("%05d", "id"))
    report_sink.write_lines(rows, ["id"], str(tmp_path / "r.txt"))
    assert (tmp_path / "r.txt").read_text() == "".join(f"{i:05d}\n" for i in range(5000))
    report_sink.write_lines(rows.where("false"), ["id"], str(tmp_path / "e.txt"))
    assert (tmp_path / "e.txt").read_text() == ""


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(100, numPartitions=4).withColumn("line", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("string"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out/old.txt").write_text("old\n")
    report_sink.register(spark)
    for name in ("new.txt", "old.txt"):
        with pytest.raises(Exception, match="broken"):
            bad.select("line").write.format("trm_report").mode("overwrite").save(str(tmp_path / "out" / name))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["old.txt"] and (tmp_path / "out/old.txt").read_text() == "old\n"
    with pytest.raises(Exception, match="exists"):
        spark.range(1).select(F.lit("y").alias("line")).write.format("trm_report").mode("append").save(str(tmp_path / "out/old.txt"))
    with pytest.raises(Exception, match="one column"):
        spark.range(1).write.format("trm_report").mode("overwrite").save(str(tmp_path / "out/x.txt"))
