"""The job over FASTQ files: one scan of all files, by file, and its report and answers as text.

    python -m motifspark.jobs.fastq_job short 5 32 a.fastq b.fastq.gz --out report
    python -m motifspark.jobs.fastq_job short 5 32 --fq1 a_1.fastq --fq2 a_2.fastq --out report
    python -m motifspark.jobs.fastq_job long 5 32 long.fastq --out report

The report holds a block for each file and level (``>H:`` or ``>L:`` and the file's full
path, then ``k,motif,larger,smaller,both,strand`` rows), and after all files the block
``>Putative_TRM`` of answers over the sums of all files.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..operators import scan, strand
from ..sources import fastq, report_sink

KINDS = ("short", "paired", "long")


def scan_fastq(spark: SparkSession, kind: str, files: list, cfg: ScanConfig, label: Column | None = None) -> DataFrame:
    """file, level, direction, k, kmer, cnt. files: paths, or pairs of paths for ``paired``; label: what to count by instead of the file's path."""
    if kind == "paired":
        reads = fastq.paired_reads(spark, *files)
    elif kind == "short":
        reads = fastq.short_reads(spark, *files)
    else:
        reads = fastq.long_reads(spark, *files, slice_length=cfg.slice_length)
    if label is not None:
        reads = reads.withColumn("file", label)
    scans = {"short": scan.scan_short, "paired": scan.scan_paired, "long": scan.scan_long}
    return scans[kind](reads, cfg, by=("file",))


def report_lines(folded: DataFrame, files: DataFrame) -> DataFrame:
    """file, part, rank, line: the blocks of the report. files: the column file, so that one without motifs has its blocks too."""
    level = F.when(F.col("level") == "high", 0).otherwise(1)
    rows = strand.report(folded, ("file",)).select("file", level.alias("part"), "rank", F.concat_ws(",", "k", "motif", "most", "least", "both", "sign").alias("line"))
    heads = files.distinct().select("file", F.inline(F.array(*(F.struct(F.lit(i).alias("part"), F.lit(0).cast("long").alias("rank"), F.concat(F.lit(mark), "file").alias("line")) for i, mark in enumerate((">H:", ">L:"))))))
    return heads.unionByName(rows)


def answer_lines(merged: DataFrame) -> DataFrame:
    """rank, line: the block of answers."""
    answers = strand.putative(merged)
    none = F.col("k") < 0
    line = F.when(none, F.concat_ws(",", "motif", "k")).otherwise(F.concat_ws(",", "k", "motif", "score", "sign"))
    head = merged.sparkSession.range(1).select(F.lit(0).alias("rank"), F.lit(">Putative_TRM").alias("line"))
    return head.unionByName(answers.withColumn("line", line).select("rank", "line"))


def run(spark: SparkSession, kind: str, files: list, cfg: ScanConfig, out: str, one_file: bool = False) -> None:
    """Scan the files once, then write ``out``/motifs (Parquet), ``out``/report and ``out``/answers (text).

    one_file: ``out``/report.txt instead of the last two, the report and then the answers.
    """
    scanned = scan_fastq(spark, kind, files, cfg)
    strand.strand_fold(scanned, cfg, ("file",)).write.mode("overwrite").parquet(f"{out}/motifs")
    folded = spark.read.parquet(f"{out}/motifs")
    paths = [p[0] if kind == "paired" else p for p in files]
    # Names only: no file is opened for this.
    names = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"))
    lines = report_lines(folded.withColumn("file", plain_path(F.col("file"))), names.select(plain_path(F.col("file")).alias("file")))
    answers = answer_lines(strand.merge_files(folded))
    if one_file:
        both = lines.select(F.lit(0).alias("block"), "*").unionByName(answers.select(F.lit(1).alias("block"), F.lit("").alias("file"), F.lit(0).alias("part"), F.col("rank").cast("long").alias("rank"), "line"))
        report_sink.write_lines(both, ["block", "file", "part", "rank"], f"{out}/report.txt")
        return
    lines.orderBy("file", "part", "rank").select("line").write.mode("overwrite").text(f"{out}/report")
    answers.orderBy("rank").select("line").coalesce(1).write.mode("overwrite").text(f"{out}/answers")


def plain_path(path: Column) -> Column:
    """A local file's full path without its scheme; other stores keep theirs."""
    return F.regexp_replace(path, "^file:/+", "/")


def parsed(argv: list[str] | None = None) -> tuple[str, list, ScanConfig, str]:
    return _parsed(argv)[:4]


def _parsed(argv: list[str] | None = None) -> tuple[str, list, ScanConfig, str, bool]:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("kind", choices=("short", "long"))
    p.add_argument("min_mer", type=int)
    p.add_argument("max_mer", type=int)
    p.add_argument("files", nargs="*")
    p.add_argument("--fq1", nargs="+", default=[])
    p.add_argument("--fq2", nargs="+", default=[])
    p.add_argument("-L", "--low_baseline", type=float, default=ScanConfig.low_baseline)
    p.add_argument("-H", "--high_baseline", type=float, default=ScanConfig.high_baseline)
    p.add_argument("-s", "--slice_length", type=int, default=ScanConfig.slice_length)
    p.add_argument("--out", required=True)
    p.add_argument("--one_file", action="store_true", help="report and answers as one text file")
    a = p.parse_args(argv)
    if len(a.fq1) != len(a.fq2):
        p.error("--fq1 and --fq2 must name as many files")
    if a.fq1 and (a.kind == "long" or a.files):
        p.error("pairs are short reads, and go without other files")
    if not a.fq1 and not a.files:
        p.error("no files")
    try:
        cfg = ScanConfig(a.min_mer, a.max_mer, a.low_baseline, a.high_baseline, a.slice_length)
    except ValueError as e:
        p.error(str(e))
    return ("paired", list(zip(a.fq1, a.fq2, strict=True)), cfg, a.out, a.one_file) if a.fq1 else (a.kind, a.files, cfg, a.out, a.one_file)


def main() -> None:
    run(SparkSession.builder.appName("motif scan").getOrCreate(), *_parsed())


if __name__ == "__main__":
    main()
