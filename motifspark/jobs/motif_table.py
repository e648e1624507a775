"""A table of motifs by file that grows file by file.

Each file's folded motifs are one partition of a Parquet table. Adding a file writes its
partition and no other, adding it again replaces it, so a repeated or broken-off addition
changes nothing in the end; sums, report and answers read the table alone and no file
is scanned twice. Files may be added by several jobs at once.

A partition also holds a row without a motif, so a file without motifs has one, and with
the settings of its scan: sums over files that were scanned differently are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..operators import strand
from ..sources import fastq_index
from .fastq_job import answer_lines, plain_path, report_lines, scan_fastq

SCHEMA = "file string, settings string, level string, k int, kmer string, fwd long, bwd long, both long, part string"


def settings(kind: str, cfg: ScanConfig) -> str:
    """What the counts of a file depend on; pairs and single reads of one length of motif may be summed."""
    cut = f", slices of {cfg.slice_length}" if kind == "long" else ""
    return f"{'long' if kind == 'long' else 'short'} {cfg.min_mer} to {cfg.max_mer}, {cfg.low_baseline} and {cfg.high_baseline}{cut}"


def add_files(spark: SparkSession, table: str, kind: str, files: list, cfg: ScanConfig, label: Column | None = None) -> None:
    """Scan files (pairs for ``paired``) and put their motifs into the table in place of what it has of them.

    label: what to tell files by instead of their path, of the column file; all files of a label are added together.
    """
    folded = strand.strand_fold(scan_fastq(spark, kind, files, cfg, label), cfg, ("file",))
    names = fastq_index.listed(spark, [f[0] if kind == "paired" else f for f in files])
    names = names.select((F.col("file") if label is None else label).alias("file")).distinct()
    rows = names.unionByName(folded, allowMissingColumns=True).withColumn("file", plain_path(F.col("file")))
    rows = rows.select("file", F.lit(settings(kind, cfg)).alias("settings"), "level", "k", "kmer", "fwd", "bwd", "both", F.md5("file").alias("part"))
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(table)


def _rows(spark: SparkSession, table: str) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(table)
    found = [r["settings"] for r in rows.select("settings").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"files of the table were scanned differently: {found[0]}; {found[1]}")
    return rows


def motifs(spark: SparkSession, table: str) -> DataFrame:
    """file, level, k, kmer, fwd, bwd, both of all files."""
    return _rows(spark, table).where("kmer is not null").select("file", "level", "k", "kmer", "fwd", "bwd", "both")


def merged(spark: SparkSession, table: str) -> DataFrame:
    return strand.merge_files(motifs(spark, table))


def write_report(spark: SparkSession, table: str, out: str) -> None:
    """``out``/report and ``out``/answers (text) of all files of the table."""
    names = _rows(spark, table).where("kmer is null").select("file")
    report_lines(motifs(spark, table), names).orderBy("file", "part", "rank").select("line").write.mode("overwrite").text(f"{out}/report")
    answer_lines(merged(spark, table)).orderBy("rank").select("line").coalesce(1).write.mode("overwrite").text(f"{out}/answers")
