"""FASTQ files as reads: four lines a record, of which the second is the sequence.

Plain and block gzip files are read in splits by many tasks, whatever their size, other
gzip files by one task each. Tasks begin at lines whose number is known (``fastq_index``),
and the sequences are read through ``spark.read.format("fastq")`` (``fastq_source``). Files
with up to one split are read once; larger ones once more before, for the index.

Mates are paired by place: the ranges of the first file are met with the last marked line
of the second one before them, and a task reads both files in step from there. So texts
are never shuffled, and at most one mark's text is read in vain.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as bl
from . import fastq_index as fi
from . import fastq_source as fsrc
from .scratch import scratch_dir, written

LONGEST_SHORT = 1000
__all__ = ["long_reads", "paired_reads", "read_fastq", "scratch_dir", "short_reads", "write_fastq"]


def _source(spark: SparkSession, paths: list[str], split_bytes: int) -> DataFrame:
    fsrc.register(spark)
    _, index = written(fi.ranges(fi.marks(spark, paths, split_bytes)))
    return spark.read.format("fastq").option("index", index).option("splitBytes", split_bytes).load()


def read_fastq(spark: SparkSession, *paths: str, split_bytes: int = fi.SPLIT_BYTES) -> DataFrame:
    """file, read_id (from 0 in each file), seq of all files or folders."""
    return _source(spark, list(paths), split_bytes).select("file", "read_id", "seq")


def _checked(seq: str, longest: int):
    too_long = F.raise_error(F.concat(F.lit("read too long for short reads: "), "file", F.lit(", read "), F.col("read_id").cast("string"))).cast("string")
    return F.when(F.length(seq) > longest, too_long).otherwise(F.col(seq))


def short_reads(spark: SparkSession, *paths: str, longest: int = LONGEST_SHORT, split_bytes: int = fi.SPLIT_BYTES) -> DataFrame:
    """Reads of files of short reads; one beyond ``longest`` fails the job, as it means a file of another kind."""
    return read_fastq(spark, *paths, split_bytes=split_bytes).withColumn("seq", _checked("seq", longest))


def long_reads(spark: SparkSession, *paths: str, slice_length: int = 150, split_bytes: int = fi.SPLIT_BYTES) -> DataFrame:
    """Reads that hold one slice at least; shorter ones are left out by the reader."""
    return _source(spark, list(paths), split_bytes).where(F.col("length") >= slice_length).select("file", "read_id", "seq")


def _in_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of two files to file, read_id, seq1, seq2."""
    for batch in batches:
        for r in batch.to_pylist():
            sides = [fsrc.read_range(r[f"file{i}"], r[f"codec{i}"], r[f"line{i}"], r[f"at{i}"], r[f"within{i}"], r["line1"], r["until"]) for i in (1, 2)]
            held: list = [None, None]
            while True:
                held = [next(side, None) if h is None else h for h, side in zip(held, sides, strict=True)]
                if None in held:
                    if held != [None, None]:
                        left = next(h for h in held if h is not None)
                        raise ValueError(f"files of unequal length: {r['file1']}, {r['file2']}: read {left.number[0]} has no mate")
                    break
                n = min(len(h.number) for h in held)
                yield pa.RecordBatch.from_arrays([pa.array([r["file1"]] * n), pa.array(held[0].number[:n]), *(h.where(slice(0, n)).array() for h in held)], ["file", "read_id", "seq1", "seq2"])
                held = [h.where(slice(n, None)) if n < len(h.number) else None for h in held]


def paired_ranges(spark: SparkSession, pairs: list[tuple[str, str]], split_bytes: int, mark_bytes: int) -> DataFrame:
    """file1, file2 and for both a place to begin at (codec, line, at, within); line1 to until are the lines wanted. A row a split of a first file."""
    bare = lambda path: re.sub("^[a-z0-9]+:(//[^/]*)?/*", "/", path if ":" in path else os.path.abspath(path))  # noqa: E731  without scheme and host
    named = spark.createDataFrame([(i, side, bare(path)) for i, pair in enumerate(pairs) for side, path in enumerate(pair, 1)], "pair long, side int, name string")
    marked = fi.marks(spark, list(dict.fromkeys(p for pair in pairs for p in pair)), split_bytes, mark_bytes)
    rows = marked.withColumn("name", F.regexp_replace("file", "^[a-z0-9]+:(//[^/]*)?/*", "/")).join(F.broadcast(named), "name")  # named: a row for each file that the caller lists
    place = F.struct("file", "codec", "line", "at", "within")
    whole = F.max(F.col("codec") == bl.GZIP).over(Window.partitionBy("pair"))  # a file without places to begin at
    rows = rows.withColumn("whole", whole).where(~F.col("whole") | (F.col("line") == 0))
    before = F.last(F.when(F.col("side") == 2, place), ignorenulls=True).over(Window.partitionBy("pair").orderBy("line", F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = rows.select("pair", "side", "first", "bytes", place.alias("one"), before.alias("two"), "line").where((F.col("side") == 1) & F.col("first"))
    met = met.withColumn("until", F.lead("line").over(Window.partitionBy("pair").orderBy("line")))
    both = [F.col(f"{side}.{c}").alias(f"{c}{i}") for i, side in ((1, "one"), (2, "two")) for c in ("file", "codec", "line", "at", "within")]
    return met.select("pair", F.least("bytes", F.lit(split_bytes)).alias("bytes"), *both, "until")


def paired_reads(spark: SparkSession, *pairs: tuple[str, str], longest: int = LONGEST_SHORT, split_bytes: int = fi.SPLIT_BYTES, mark_bytes: int = fi.MARK_BYTES) -> DataFrame:
    """file (the first of its pair), read_id, seq1, seq2: mates by their place; a read without a mate fails the job."""
    cut, _ = written(paired_ranges(spark, list(pairs), split_bytes, mark_bytes))
    if (n := cut.select("pair").distinct().count()) != len(pairs):
        raise ValueError(f"{len(pairs)} pairs of files are named, and {n} found")
    mates = cut.repartition(fi.task_count(cut, split_bytes=split_bytes), "pair", "line1").mapInArrow(_in_step, "file string, read_id long, seq1 string, seq2 string")
    return mates.select("file", "read_id", *(_checked(c, longest).alias(c) for c in ("seq1", "seq2")))


def write_fastq(reads: DataFrame, path: str, compression: str = "none") -> None:
    """Write read_id and seq as records of the highest quality, one file a task."""
    record = F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id").cast("string")), F.coalesce("seq", F.lit("")), F.lit("+"), F.repeat(F.lit("I"), F.coalesce(F.length("seq"), F.lit(0))))
    reads.select(record.alias("value")).write.option("lineSep", "\n").option("compression", compression).text(path)
