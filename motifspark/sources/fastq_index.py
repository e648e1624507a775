"""Where the lines of FASTQ files stand, so that tasks can begin in the middle of a file.

A record can't be told from the text around it (a quality line may begin like a header),
so the number of a line must be known. One pass over the splits of large files counts
line ends, and marks the place of a line start about every ``mark_bytes`` of text; running
sums over the splits of a file, a narrow table, turn counts into line numbers. Files of
one split, and gzip files that aren't in blocks, need no pass: they are read whole by one task.

All tables here hold a row a split or mark, never text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as bl
from .scratch import written

SPLIT_BYTES, MARK_BYTES = 64 << 20, 1 << 20
_MARK = "struct<nth:bigint,at:bigint,within:bigint>"
MARKS = "file string, codec string, bytes long, line long, at long, within long, first boolean"
RANGES = "file string, codec string, bytes long, line long, at long, within long, until long"


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, bytes of all files and of the files in folders; none is opened."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def _splits(split_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, size in zip(batch.column("file").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                with bl.open_file(path) as file:
                    codec = bl.codec_of(file, path)
                step = max(size, 1) if codec == bl.GZIP else split_bytes
                rows += [(path, codec, size, a, min(a + step, size)) for a in range(0, max(size, 1), step)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), *[pa.int64()] * 3)], ["file", "codec", "bytes", "start", "end"])

    return run


def _marked(mark_bytes: int):
    """Splits to the number of line ends in them, and marks: a line start, and how many line ends of the split come before it."""

    def of(path: str, codec: str, start: int, end: int) -> tuple[int, list[tuple[int, int, int]]]:
        lines, seen, due, marks = 0, 0, 0, []
        with bl.open_file(path) as file:
            for at, text in bl.split_texts(file, codec, start, end):
                ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
                k = int(np.searchsorted(ends, due - seen))
                while k < len(ends):
                    after = int(ends[k]) + 1
                    marks.append((lines + k + 1, at + after, 0) if codec == bl.PLAIN else (lines + k + 1, at, after))
                    due = seen + after + mark_bytes
                    k = int(np.searchsorted(ends, due - seen))
                lines, seen = lines + len(ends), seen + len(text)
        return lines, marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines, marks = of(row["file"], row["codec"], row["start"], row["end"])
                nth, at, within = zip(*marks, strict=True) if marks else ((), (), ())
                struct = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (nth, at, within)], ["nth", "at", "within"])
                yield pa.RecordBatch.from_arrays([pa.array([row[c]]) for c in ("file", "codec", "bytes", "start")] + [pa.array([lines]), pa.ListArray.from_arrays(pa.array([0, len(marks)], pa.int32()), struct)], ["file", "codec", "bytes", "start", "lines", "marks"])

    return run


def marks(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES, mark_bytes: int = MARK_BYTES) -> DataFrame:
    """MARKS: line starts of every file in order of line, its beginning included. first: the first of its split, a place for a task to begin."""
    splits, _ = written(listed(spark, paths).mapInArrow(_splits(split_bytes), "file string, codec string, bytes long, start long, end long"))
    heads = splits.where("start = 0").selectExpr("file", "codec", "bytes", "0L as line", "0L as at", "0L as within", "true as first")
    large = splits.where(F.col("bytes") > split_bytes).where(F.col("codec") != bl.GZIP)
    n = large.count()
    if not n:
        return heads
    counted, _ = written(large.repartition(min(n, 100_000), "file", "start").mapInArrow(_marked(mark_bytes), f"file string, codec string, bytes long, start long, lines long, marks array<{_MARK}>"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("before", F.coalesce(before, F.lit(0)))
    each = placed.select("file", "codec", "bytes", "before", F.posexplode("marks").alias("k", "m"))
    return heads.unionByName(each.select("file", "codec", "bytes", (F.col("before") + F.col("m.nth")).alias("line"), "m.at", "m.within", (F.col("k") == 0).alias("first")))


def ranges(marked: DataFrame) -> DataFrame:
    """RANGES: each file cut at its first marks. until: the line before which the next one begins, null for the last; bytes: about what is read."""
    of = Window.partitionBy("file").orderBy("line")
    cut = marked.where("first").withColumn("until", F.lead("line").over(of)).withColumn("n", F.count("*").over(Window.partitionBy("file")))
    return cut.select("file", "codec", F.ceil(F.col("bytes") / F.col("n")).alias("bytes"), "line", "at", "within", "until")


def task_count(cut: DataFrame, column: str = "bytes", split_bytes: int = SPLIT_BYTES) -> int:
    total, n = cut.agg(F.sum(column), F.count("*")).first()
    return max(1, min(n, 100_000, max(cut.sparkSession.sparkContext.defaultParallelism, math.ceil((total or 0) / split_bytes))))
