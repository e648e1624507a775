"""FASTQ files that arrive in a folder, scanned once each into a motif table.

A file stream finds new files; its checkpoint remembers which were taken. Each batch adds
its files to the table by overwriting their partitions, so a batch that runs again after
a failure leaves the table as one run would. Single-end and long reads; mates may arrive
apart, so pairs are added by ``motif_table.add_files``. A file must be whole when it appears
under its name (moved into the folder), and names that begin with a dot or underline are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import ScanConfig
from ..jobs import motif_table

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, kind: str, cfg: ScanConfig, files_per_batch: int = 64, then: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """Start the stream. then: called with the batch number once its files are in the table; trigger: as of ``DataStreamWriter.trigger`` (all that is there, once, by default)."""
    if kind not in ("short", "long"):
        raise ValueError("a stream takes short or long reads")

    def add(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # names of files_per_batch files; contents aren't read here
        if paths:
            motif_table.add_files(batch.sparkSession, table, kind, paths, cfg)
        if then:
            then(number)

    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
