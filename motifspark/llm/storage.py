"""Written intermediate tables in the cluster's shared folder.

A DataFrame that several later plans read is written once as Parquet under
``spark.checkpoint.dir``. The files outlive any executor, so a lost one costs a
re-read and no recomputation. Only where the setting is absent (tests, a
notebook) is a temporary folder used.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and return it as read back. The shuffle files of the write go with its end, and don't wait for the driver's garbage collection."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for the jobs that run inside, the session's own afterwards."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager[None]:
    """Arrow batches of so many rows for the jobs that run inside."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
