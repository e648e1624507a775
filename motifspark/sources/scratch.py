"""Tables written to the cluster's shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="spark-")
    return path.rstrip("/")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as written once and read back, and its folder. A lost executor costs a re-read, and later plans see the same rows."""
    path = f"{scratch_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
