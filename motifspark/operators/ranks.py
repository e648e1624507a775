"""Row numbers in groups of any size, without a group in one task.

Rows are dealt by ranges of (group, order), so a large group lies in several parts, one
after the other. A row's number is its number in its part plus the rows of its group in
the parts before, which a narrow table of counts by part and group gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def with_rank(rows: DataFrame, by: tuple[str, ...], order: list[Column | str], name: str = "rank") -> DataFrame:
    """rows and ``name``, from 1 in each group of ``by``. order must tell all rows of a group apart.

    The parts are written once: ranges are found by sampling, and a second sampling might cut elsewhere.
    """
    of_part = rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    parts, _ = written(of_part)
    counts = parts.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    local = parts.withColumn("__k", F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)))
    same = [local[c].eqNullSafe(offsets[f"__{c}"]) for c in by]
    joined = local.join(offsets, [local["__part"] == offsets["__p"], *same])
    return joined.withColumn(name, F.col("__k") + F.col("__before")).select(*rows.columns, name)
