"""Reads derived from the ``events`` table: short, paired and long.

The tables hold no sequences, so each event yields one read from its id: a repeated
motif at either end, throughout, broken, or none, beside hashed noise. The text is
valid in Spark and in other SQL engines. In Spark the noise's hex digits become bases
in an Arrow kernel, as a column: there ``translate`` costs more than all the rest, and
as an expression it would be put wherever the read is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_HEX, _BASES = "0123456789abcdef", "TGCATGCATGCATGCA"
_SALTS = ("abcde", "fghij")


def _hashed(salts: str) -> str:
    return "concat(" + ", ".join(f"md5(concat('{s}', cast(event_id as varchar(20))))" for s in salts) + ")"


def _noise(salts: str) -> str:
    return f"translate({_hashed(salts)}, '{_HEX}', '{_BASES}')"


SHORT_SQL = f"""
select read_id, substr(case cls
    when 0 then repeat(motif, 30)
    when 1 then concat(repeat(motif, 15), noise)
    when 2 then concat(substr(noise, 1, 75), repeat(reverse(translate(motif, 'TGCA', 'ACGT')), 15))
    when 3 then concat(substr(repeat(motif, 30), 1, 60), 'N', substr(repeat(motif, 30), 1, 89))
    else noise end, 1, cast(100 + read_id % 51 as int)) as seq
from (select event_id as read_id, event_id % 5 as cls,
    case event_id % 4 when 0 then 'TTAGGG' when 1 then 'TTTAGGG' when 2 then 'TTGCATCACACCCTCGCCG' else 'ATCGAT' end as motif,
    {_noise("abcde")} as noise from events) b"""

PAIRED_SQL = """
select a.read_id, a.seq as seq1,
    case when a.read_id % 3 = 0 then reverse(translate(a.seq, 'TGCA', 'ACGT')) else b.seq end as seq2
from reads a join reads b on b.read_id = a.read_id + 1"""

LONG_SQL = f"""
select read_id, case read_id % 4
    when 0 then concat(repeat(motif, 60), nz, nz2, reverse(nz))
    when 1 then concat(nz, reverse(nz2), nz2, repeat(reverse(translate(motif, 'TGCA', 'ACGT')), 60))
    when 2 then repeat(motif, 100)
    else concat(nz, nz2, reverse(nz), nz2) end as seq
from (select event_id as read_id, case event_id % 3 when 0 then 'TTAGGG' when 1 then 'TTTAGGG' else 'TTGCATCACACCCTCGCCG' end as motif,
    {_noise("abcde")} as nz, {_noise("fghij")} as nz2 from events) b"""


_BASE_OF = np.arange(256, dtype=np.uint8)
_BASE_OF[list(_HEX.encode())] = list(_BASES.encode())


def _as_bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hex digits to bases in every column but event_id."""
    for batch in batches:
        columns = []
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if name != "event_id":
                valid, offsets, text = column.buffers()
                bases = pa.py_buffer(_BASE_OF[np.frombuffer(text, np.uint8)]) if text else text
                column = pa.Array.from_buffers(column.type, len(column), [valid, offsets, bases], column.null_count, column.offset)
            columns.append(column)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _from_events(spark: SparkSession, sf_dir: str, sql: str, bare: str) -> DataFrame:
    """bare: the events whose reads hold no noise."""
    # Ids are few bytes and the reads made of them many, so the ids are dealt to all cores first.
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").repartition(spark.sparkContext.defaultParallelism)
    salts = {f"noise{i}": s for i, s in enumerate(_SALTS) if _noise(s) in sql}
    hashed = ids.selectExpr("event_id", *(f"case when not coalesce({bare}, false) then {_hashed(s)} end as {c}" for c, s in salts.items()))
    noised = hashed.mapInArrow(_as_bases, ", ".join(["event_id long", *(f"{c} string" for c in salts)]))
    for c, s in salts.items():
        sql = sql.replace(_noise(s), c)
    return spark.sql(sql.replace("from events)", "from {events})"), events=noised)


def short_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, SHORT_SQL, "event_id % 5 in (0, 3)")


def long_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, LONG_SQL, "event_id % 4 = 2")


def paired_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = short_reads(spark, sf_dir)
    return spark.sql(PAIRED_SQL.replace("reads a", "{reads} a").replace("reads b", "{reads} b"), reads=reads)
