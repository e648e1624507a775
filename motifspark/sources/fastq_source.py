"""``spark.read.format("fastq")``: reads of FASTQ files, filtered and pruned in the reader.

Columns: file, read_id (from 0 in each file), length, seq; a narrower schema given by the
user leaves out what isn't wanted before rows are built. Comparisons of length and read_id
with constants and equality of file are pushed into the reader and not evaluated again.

Options: ``path``, a file or folder; or ``index``, a folder of ranges (``fastq_index``),
of which small ones are packed into tasks of ``splitBytes``. Without an index a file is one task.

Defined results: an empty file has no reads; a record that ends after its second line
is a read; a missing second line is none; line ends are ``\\n``; bytes beyond ASCII read as ?.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from . import blocks as bl
from . import fastq_index as fi

SCHEMA = "file string, read_id long, length int, seq string"
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_LAST = 1 << 62


@dataclass
class Range(InputPartition):
    """Ranges of files, as (file, codec, line, at, within, until)."""

    parts: list[tuple]


class Sequences:
    """Sequences of a stretch of text: their record numbers, and their bytes in a buffer."""

    def __init__(self, number: np.ndarray, buf: bytes, starts: np.ndarray, ends: np.ndarray):
        self.number, self.buf, self.starts, self.ends = number, buf, starts, ends

    def where(self, keep: np.ndarray) -> Sequences:
        return Sequences(self.number[keep], self.buf, self.starts[keep], self.ends[keep])

    def array(self) -> pa.Array:
        size = self.ends - self.starts
        upto = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(self.buf, np.uint8)[np.repeat(self.starts - upto[:-1], size) + np.arange(upto[-1])]
        data[data >= 128] = 63
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def sequences(texts: Iterator[bytes], line: int, begin: int, until: int | None) -> Iterator[Sequences]:
    """The sequences whose lines are in [begin, until). texts: from the start of a line on, whose number is line."""
    stop, held = _LAST if until is None else until, []
    for text in texts:
        if b"\n" not in text:
            held.append(text)
            continue
        buf = b"".join([*held, text])
        ends = np.flatnonzero(np.frombuffer(buf, np.uint8) == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        number = line + np.arange(len(ends))
        keep = (number % 4 == 1) & (number >= begin) & (number < stop)
        if keep.any():
            yield Sequences(number[keep] // 4, buf, starts[keep], ends[keep])
        line += len(ends)
        if line >= stop:
            return
        held = [buf[int(ends[-1]) + 1 :]]
    buf = b"".join(held)
    if buf and line % 4 == 1 and begin <= line < stop:
        yield Sequences(np.array([line // 4]), buf, np.array([0]), np.array([len(buf)]))


def read_range(path: str, codec: str, line: int, at: int, within: int, begin: int, until: int | None) -> Iterator[Sequences]:
    with bl.open_file(path) as file:
        yield from sequences(bl.texts(file, codec, at, within), line, begin, until)


class FastqReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options, self.pushed = schema.fieldNames(), dict(options), []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            at = getattr(f, "attribute", ())  # a negated filter has none
            name = at[0] if len(at) == 1 else ""
            if type(f) in _COMPARED and (name in ("length", "read_id") or name == "file" and isinstance(f, EqualTo)):
                self.pushed.append((name, type(f), f.value))
            elif not (isinstance(f, IsNotNull) and name in ("file", "read_id", "length", "seq")):  # no column is ever null
                yield f

    def _wanted(self, name: str, values) -> list:
        return [_COMPARED[kind](values, value) for column, kind, value in self.pushed if column == name]

    def partitions(self) -> list[Range]:
        found = self._indexed() if "index" in self.options else self._files()
        found = [(size, part) for size, part in found if all(self._wanted("file", part[0]))]
        most, out, size = int(self.options.get("splitbytes", fi.SPLIT_BYTES)), [], 0
        for n, part in sorted(found, key=lambda x: (x[1][0], x[1][2])):
            if not out or size + n > most:
                out.append(Range([]))
                size = 0
            out[-1].parts.append(part)
            size += n
        return out or [Range([])]

    def _indexed(self) -> list[tuple]:
        """The ranges of the index: a row for each split of a large file and for each small file."""
        path = self.options["index"]
        store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        rows = ds.dataset(name, filesystem=store, format="parquet").to_table().to_pylist()
        return [(r["bytes"], tuple(r[c] for c in ("file", "codec", "line", "at", "within", "until"))) for r in rows]

    def _files(self) -> list[tuple]:
        path = self.options["path"]
        store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        info = store.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = [info] if info.type == fs.FileType.File else [i for i in store.get_file_info(fs.FileSelector(name)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
        prefix = path.removesuffix(name) if path.endswith(name) else ""
        return [(i.size, (prefix + i.path, None, 0, 0, 0, None)) for i in files]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for path, codec, line, at, within, until in partition.parts:
            if codec is None:
                with bl.open_file(path) as file:
                    codec = bl.codec_of(file, path)
            for found in read_range(path, codec, line, at, within, line, until):
                keep = np.ones(len(found.number), bool)
                for mask in (*self._wanted("read_id", found.number), *self._wanted("length", found.ends - found.starts)):
                    keep &= mask
                found = found.where(keep)
                column = {
                    "file": lambda f=found, p=path: pa.array([p]).take(pa.array(np.zeros(len(f.number), np.int64))),
                    "read_id": lambda f=found: pa.array(f.number),
                    "length": lambda f=found: pa.array((f.ends - f.starts).astype(np.int32)),
                    "seq": found.array,
                }
                yield pa.RecordBatch.from_arrays([column[c]() for c in self.columns], self.columns)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastqReader:
        unknown = set(schema.fieldNames()) - {"file", "read_id", "length", "seq"}
        if unknown or not {"path", "index"} & set(self.options):
            raise ValueError(f"fastq: unknown columns {sorted(unknown)}" if unknown else "fastq: a path or an index is needed")
        return FastqReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters into its readers."""
    spark.dataSource.register(FastqSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
