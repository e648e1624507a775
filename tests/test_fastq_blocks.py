"""Files of blocks, splits of any size, the fastq format and pairing by marks, against the whole text."""

import gzip
import random
import re
import struct
import zlib

import pyarrow as pa
import pytest

from motifspark.sources import blocks as bl
from motifspark.sources import fastq, fastq_source
from motifspark.sources import fastq_index as fi

from .test_fastq import got, records


def block(text):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(text) + packer.flush()
    size = len(data) + 25
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff\x06\0BC\x02\0" + struct.pack("<H", size) + data + struct.pack("<II", zlib.crc32(text), len(text))


def packed(text, sizes):
    """Text in blocks of these sizes in turn, and the empty block that ends such files."""
    out, at, k = [], 0, 0
    while at < len(text):
        n = sizes[k % len(sizes)]
        out.append(block(text[at : at + n]))
        at, k = at + n, k + 1
    return b"".join([*out, block(b"")])


@pytest.fixture(scope="module")
def seqs():
    rng = random.Random(9)
    return ["".join(rng.choices("TGCANtgca", k=rng.choice([0, 1, 50, 150, 700]))) for _ in range(1200)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, seqs):
    path = tmp_path_factory.mktemp("fastq")
    text = records(seqs).encode()
    (path / "plain.fastq").write_bytes(text)
    (path / "three.bgz").write_bytes(packed(text[:190_000], [65_000]))
    (path / "many.bgz").write_bytes(packed(text, [1, 700, 65_280, 3]))
    (path / "many.gz").write_bytes(packed(text, [5_000]))
    (path / "members.bgz").write_bytes(gzip.compress(text[:1000]) + gzip.compress(text[1000:]))
    (path / "really_plain.gz").write_bytes(text)
    (path / "cut.bgz").write_bytes(packed(text.rstrip(b"\n"), [9_000]))
    return path


@pytest.mark.parametrize("name", ["plain.fastq", "many.bgz", "many.gz", "cut.bgz", "members.bgz", "really_plain.gz"])
@pytest.mark.parametrize("split", [97, 5_003, 60_000, 1 << 26])
def test_any_cut_reads_the_whole_text(spark, folder, seqs, name, split):
    path = str(folder / name)
    if split == 97:  # so many splits that they are cut in plain Python
        with bl.open_file(path) as file:
            codec, size = bl.codec_of(file, path), (folder / name).stat().st_size
            whole = b"".join(bl.texts(file, codec))
            if codec != bl.GZIP:
                parts = [t for a in range(0, size, split) for _, t in bl.split_texts(file, codec, a, min(a + split, size))]
                assert b"".join(parts) == whole
        assert whole.rstrip(b"\n") == records(seqs).encode().rstrip(b"\n")
    else:
        assert got(fastq.read_fastq(spark, path, split_bytes=split)) == list(enumerate(seqs))


def test_a_file_of_three_blocks_is_read_by_three_tasks(spark, folder, seqs):
    path = str(folder / "three.bgz")
    with bl.open_file(path) as file:
        at = [a for a, t in bl.block_texts(file, 0) if t]
    assert len(at) == 3
    df = fastq.read_fastq(spark, path, split_bytes=at[1] - 5)
    assert df.rdd.getNumPartitions() == 3
    want = records(seqs)[:190_000].split("\n")[1::4]
    assert got(df) == list(enumerate(want))


def test_damaged_files_fail(spark, folder, tmp_path):
    data = (folder / "many.gz").read_bytes()
    (tmp_path / "short.bgz").write_bytes(data[:-60])
    (tmp_path / "wrong.bgz").write_bytes(data[:3000] + bytes([data[3000] ^ 1]) + data[3001:])
    for name in ("short.bgz", "wrong.bgz"):
        with pytest.raises(Exception, match="cut off|checksum|header|decompress"):
            fastq.read_fastq(spark, str(tmp_path / name)).collect()


def test_bytes_like_a_header_inside_a_block_are_no_block():
    fake = block(b"A" * 100)[:18]
    stored = zlib.compressobj(0, zlib.DEFLATED, -15)
    text = b"G" * 50 + fake + b"T" * 50
    data = stored.compress(text) + stored.flush()
    first = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(text), len(text))
    file = pa.py_buffer(first + block(b"next"))
    reader = pa.BufferReader(file)
    assert bl.first_block(reader, 1) == len(first) and bl.first_block(reader, 0) == 0 and bl.first_block(reader, len(first) + 1) is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_format_filters_and_prunes_in_the_reader(spark, folder, seqs):
    fastq_source.register(spark)
    path = str(folder / "many.bgz")
    whole = spark.read.format("fastq").load(path)
    assert whole.columns == ["file", "read_id", "length", "seq"] and got(whole) == list(enumerate(seqs))
    long = whole.where("length >= 150 and read_id < 700 and length <> 7")
    assert [r.read_id for r in sorted(long.collect(), key=lambda r: r.read_id)] == [i for i, s in enumerate(seqs) if len(s) >= 150 and i < 700]
    assert not re.search(r"\bFilter\b", plan_of(whole.where("length >= 150 and read_id < 700")))
    assert re.search(r"\bFilter\b", plan_of(whole.where("length <> 7")))
    ids = spark.read.format("fastq").schema("read_id long, length int").load(path).where("length = 50")
    assert sorted(map(tuple, ids.collect())) == [(i, 50) for i, s in enumerate(seqs) if len(s) == 50]
    both = spark.read.format("fastq").load(str(folder))
    assert both.select("file").distinct().count() == 7
    one = both.where(f"file = '{path}'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == len(seqs)
    for bad in (lambda: spark.read.format("fastq").schema("quality string").load(path).collect(), lambda: spark.read.format("fastq").load(path + "x").collect(), lambda: spark.read.format("fastq").load().collect()):
        with pytest.raises(Exception):
            bad()


def test_long_reads_leave_short_ones_in_the_reader(spark, folder, seqs):
    df = fastq.long_reads(spark, str(folder / "many.bgz"), slice_length=150, split_bytes=20_000)
    assert got(df) == [(i, s) for i, s in enumerate(seqs) if len(s) >= 150]
    assert not re.search(r"\bFilter\b", plan_of(df))


@pytest.mark.parametrize("first", ["plain.fastq", "many.bgz", "members.bgz"])
@pytest.mark.parametrize("split", [20_000, 1 << 26])
def test_mates_are_read_in_step(spark, folder, tmp_path, seqs, first, split):
    mates = [s[::-1] + "A" for s in seqs]
    (tmp_path / "mates.bgz").write_bytes(packed(records(mates).encode(), [4_000]))
    pair = (str(folder / first), str(tmp_path / "mates.bgz"))
    df = fastq.paired_reads(spark, pair, (pair[1], pair[0]), split_bytes=split, mark_bytes=3_000)
    plan = plan_of(df)
    assert not re.search(r"\w+Join\b", plan) and plan.count("Exchange") == 1  # the one that deals ranges
    after = plan[plan.index("Exchange") :]
    assert "seq" not in after and "MapInArrow" not in after
    rows = sorted((r.file.rsplit("/", 1)[1], r.read_id, r.seq1, r.seq2) for r in df.collect())
    assert rows == sorted([(first, i, a, b) for i, (a, b) in enumerate(zip(seqs, mates, strict=True))] + [("mates.bgz", i, b, a) for i, (a, b) in enumerate(zip(seqs, mates, strict=True))])


def test_mates_of_unequal_files_fail_in_any_split(spark, folder, tmp_path, seqs):
    (tmp_path / "less.fastq").write_text(records(seqs[:-1]))
    (tmp_path / "more.fastq").write_text(records([*seqs, "A"]))
    for other in ("less.fastq", "more.fastq"):
        for pair in ((str(folder / "many.bgz"), str(tmp_path / other)), (str(tmp_path / other), str(folder / "many.bgz"))):
            with pytest.raises(Exception, match="unequal"):
                fastq.paired_reads(spark, pair, split_bytes=30_000, mark_bytes=2_000).collect()


def test_marks_stand_at_line_starts(spark, folder, seqs):
    lines = records(seqs).encode().splitlines(keepends=True)
    for name in ("plain.fastq", "many.bgz"):
        rows = fi.marks(spark, [str(folder / name)], 50_000, 4_000).collect()
        assert len(rows) > 20 and sum(r["first"] for r in rows) < len(rows)
        with bl.open_file(str(folder / name)) as file:
            for r in rows[:: len(rows) // 20]:
                assert b"".join(bl.texts(file, r["codec"], r["at"], r["within"])) == b"".join(lines[r["line"] :])
