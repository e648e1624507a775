"""The text of plain, gzip and block gzip files from any place that a reader can begin at.

A place is a pair: ``at``, an offset in the file, and ``within``, an offset in the text
of the block that begins there. In a plain file within is 0. A block gzip file is a row
of gzip members of at most 64 KiB, each of which says its packed size in a header field,
so reading can begin at any of them; the first one after an offset is found by its
header and proved by its checksum. Other gzip files are read from their beginning only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs

PLAIN, GZIP, BLOCKS = "plain", "gzip", "blocks"
READ = 1 << 22
# A member's header with one extra field of six bytes, the field's name BC and size; the most bytes of a block.
_HEADER = re.compile(rb"\x1f\x8b\x08\x04.{6}\x06\x00BC\x02\x00", re.DOTALL)
_HEADER_SIZE, _LARGEST = 18, 1 << 16


def open_file(path: str) -> pa.NativeFile:
    """A file of any store that Arrow reaches, for reads at any offset."""
    local = re.match("^file:/+", path)
    store, name = (fs.LocalFileSystem(), "/" + path[local.end() :]) if local else (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def codec_of(file: pa.NativeFile, path: str) -> str:
    """By name, then by the first bytes: packed files may be in blocks or not, or plain in spite of their name."""
    if not path.endswith((".gz", ".bgz")):
        return PLAIN
    head = file.read_at(_HEADER_SIZE, 0)
    return BLOCKS if _HEADER.match(head) else GZIP if head[:2] == b"\x1f\x8b" else PLAIN


def _block(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The text of the block that begins at data[at], and where it ends; None if data ends before."""
    if at + _HEADER_SIZE > len(data):
        return None
    if not _HEADER.match(data, at):
        raise ValueError("a block's header is missing")
    end = at + int.from_bytes(data[at + 16 : at + 18], "little") + 1
    if end > len(data):
        return None
    text = zlib.decompress(data[at + _HEADER_SIZE : end - 8], wbits=-15)
    if zlib.crc32(text) != int.from_bytes(data[end - 8 : end - 4], "little") or len(text) != int.from_bytes(data[end - 4 : end], "little"):
        raise ValueError("a block's checksum is wrong")
    return text, end


def first_block(file: pa.NativeFile, start: int) -> int | None:
    """The offset of the first block that begins at start or after it."""
    if start == 0:
        return 0
    data = file.read_at(2 * _LARGEST + _HEADER_SIZE, start)
    for found in _HEADER.finditer(data):
        try:
            if _block(data, found.start()):
                return start + found.start()
        except (ValueError, zlib.error):
            continue  # the bytes of a header inside a block
    return None


def block_texts(file: pa.NativeFile, at: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Offset and text of each block that begins in [at, end); at is where one begins."""
    data, base = b"", at
    while end is None or base < end:
        more = file.read_at(READ, base + len(data))
        data += more
        place = 0
        while end is None or base + place < end:
            found = _block(data, place)
            if found is None:
                break
            yield base + place, found[0]
            place = found[1]
        data, base = data[place:], base + place
        if not more:
            if data and (end is None or base < end):
                raise ValueError(f"a block is cut off at byte {base}")
            return


def _unpacked(file: pa.NativeFile) -> Iterator[bytes]:
    """The text of all members of a gzip file."""
    member, rest = zlib.decompressobj(31), b""
    at = 0
    while True:
        data = rest or file.read_at(READ, at)
        if not rest:
            at += len(data)
        if not data:
            return
        if member.eof:
            member = zlib.decompressobj(31)
        yield member.decompress(data, READ)
        while member.unconsumed_tail:
            yield member.decompress(member.unconsumed_tail, READ)
        rest = member.unused_data


def texts(file: pa.NativeFile, codec: str, at: int = 0, within: int = 0) -> Iterator[bytes]:
    """The text from a place to the end, in parts."""
    if codec == PLAIN:
        while part := file.read_at(READ, at):
            yield part
            at += len(part)
    elif codec == GZIP:
        yield from _unpacked(file)
    else:
        held, size = [], 0
        for _, text in block_texts(file, at):
            held.append(text[within:])
            within, size = 0, size + len(text)
            if size >= READ:
                yield b"".join(held)
                held, size = [], 0
        yield b"".join(held)


def split_texts(file: pa.NativeFile, codec: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and text of the parts of a plain or block file that begin in [start, end)."""
    if codec == PLAIN:
        while start < end and (part := file.read_at(min(READ, end - start), start)):
            yield start, part
            start += len(part)
    elif (first := first_block(file, start)) is not None and first < end:
        yield from block_texts(file, first, end)
