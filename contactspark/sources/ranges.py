"""Files that tasks read by byte ranges: block gzip (BGZF), of which any block can be found and inflated by itself, and plain runs of bytes.

Paths must be on a file system that driver and executors mount; ``mounted`` says whether
they are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.session import ship

#: Bytes of a file that a task reads, and of text in a BGZF block that is written.
RANGE, TEXT = 32 << 20, 65_280
#: How BGZF blocks begin (gzip with an extra field), and the file's last block, which is empty.
_MAGIC = b"\x1f\x8b\x08\x04"
_LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
LINES = "value string, file string, start bigint, place bigint"


def local(uri: str) -> str:
    """The path of a file URI."""
    return unquote(urlparse(uri).path) if uri.startswith("file:") else uri


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """URI and length of each file that a path, folder or pattern names, in order of their names; contents aren't read."""
    return sorted(tuple(r) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())


def mounted(files: list[tuple[str, int]]) -> bool:
    return bool(files) and all(uri.startswith("file:") for uri, _ in files)


def split(spark: SparkSession, files: list[tuple[str, int]], size: int) -> DataFrame:
    """file, start, stop: ranges of at most ``size`` bytes, one to a task."""
    rows = [(uri, at, min(at + size, n)) for uri, n in files for at in range(0, n, size)]
    return spark.createDataFrame(rows, "file string, start bigint, stop bigint").repartition(max(1, len(rows)), "file", "start")


# --- BGZF --------------------------------------------------------------------


def block_size(raw: bytes, at: int) -> int | None:
    """Bytes of the BGZF block that begins there, or None where none does."""
    if raw[at : at + 4] != _MAGIC or len(raw) < at + 18:
        return None
    extra = struct.unpack_from("<H", raw, at + 10)[0]
    field, end = at + 12, at + 12 + extra
    while field + 4 <= min(end, len(raw)):
        name, size = raw[field : field + 2], struct.unpack_from("<H", raw, field + 2)[0]
        if name == b"BC" and size == 2 and field + 6 <= len(raw):
            return struct.unpack_from("<H", raw, field + 4)[0] + 1
        field += 4 + size
    return None


def is_bgzf(path: str) -> bool:
    with open(path, "rb") as f:
        return block_size(f.read(1 << 16), 0) is not None


def first_block(f, start: int) -> int | None:
    """Where the first block at or after ``start`` begins: a place that looks like a block and is followed by one, or by the end."""
    if start == 0:
        return 0
    f.seek(start)
    raw = f.read(3 << 16)  # holds the rest of a block, a whole one and the head of the next
    at = raw.find(_MAGIC)
    while at >= 0:
        size = block_size(raw, at)
        if size is not None:
            f.seek(start + at + size)
            head = f.read(1 << 12)
            if not head or block_size(head, 0) is not None:
                return start + at
        at = raw.find(_MAGIC, at + 1)
    return None


def blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    """Where each block from ``at`` on begins, and its text."""
    while True:
        f.seek(at)
        raw = f.read(1 << 16)
        if not raw:
            return
        size = block_size(raw, 0)
        if size is None:
            raise ValueError(f"no block begins at {at}")
        extra = struct.unpack_from("<H", raw, 10)[0]
        yield at, zlib.decompress(raw[12 + extra : size - 8], -15)
        at += size


def range_lines(path: str, start: int, stop: int, together: int = 1 << 22) -> Iterator[list[bytes]]:
    """The lines of a range's blocks, in runs. A line that begins in one range and ends in a later one is the first's.

    But for a file's first range, what stands before the first line feed is the range's
    before; each range reads on to the first line feed of the blocks after it.
    """
    with open(path, "rb") as f:
        at = first_block(f, start)
        if at is None or at >= stop:
            return
        rest, skipping = b"", start > 0
        for place, text in blocks(f, at):
            if place >= stop:
                if skipping:
                    return
                end = text.find(b"\n")
                rest += text if end < 0 else text[:end]
                if end >= 0:
                    yield rest.split(b"\n")
                    return
                continue
            if skipping:
                end = text.find(b"\n")
                if end < 0:
                    continue
                text, skipping = text[end + 1 :], False
            rest += text
            if len(rest) >= together:
                *whole, rest = rest.split(b"\n")
                if whole:
                    yield whole
        if skipping:
            return
    *whole, rest = rest.split(b"\n")
    if rest:
        whole.append(rest)
    if whole:
        yield whole


def read_lines(spark: SparkSession, files: list[tuple[str, int]], size: int = RANGE) -> DataFrame:
    """value, file, start, place of the lines of BGZF files: a line's range, and its place in it."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = 0
                for run in range_lines(local(uri), start, stop):
                    values = pa.array(run, type=pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([values, pa.array([uri] * len(run)), pa.array([start] * len(run)), pa.array(range(n, n + len(run)))], names=["value", "file", "start", "place"])
                    n += len(run)

    return split(spark, files, size).mapInArrow(read, LINES)


def write_lines(lines: DataFrame, folder: str, suffix: str = ".txt.gz") -> None:
    """The column ``value`` as BGZF files below ``folder`` (a mounted path, which must be there), one for each partition, in order. A file takes its name when it is complete."""
    ship(lines.sparkSession)
    import os
    import uuid

    numbered = lines.select("value", F.spark_partition_id().alias("part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, held = None, None, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"{folder}/part-{batch.column('part')[0].as_py():06d}{suffix}"
                out = open(f"{name}.{uuid.uuid4()}", "wb")  # noqa: SIM115
            held += b"".join((v.as_py() or "").encode() + b"\n" for v in batch.column("value"))
            while len(held) > TEXT:
                out.write(bgzf_block(held[:TEXT]))
                held = held[TEXT:]
        if out is not None:
            out.write((bgzf_block(held) if held else b"") + _LAST)
            out.close()
            os.replace(out.name, name)
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])

    numbered.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def bgzf_block(text: bytes) -> bytes:
    """A BGZF block of at most ``TEXT`` bytes of text."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    if len(body) + 26 > 1 << 16:  # what can't be compressed is stored
        deflate = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = deflate.compress(text) + deflate.flush()
    head = _MAGIC + struct.pack("<IBBH", 0, 0, 255, 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))
