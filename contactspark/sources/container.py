"""The V9 block-compressed matrix container: import, export, and replacing its normalisation vectors.

Executors encode and compress blocks (a grouped map by block) and write them, with their
index entries, at their places in the file: all sizes are known before it is begun, so
positions are prefix sums and nothing is patched later. The driver writes what the
genome and the resolutions bound: header, heads of matrices, footer, index of vectors.
A file takes its name only when it is complete. Reading, the driver parses the header
and the list of matrices; executors parse the matrices' indexes, and seek to, inflate
and decode ranges of blocks. Paths must be on a file system that driver and executors
mount, and that takes writes at any place of a file.

Numbers are little-endian and strings end in NUL. Counts are stored as 32-bit
floats (or 16-bit integers where a block allows it).
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactspark.functions.blocks import block_shape_of
from contactspark.genome import ALL, KB, Genome
from contactspark.operators import matrix
from contactspark.session import keep, ship

MAGIC, VERSION, UNIT = b"HIC\0", 9, "BP"
SMALL, MISSING = 32767, -32768
INT_MAX = 2**31 - 1
CELLS = "chr1 int, chr2 int, bin_size int, bin1 int, bin2 int, count float"
ENTRY = "chr1 int, chr2 int, bin_size int, block_number int, position bigint, size int"
#: A block's entry in a matrix's index; bytes that one task copies.
_ENTRY = np.dtype([("number", "<i4"), ("position", "<i8"), ("size", "<i4")])
COPIED = 64 << 20


def _text(s: str) -> bytes:
    return s.encode() + b"\0"


# --- blocks ----------------------------------------------------------------


def encode_block(x: np.ndarray, y: np.ndarray, count: np.ndarray) -> bytes:
    """A block as a list of rows, before compression."""
    order = np.lexsort((x, y))
    x, y, count = x[order].astype(np.int64), y[order].astype(np.int64), count[order].astype("<f4")
    x0, y0 = int(x.min()), int(y.min())
    whole = bool((np.floor(count) == count).all()) and float(count.max()) < SMALL
    kind_x = "<i2" if x.max() - x0 < SMALL else "<i4"
    kind_y = "<i2" if y.max() - y0 < SMALL else "<i4"
    cells = np.empty(len(x), dtype=[("x", kind_x), ("v", "<i2" if whole else "<f4")])
    cells["x"], cells["v"] = x - x0, count
    rows, first = np.unique(y, return_index=True)
    ends = np.append(first[1:], len(y))
    out = [struct.pack("<iii4B", len(x), x0, y0, not whole, kind_x == "<i4", kind_y == "<i4", 1), np.array(len(rows), dtype=kind_y).tobytes()]
    for row, a, b in zip(rows, first, ends, strict=True):
        out += [np.array(row - y0, dtype=kind_y).tobytes(), np.array(b - a, dtype=kind_x).tobytes(), cells[a:b].tobytes()]
    return b"".join(out)


def decode_block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y, count of a block in either representation."""
    n, x0, y0, is_float, wide_x, wide_y, kind = struct.unpack_from("<iii4B", raw)
    at = 16
    kind_x, kind_y, kind_v = ("<i4" if wide_x else "<i2"), ("<i4" if wide_y else "<i2"), ("<f4" if is_float else "<i2")
    if kind == 2:
        held, width = struct.unpack_from("<ih", raw, at)
        values = np.frombuffer(raw, kind_v, held, at + 6)
        there = (values != 0) & (~np.isnan(values) if is_float else values != MISSING)
        place = np.flatnonzero(there)
        return x0 + place % width, y0 + place // width, values[there].astype(np.float32)
    if kind != 1:
        raise ValueError(f"unknown block representation {kind}")

    def number(kind_: str) -> int:
        nonlocal at
        value = int(np.frombuffer(raw, kind_, 1, at)[0])
        at += np.dtype(kind_).itemsize
        return value

    cell = np.dtype([("x", kind_x), ("v", kind_v)])
    parts, ys = [], []
    for _ in range(number(kind_y)):
        row, held = number(kind_y), number(kind_x)
        parts.append(np.frombuffer(raw, cell, held, at))
        ys.append(np.full(held, y0 + row))
        at += held * cell.itemsize
    cells = np.concatenate(parts) if parts else np.empty(0, dtype=cell)
    if len(cells) != n:
        raise ValueError(f"a block of {n} cells holds {len(cells)}")
    y = np.concatenate(ys) if ys else np.empty(0, dtype=np.int64)
    return x0 + cells["x"].astype(np.int64), y.astype(np.int64), cells["v"].astype(np.float32)


def blocks(numbered: DataFrame) -> DataFrame:
    """chr1, chr2, bin_size, block_number, payload from cells with block numbers. A block's area bounds a group."""
    ship(numbered.sparkSession)

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        raw = encode_block(part["bin1"].to_numpy(), part["bin2"].to_numpy(), part["count"].to_numpy())
        return pd.DataFrame([(*key, zlib.compress(raw))], columns=["chr1", "chr2", "bin_size", "block_number", "payload"])

    slim = numbered.select("chr1", "chr2", "bin_size", "block_number", "bin1", "bin2", F.col("count").cast("float").alias("count"))
    return slim.groupBy("chr1", "chr2", "bin_size", "block_number").applyInPandas(pack, "chr1 int, chr2 int, bin_size int, block_number int, payload binary")


# --- metadata --------------------------------------------------------------


@dataclass
class Expected:
    """An expected vector: norm (NONE for raw counts), bin size, values by distance, and factors by chromosome."""

    norm: str
    bin_size: int
    values: np.ndarray
    factors: dict[int, float]


@dataclass
class Header:
    version: int
    footer: int
    genome: Genome
    resolutions: list[int]
    attributes: dict[str, str] = field(default_factory=dict)
    index_position: int = 0
    index_length: int = 0
    index_offset: int = 0


class _Reader:
    def __init__(self, f, at: int = 0):
        self.f = f
        f.seek(at)

    def number(self, kind: str):
        raw = self.f.read(struct.calcsize("<" + kind))
        if len(raw) < struct.calcsize("<" + kind):
            raise ValueError("the container is cut short")
        return struct.unpack("<" + kind, raw)[0]

    def text(self) -> str:
        out = bytearray()
        while (c := self.f.read(1)) != b"\0":
            if not c:
                raise ValueError("the container is cut short")
            out += c
        return out.decode()

    def floats(self, n: int) -> np.ndarray:
        raw = self.f.read(4 * n)
        if len(raw) != 4 * n:
            raise ValueError("the container is cut short")
        return np.frombuffer(raw, "<f4")


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        r = _Reader(f)
        if f.read(3) != MAGIC[:3]:
            raise ValueError(f"{path}: not a matrix container")
        f.read(1)
        version = r.number("i")
        if version != VERSION:
            raise ValueError(f"{path}: version {version}; only {VERSION} is read")
        footer, genome_id = r.number("q"), r.text()
        offset = f.tell()
        position, length = r.number("q"), r.number("q")
        attributes = {r.text(): r.text() for _ in range(r.number("i"))}
        names = [(r.text(), r.number("q")) for _ in range(r.number("i"))]
        sizes = [r.number("i") for _ in range(r.number("i"))]
        if not 0 < footer <= os.path.getsize(path):
            raise ValueError(f"{path}: its footer lies outside the file")
        return Header(version, footer, Genome(tuple(names[1:]), genome_id), sizes, attributes, position, length, offset)


def _header_bytes(genome: Genome, resolutions: list[int], attributes: dict[str, str], footer: int, position: int, length: int) -> bytes:
    out = [MAGIC, struct.pack("<iq", VERSION, footer), _text(genome.id), struct.pack("<qq", position, length), struct.pack("<i", len(attributes))]
    out += [_text(k) + _text(v) for k, v in sorted(attributes.items())]
    names = [(ALL, genome.total // KB), *genome.chromosomes]
    out += [struct.pack("<i", len(names)), *[_text(n) + struct.pack("<q", size) for n, size in names]]
    out += [struct.pack("<i", len(resolutions)), *[struct.pack("<i", r) for r in resolutions], struct.pack("<i", 0)]
    return b"".join(out)


def _expected_bytes(vectors: list[Expected], with_norm: bool) -> bytes:
    out = [struct.pack("<i", len(vectors))]
    for v in vectors:
        out += [_text(v.norm) if with_norm else b"", _text(UNIT), struct.pack("<iq", v.bin_size, len(v.values)), np.asarray(v.values, dtype="<f4").tobytes()]
        out += [struct.pack("<i", len(v.factors)), *[struct.pack("<if", c, x) for c, x in sorted(v.factors.items())]]
    return b"".join(out)


def _vector_places(keys: list[tuple[str, int, int, int]], at: int) -> tuple[bytes, list[tuple[str, int, int, int]], int]:
    """The index of vectors (norm, chr, bin size, values) that stands at ``at``, where each vector begins, and where the last one ends."""
    position = at + 4 + sum(len(_text(n)) + 4 + len(_text(UNIT)) + 4 + 16 for n, *_ in keys)
    index, places = [struct.pack("<i", len(keys))], []
    for norm, chr_, size, n in keys:
        held = 8 + 4 * n
        index.append(_text(norm) + struct.pack("<i", chr_) + _text(UNIT) + struct.pack("<iqq", size, position, held))
        places.append((norm, chr_, size, position))
        position += held
    return b"".join(index), places, position


def _vector_keys(vectors: DataFrame | None) -> list[tuple[str, int, int, int]]:
    """Norm, chromosome, bin size and number of values of each vector."""
    if vectors is None:
        return []
    return [tuple(r) for r in vectors.groupBy("norm", "chr", "bin_size").agg(F.count("*").alias("n")).orderBy("bin_size", "chr", "norm").collect()]


def _write_vectors(vectors: DataFrame, places: list[tuple[str, int, int, int]], path: str) -> None:
    """Each vector (norm, chr, bin_size, bin, value) at its place; a chromosome's vector has one number for each of its bins."""
    keys = ["norm", "chr", "bin_size"]

    def put(part: pd.DataFrame) -> pd.DataFrame:
        values = part.sort_values("bin")["value"].to_numpy(dtype="<f4", na_value=np.nan)
        with open(path, "r+b") as f:
            f.seek(int(part["position"].iat[0]))
            f.write(struct.pack("<q", len(values)) + values.tobytes())
        return pd.DataFrame({"n": [len(values)]})

    spots = vectors.sparkSession.createDataFrame(places, "norm string, chr int, bin_size int, position bigint")
    vectors.select(*keys, "bin", "value").join(F.broadcast(spots), keys).groupBy(*keys).applyInPandas(put, "n bigint").agg(F.sum("n")).collect()


def _write_blocks(placed: DataFrame, path: str) -> int:
    """Blocks (block_number, size, payload) at ``position`` and their index entries at ``entry``; how many bytes were written."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "r+b") as f:
            for batch in batches:
                number, position, entry = (batch.column(c).to_numpy() for c in ("block_number", "position", "entry"))
                sizes = np.array([len(p.as_buffer()) for p in batch.column("payload")], dtype=np.int64)
                for at, payload in zip(position.tolist(), batch.column("payload"), strict=True):
                    f.seek(at)
                    f.write(payload.as_buffer())
                entries = np.zeros(len(sizes), dtype=_ENTRY)
                entries["number"], entries["position"], entries["size"] = number, position, sizes
                runs = np.flatnonzero(np.diff(entry, prepend=-(1 << 40)) != _ENTRY.itemsize)
                for a, b in zip(runs, np.append(runs[1:], len(entry)), strict=True):
                    f.seek(int(entry[a]))
                    f.write(entries[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([int(sizes.sum())])], names=["n"])

    dealt = placed.repartitionByRange("position").sortWithinPartitions("position")
    return dealt.select("block_number", "position", "entry", "payload").mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write(spark: SparkSession, path: str, genome: Genome, cell_rows: DataFrame, whole_genome: DataFrame | None = None, expected: list[Expected] | None = None, norm_expected: list[Expected] | None = None, vectors: DataFrame | None = None, depth_base: int = 2, scaling_factor: float = 1.0, attributes: dict[str, str] | None = None) -> None:
    """A container of cells (chr1, chr2, bin_size, bin1, bin2, count) and, if given, the whole-genome matrix, expected and normalisation vectors."""
    numbered = matrix.with_blocks(cell_rows, genome, depth_base).select("chr1", "chr2", "bin_size", "bin1", "bin2", "count", "block_number")
    sums = matrix.zooms(cell_rows, genome).select("chr1", "chr2", "bin_size", "sum_counts", "block_columns", "block_bins")
    shapes = {(r.chr1, r.chr2, r.bin_size): (r.sum_counts, r.block_columns, r.block_bins) for r in sums.collect()}
    if whole_genome is not None:
        step = genome.whole_genome_bin
        columns, side = block_shape_of(genome.total // KB, step, False)
        grid = (F.floor(F.col("bin2") / side) * columns + F.floor(F.col("bin1") / side)).cast("int")
        own = whole_genome.select(F.lit(0).alias("chr1"), F.lit(0).alias("chr2"), F.lit(step).alias("bin_size"), "bin1", "bin2", "count", grid.alias("block_number"))
        numbered = numbered.unionByName(own)
        shapes[0, 0, step] = (whole_genome.agg(F.coalesce(F.sum("count"), F.lit(0.0))).first()[0], columns, side)
    packed = keep(blocks(numbered).select("*", F.length("payload").alias("size")))
    zoom = ["chr1", "chr2", "bin_size"]
    sums = {tuple(r[:3]): (r.n, r.bytes) for r in packed.groupBy(*zoom).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy(*zoom).collect()}  # a row for each matrix and bin size
    resolutions = sorted({k[2] for k in shapes if k[0]}, reverse=True)
    noted = {"software": "contactspark", "hicFileScaling": str(float(scaling_factor))} | ({"v9BaseDepth": str(depth_base)} if depth_base != 2 else {}) | (attributes or {})
    by_matrix: dict[tuple[int, int], list[int]] = {}
    for c1, c2, size in sums:
        by_matrix.setdefault((c1, c2), []).append(size)
    at = len(_header_bytes(genome, resolutions, noted, 0, 0, 0))
    master, heads, places = [], [], []
    for (c1, c2), sizes in by_matrix.items():
        length = 12 + sum(39 + 16 * sums[c1, c2, size][0] for size in sizes)
        if length > INT_MAX:
            raise ValueError(f"the block index of matrix {c1}_{c2} is too large for the container")
        master.append(_text(f"{c1}_{c2}") + struct.pack("<qi", at, length))
        heads.append((at, struct.pack("<iii", c1, c2, len(sizes))))
        head, at = at + 12, at + length
        for k, size in enumerate(sizes):
            total, columns, side = shapes[c1, c2, size]
            n, held = sums[c1, c2, size]
            heads.append((head, _text(UNIT) + struct.pack("<iffffiiii", k, total, 0, 0, 0, size, side, columns, n)))
            places.append((c1, c2, size, head + 39, at))
            head, at = head + 39 + 16 * n, at + held
    v5 = struct.pack("<i", len(master)) + b"".join(master) + _expected_bytes(expected or [], False)
    tail = _expected_bytes(norm_expected or [], True)
    index_at = at + 8 + len(v5) + len(tail)
    index, vector_places, end = _vector_places(_vector_keys(vectors), index_at)
    with open(f"{path}.part", "wb") as f:
        f.write(_header_bytes(genome, resolutions, noted, at, index_at, len(index)))
        for head, raw in heads:
            f.seek(head)
            f.write(raw)
        f.seek(at)
        f.write(struct.pack("<q", len(v5)) + v5 + tail + index)
        f.truncate(end)
    if sums:
        before = Window.partitionBy(*zoom).orderBy("block_number")
        spots = packed.select(*zoom, "block_number", (F.row_number().over(before) - 1).alias("rank"), F.coalesce(F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        starts = F.broadcast(spark.createDataFrame(places, "chr1 int, chr2 int, bin_size int, entries bigint, data bigint"))
        placed = packed.join(spots, [*zoom, "block_number"]).join(starts, zoom)
        placed = placed.select("block_number", "payload", (F.col("data") + F.col("before")).alias("position"), (F.col("entries") + 16 * F.col("rank")).alias("entry"))
        if _write_blocks(placed, f"{path}.part") != sum(held for _, held in sums.values()):
            raise AssertionError("blocks changed while they were written")
    if vector_places:
        _write_vectors(vectors, vector_places, f"{path}.part")
    os.replace(f"{path}.part", path)


def _footer(path: str, header: Header) -> tuple[bytes, list[tuple[str, int, int]], list[Expected], list[Expected], int]:
    """The raw first part of the footer, the master index, expected vectors, normalised ones, and where these begin."""
    with open(path, "rb") as f:
        r = _Reader(f, header.footer)
        length = r.number("q")
        start = f.tell()
        if start + length > os.path.getsize(path):
            raise ValueError(f"{path}: its footer is longer than the file")
        raw = f.read(length)
        r = _Reader(f, start)
        master = [(r.text(), r.number("q"), r.number("i")) for _ in range(r.number("i"))]

        def vectors(with_norm: bool) -> list[Expected]:
            out = []
            for _ in range(r.number("i")):
                norm = r.text() if with_norm else "NONE"
                r.text()
                size, n = r.number("i"), r.number("q")
                out.append(Expected(norm, size, r.floats(n), {r.number("i"): r.number("f") for _ in range(r.number("i"))}))
            return out

        raw_expected = vectors(False)
        normed_at = start + length
        r = _Reader(f, normed_at)
        return raw, master, raw_expected, vectors(True), normed_at


def read_expected(path: str) -> list[Expected]:
    _, _, plain, normed, _ = _footer(path, read_header(path))
    return plain + normed


def vector_index(path: str) -> list[tuple[str, int, int, int, int]]:
    header = read_header(path)
    with open(path, "rb") as f:
        r = _Reader(f, header.index_position)
        out = []
        for _ in range(r.number("i")):
            norm, chr_ = r.text(), r.number("i")
            r.text()
            out.append((norm, chr_, r.number("i"), r.number("q"), r.number("q")))
        if f.tell() - header.index_position != header.index_length:
            raise ValueError(f"{path}: its index of vectors has another length than stated")
    return out


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """norm, chr, bin_size, bin, value of the container's normalisation vectors."""
    ship(spark)
    schema = "norm string, chr int, bin_size int, bin int, value float"
    entries = spark.createDataFrame(vector_index(path), "norm string, chr int, bin_size int, position bigint, size bigint")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from load_vectors(path, list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))

    return entries.mapInArrow(load, schema)


def load_vectors(path: str, entries: list[tuple[str, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """norm, chr, bin_size, bin, value of vectors (norm, chr, bin size, position, bytes), a batch for each."""
    with open(path, "rb") as f:
        for norm, chr_, bin_size, position, held in entries:
            r = _Reader(f, position)
            n = r.number("q")
            if 8 + 4 * n != held:
                raise ValueError(f"{path}: a vector has another length than its index states")
            fixed = [pa.array([norm] * n, type=pa.string()), *(pa.array(np.full(n, x, dtype=np.int32)) for x in (chr_, bin_size))]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(n, dtype=np.int32)), pa.array(r.floats(n))], names=["norm", "chr", "bin_size", "bin", "value"])


def matrices(path: str) -> list[tuple[str, int, int]]:
    """Each matrix's key, and where its index stands and how long it is."""
    return _footer(path, read_header(path))[1]


def zooms_of(raw: bytes) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """chr1, chr2, bin size, bins of a block's side, columns of blocks, and the blocks' entries, of each zoom of a matrix's index that is in base pairs."""
    c1, c2, n_zooms = struct.unpack_from("<iii", raw)
    if min(c1, c2, n_zooms) < 0:
        raise ValueError("the index of a matrix is damaged")
    at = 12
    for _ in range(n_zooms):
        end = raw.index(b"\0", at)
        unit = raw[at:end].decode()
        size, side, columns, n = struct.unpack_from("<iiii", raw, end + 21)
        at = end + 37
        if unit == UNIT:
            yield c1, c2, size, side, columns, np.frombuffer(raw, _ENTRY, n, at)
        at += n * _ENTRY.itemsize


def read_meta(path: str, at: int, length: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(at)
        raw = f.read(length)
    if len(raw) < length:
        raise ValueError(f"{path}: the index of a matrix is cut short")
    return raw


def read_index(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """An entry for each block: chr1, chr2, bin_size, block_number, position, size. Executors parse the matrices' indexes, one at a time.

    Where not ``strict``, a matrix whose index can't be read is one entry, of its
    chromosomes and place only.
    """
    ship(spark)
    held = spark.createDataFrame([(*map(int, key.split("_")), at, length) for key, at, length in matrices(path)], "chr1 int, chr2 int, at bigint, length int")
    names = ["chr1", "chr2", "bin_size", "block_number", "position", "size"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key1, key2, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    zooms = list(zooms_of(read_meta(path, at, length)))
                    if any((c1, c2) != (key1, key2) for c1, c2, *_ in zooms):
                        raise ValueError(f"{path}: the index of matrix {key1}_{key2} is of another one")
                except (ValueError, struct.error):
                    if strict:
                        raise
                    lost = [pa.array([v], type=t) for v, t in zip((key1, key2, None, None, at, None), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays(lost, names=names)
                    continue
                for c1, c2, size, _, _, entries in zooms:
                    fixed = [pa.array(np.full(len(entries), x, dtype=np.int32)) for x in (c1, c2, size)]
                    yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(np.ascontiguousarray(entries[c])) for c in ("number", "position", "size"))], names=names)

    return held.repartition(max(1, held.count())).mapInArrow(parse, ENTRY)


def load_blocks(path: str, entries: list[tuple[int, int, int, int, int]], strict: bool = True) -> Iterator[tuple[pa.RecordBatch | None, tuple | None]]:
    """Cells of blocks (chr1, chr2, bin_size, position, size), a batch for each. Of a block that can't be read, where not ``strict``, what is wrong with it instead: chr1, chr2, bin_size, position, problem."""
    with open(path, "rb") as f:
        for c1, c2, bin_size, position, size in entries:
            f.seek(position)
            try:
                x, y, count = decode_block(zlib.decompress(f.read(size)))
            except Exception as error:  # whatever bytes make of the decoder
                if strict:
                    raise ValueError(f"{path}: the block at {position} of matrix {c1}_{c2} at {bin_size} can't be read: {error}") from error
                yield None, (c1, c2, bin_size, position, f"{type(error).__name__}: {error}")
                continue
            fixed = [pa.array(np.full(len(x), v, dtype=np.int32)) for v in (c1, c2, bin_size)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(count)], names=["chr1", "chr2", "bin_size", "bin1", "bin2", "count"]), None


def read_cells(spark: SparkSession, path: str, where: str | None = None, blocks_per_task: int = 512) -> DataFrame:
    """Cells of the container's matrices; ``where`` (on chr1, chr2, bin_size, block_number) prunes blocks before they are read."""
    ship(spark)
    entries = read_index(spark, path).where("chr1 > 0")
    entries = entries.where(where) if where else entries
    tasks = max(1, math.ceil(entries.count() / blocks_per_task))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("chr1", "chr2", "bin_size", "position", "size")), strict=True)
            yield from (cells for cells, _ in load_blocks(path, sorted(rows, key=lambda r: r[3])))

    return entries.repartitionByRange(tasks, "position").mapInArrow(load, CELLS)


PROBLEM = "position bigint, problem string"


def read_checked(spark: SparkSession, path: str, where: str | None = None, blocks_per_task: int = 512) -> tuple[DataFrame, DataFrame]:
    """Cells of the blocks that can be read, and of the others chr1, chr2, bin_size, position and what is wrong; where a matrix's whole index can't be read, without bin_size. Blocks are read once, into a table."""
    ship(spark)
    entries = read_index(spark, path, strict=False).where("chr1 > 0")
    entries = entries.where(where) if where else entries
    lost = entries.where("size is null").select("chr1", "chr2", "bin_size", "position", F.lit("its index can't be read").alias("problem"))
    entries = entries.where("size is not null")
    tasks = max(1, math.ceil(entries.count() / blocks_per_task))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chr1", "chr2", "bin_size", "bin1", "bin2", "count", "position", "problem"]
        kinds = [pa.int32()] * 5 + [pa.float32(), pa.int64(), pa.string()]
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("chr1", "chr2", "bin_size", "position", "size")), strict=True)
            for cells, bad in load_blocks(path, sorted(rows, key=lambda r: r[3]), strict=False):
                columns = [*cells.columns, pa.nulls(cells.num_rows, pa.int64()), pa.nulls(cells.num_rows, pa.string())] if cells is not None else [pa.array([v], type=k) for v, k in zip((*bad[:3], None, None, None, *bad[3:]), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    read = keep(entries.repartitionByRange(tasks, "position").mapInArrow(load, f"{CELLS}, {PROBLEM}"))
    bad = read.where("problem is not null").select("chr1", "chr2", "bin_size", "position", "problem")
    return read.where("problem is null").drop("position", "problem"), bad.unionByName(lost)


def _copy(spark: SparkSession, path: str, to: str, length: int) -> None:
    """The first bytes of a file to another, which is there, in ranges that executors copy."""

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                with open(path, "rb") as old, open(to, "r+b") as new:
                    old.seek(k * COPIED)
                    new.seek(k * COPIED)
                    left = min(COPIED, length - k * COPIED)
                    while left > 0 and (part := old.read(min(left, 1 << 22))):
                        new.write(part)
                        left -= len(part)
            yield batch

    n = -(-length // COPIED)
    spark.range(0, n, 1, n).mapInArrow(copied, "id bigint").count()


def replace_vectors(spark: SparkSession, path: str, vectors: DataFrame, norm_expected: list[Expected]) -> None:
    """The container with new normalisation vectors; what stands before them is copied, and the file is replaced as a whole."""
    ship(spark)
    header = read_header(path)
    *_, normed_at = _footer(path, header)
    tail = _expected_bytes(norm_expected, True)
    index_at = normed_at + len(tail)
    index, places, end = _vector_places(_vector_keys(vectors), index_at)
    with open(f"{path}.part", "wb") as new:
        new.truncate(end)
    _copy(spark, path, f"{path}.part", normed_at)
    with open(f"{path}.part", "r+b") as new:
        new.seek(normed_at)
        new.write(tail + index)
        new.seek(header.index_offset)
        new.write(struct.pack("<qq", index_at, len(index)))
    if places:
        _write_vectors(vectors, places, f"{path}.part")
    os.replace(f"{path}.part", path)


def inspect(path: str) -> dict:
    """What a container says of itself, after checks of its bounds, pointers, keys and lengths."""
    header = read_header(path)
    _, master, plain, normed, _ = _footer(path, header)
    index = vector_index(path)
    keys = [e[:3] for e in index]
    if len(set(keys)) != len(keys):
        raise ValueError(f"{path}: a vector is indexed twice")
    for key, at, _ in master:
        if not 0 < at < header.footer:
            raise ValueError(f"{path}: matrix {key} lies outside the body")
    lengths = header.genome.lengths()
    for norm, chr_, size, _, held in index:
        if held != 8 + 4 * (lengths[chr_] // size + 1):
            raise ValueError(f"{path}: {norm} of chromosome {chr_} at {size} has a wrong length")
    return {"version": header.version, "genome": header.genome.id, "chromosomes": list(header.genome.chromosomes), "resolutions": header.resolutions, "fragment_resolutions": [], "matrices": len(master), "expected": len(plain), "norm_expected": len(normed), "vectors": len(index), "attributes": header.attributes}
