"""Read pairs in fixed-length little-endian records: ``.bin`` (26 bytes, strands and fragments) and ``.bn`` (20 bytes, with a score).

Tasks read ranges of whole records from files on a mounted path, and NumPy decodes them in
runs. Files elsewhere come through Spark's record reader, record by record.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from contactspark.genome import Genome
from contactspark.session import ship
from contactspark.sources import ranges

RECORDS = {
    "bin": np.dtype([("fwd1", "u1"), ("chr1", "<i4"), ("pos1", "<i4"), ("frag1", "<i4"), ("fwd2", "u1"), ("chr2", "<i4"), ("pos2", "<i4"), ("frag2", "<i4")]),
    "bn": np.dtype([("chr1", "<i4"), ("pos1", "<i4"), ("chr2", "<i4"), ("pos2", "<i4"), ("score", "<f4")]),
}
SCHEMA = "chr1 int, pos1 int, strand1 byte, frag1 int, mapq1 int, chr2 int, pos2 int, strand2 byte, frag2 int, mapq2 int, score float"
#: Records that are decoded together, and the MAPQ of layouts that hold none.
RUN, NO_MAPQ = 65_536, 1000


def _runs(records: Iterator[bytes]) -> Iterator[tuple[bytearray]]:
    while run := b"".join(islice(records, RUN)):
        yield (bytearray(run),)


def decode(fmt: str, raw: bytes, chromosomes: int) -> pa.RecordBatch:
    """The pairs in a run of records; an index outside 1 to ``chromosomes`` is an error."""
    r = np.frombuffer(raw, dtype=RECORDS[fmt])
    columns = []
    for end in "12":
        index = r[f"chr{end}"]
        wrong = index[(index < 1) | (index > chromosomes)]
        if len(wrong):
            raise ValueError(f"no such chromosome index: {wrong[0]}")
        constant = np.full(len(r), int(end) - 1)
        strand = (r[f"fwd{end}"] == 0) if fmt == "bin" else constant
        frag = r[f"frag{end}"] if fmt == "bin" else constant
        columns += [index.astype("i4"), r[f"pos{end}"].astype("i4"), strand.astype("i1"), frag.astype("i4"), np.full(len(r), NO_MAPQ, dtype="i4")]
    columns.append(r["score"].astype("f4") if fmt == "bn" else np.ones(len(r), dtype="f4"))
    names = [f"{c}{end}" for end in "12" for c in ("chr", "pos", "strand", "frag", "mapq")] + ["score"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def read_binary(spark: SparkSession, path: str, genome: Genome, fmt: str) -> DataFrame:
    """Pairs of binary files. A chromosome index outside the genome, or a cut last record, is an error."""
    ship(spark)
    size, n = RECORDS[fmt].itemsize, len(genome.chromosomes)
    files = ranges.listed(spark, path)
    for uri, length in files:
        if length % size:
            raise ValueError(f"{uri}: its length is no multiple of {size}; the last record is cut short")
    if not ranges.mounted(files):
        return read_runs(spark.createDataFrame(spark.sparkContext.binaryRecords(path, size).mapPartitions(_runs), "r binary"), fmt, n)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(ranges.local(uri), "rb") as f:
                    f.seek(start)
                    for at in range(start, stop, RUN * size):
                        yield decode(fmt, f.read(min(RUN * size, stop - at)), n)

    return ranges.split(spark, files, ranges.RANGE // size * size).mapInArrow(read, SCHEMA)


def read_runs(runs: DataFrame, fmt: str, n: int) -> DataFrame:
    """The pairs in runs of records (a column ``r``), of a genome of ``n`` chromosomes."""
    ship(runs.sparkSession)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column("r"):
                yield decode(fmt, run.as_py(), n)

    return runs.mapInArrow(decoded, SCHEMA)
