"""The V9 container as a Spark data source, ``spark.read.format("contact_matrix")``.

Its tables (option ``table``) are ``cells``, ``blocks`` (the index: an entry for each
block), ``vectors`` and ``matrices``. Filters that Spark pushes prune before anything is
read: matrices by their chromosomes, zooms by bin size, vectors by norm, and blocks by
the bins that they can hold, which follow from a block's number. Planning reads the
header and the list of matrices only; a task gets a share of one matrix's blocks, parses
that matrix's index and reads what filters leave of its share. Spark tests all filters
again on the rows.

Options: ``blocks_per_task`` (512), ``whole_genome`` (false: without the whole-genome
matrix, whose chromosomes are 0).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from contactspark.session import ship
from contactspark.sources import container

NAME = "contact_matrix"
SCHEMAS = {
    "cells": container.CELLS,
    "blocks": container.ENTRY,
    "vectors": "norm string, chr int, bin_size int, bin int, value float",
    "matrices": "chr1 int, chr2 int, position bigint, size int",
}
#: Most tasks that share a matrix, each of which parses its index.
MOST_TASKS = 256
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Limits:
    """What filters leave of a column: a range, and values if they name some."""

    low: float = -np.inf
    high: float = np.inf
    values: frozenset | None = None

    def narrow(self, f: Filter) -> None:
        if isinstance(f, (EqualTo, In)):
            named = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            self.values = named if self.values is None else self.values & named
            numbers = [v for v in named if isinstance(v, (int, float))]
            if len(numbers) == len(named):
                self.low, self.high = max(self.low, min(numbers, default=np.inf)), min(self.high, max(numbers, default=-np.inf))
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value)

    def admit(self, value) -> bool:
        return (self.values is None or value in self.values) and (isinstance(value, str) or self.low <= value <= self.high)


def may_hold(number: np.ndarray, intra: bool, side: int, columns: int, base: int, one: Limits, two: Limits) -> np.ndarray:
    """Which blocks may hold cells with ``bin1`` and ``bin2`` within the limits."""
    low = [max(0.0, x.low) for x in (one, two)]
    high = [x.high for x in (one, two)]
    row, column = number // columns, number % columns
    if not intra:
        spans = zip((column, row), low, high, strict=True)
        return np.logical_and.reduce([(k * side <= b) & ((k + 1) * side > a) for k, a, b in spans])
    # blocks lie along the diagonal: a column spans means of the two bins, a row distances, which widen from row to row
    total = (2 * column * side <= sum(high)) & (2 * (column + 1) * side > sum(low))
    nearest, farthest = max(0.0, low[0] - high[1], low[1] - high[0]), max(high[0] - low[1], high[1] - low[0])
    unit = np.sqrt(2.0) * side
    begins, ends = unit * (float(base) ** row - 1), unit * (float(base) ** (row + 1) - 1)
    return total & (begins <= farthest + 1) & (ends >= nearest - 1)


@dataclass
class Share(InputPartition):
    """A task's part of the container: of ``shares`` parts of what is chosen of a matrix's blocks, or some of the vectors."""

    at: int = 0
    length: int = 0
    share: int = 0
    shares: int = 1
    entries: tuple = ()

    def __post_init__(self) -> None:
        super().__init__(self.at)


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, blocks_per_task: int, whole_genome: bool):
        self.path, self.table, self.blocks_per_task, self.whole_genome = path, table, blocks_per_task, whole_genome
        self.limits: dict[str, Limits] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column is not None and len(column) == 1 and value is not None and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.limits.setdefault(column[0], Limits()).narrow(f)
            yield f

    def admits(self, column: str, value) -> bool:
        return column not in self.limits or self.limits[column].admit(value)

    def _matrices(self) -> list[tuple[int, int, int, int]]:
        named = [(*map(int, key.split("_")), at, length) for key, at, length in container.matrices(self.path)]
        return [m for m in named if (m[0] > 0 or self.whole_genome) and self.admits("chr1", m[0]) and self.admits("chr2", m[1])]

    def partitions(self) -> list[InputPartition]:
        if self.table == "vectors":
            own = [e for e in container.vector_index(self.path) if self.admits("norm", e[0]) and self.admits("chr", e[1]) and self.admits("bin_size", e[2])]
            return [Share(entries=tuple(own[k : k + 16])) for k in range(0, len(own), 16)]
        if self.table == "matrices":
            return [Share(entries=tuple(self._matrices()))]
        out: list[InputPartition] = []
        for _, _, at, length in self._matrices():
            shares = 1 if self.table == "blocks" else min(MOST_TASKS, max(1, -(-length // (16 * self.blocks_per_task))))
            out += [Share(at, length, k, shares) for k in range(shares)]
        return out

    def chosen(self, part: Share) -> list[tuple[int, int, int, int, int, int]]:
        """chr1, chr2, bin size, number, position and size of the blocks of a share that filters leave."""
        base = int(container.read_header(self.path).attributes.get("v9BaseDepth", 2))
        one, two = (self.limits.get(c, Limits()) for c in ("bin1", "bin2"))
        found = []
        for c1, c2, size, side, columns, entries in container.zooms_of(container.read_meta(self.path, part.at, part.length)):
            if self.admits("bin_size", size):
                keep = may_hold(entries["number"].astype(np.int64), c1 == c2 and c1 > 0, side, columns, base, one, two)
                found += [(c1, c2, size, *e) for e in entries[keep].tolist()]
        found.sort(key=lambda e: e[4])
        return found[len(found) * part.share // part.shares : len(found) * (part.share + 1) // part.shares]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if self.table == "vectors":
            yield from container.load_vectors(self.path, partition.entries)
        elif self.table == "matrices":
            yield from (m for m in partition.entries)
        elif self.table == "blocks":
            yield from (e for e in self.chosen(partition) if self.admits("block_number", e[3]))
        else:
            yield from (cells for cells, _ in container.load_blocks(self.path, [(*e[:3], *e[4:]) for e in self.chosen(partition)]))


class ContactMatrix(DataSource):
    """``spark.read.format("contact_matrix").option("table", ...).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    @property
    def table(self) -> str:
        table = self.options.get("table", "cells")
        if table not in SCHEMAS:
            raise ValueError(f"no such table: {table!r}; there are {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self.table]

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.table, int(self.options.get("blocks_per_task", 512)), self.options.get("whole_genome", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Makes the data source known to a session, and lets Spark push filters to it."""
    ship(spark)
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(ContactMatrix)
