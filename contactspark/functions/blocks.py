"""Binning and block numbers of contact matrices, for columns and, where a name ends in ``_of``, for numbers."""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below these bin sizes (within and between chromosomes) a block column spans base pairs instead of bins.
INTRA_CUTOFF, INTER_CUTOFF = 500, 5000
BLOCK_CAPACITY = 1000
#: Keeps block numbers within an int.
MOST_COLUMNS = 46_339


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient, towards zero."""
    return F.call_function("div", a.cast("bigint"), (F.lit(b) if isinstance(b, int) else b).cast("bigint"))


def bin_of(position: Column, bin_size: Column | int) -> Column:
    return div(position, bin_size).cast("int")


def block_shape_of(length: int, bin_size: int, intra: bool) -> tuple[int, int]:
    """Block columns, and bins to a block, of a matrix whose longer chromosome has this length."""
    bins = length // bin_size + 1
    cutoff = INTRA_CUTOFF if intra else INTER_CUTOFF
    spanned = bins * bin_size // (BLOCK_CAPACITY * cutoff) if bin_size < cutoff else bins // BLOCK_CAPACITY
    columns = min(spanned + 1, MOST_COLUMNS)
    return columns, bins // columns + 1


def block_shape(length: Column, bin_size: Column, intra: Column) -> tuple[Column, Column]:
    """``block_shape_of`` for columns."""
    bins = div(length, bin_size) + 1
    cutoff = F.when(intra, INTRA_CUTOFF).otherwise(INTER_CUTOFF)
    spanned = F.when(bin_size < cutoff, div(bins * bin_size, BLOCK_CAPACITY * cutoff)).otherwise(div(bins, BLOCK_CAPACITY))
    columns = F.least(spanned + 1, F.lit(MOST_COLUMNS))
    return columns.cast("int"), (div(bins, columns) + 1).cast("int")


def depth(x: Column, y: Column, side: Column, base: int = 2) -> Column:
    """How far off the diagonal a cell lies, in powers of ``base`` of its block's side."""
    return F.floor(F.log(1 + F.abs(x - y) / (F.lit(sqrt(2.0)) * side)) / F.lit(log(max(base, 2)))).cast("int")


def block_number(x: Column, y: Column, intra: Column, columns: Column, side: Column, base: int = 2) -> Column:
    """Blocks follow the diagonal within a chromosome and form a grid between two."""
    along = depth(x, y, side, base) * columns + div(div(x + y, 2), side)
    grid = columns * div(y, side) + div(x, side)
    return F.when(intra, along).otherwise(grid).cast("int")
