"""Contact matrices: cells at many resolutions, block numbers, the whole-genome matrix, and sums by matrix.

Contacts are aggregated once, at the finest resolution; a coarser one rolls up the
cells of the nearest finer resolution that divides it (the floor of a floor is the
floor of the product), so the contacts are shuffled once however many resolutions
there are. Groups are keyed by the full cell, never by the chromosome pair, so a
pair that holds most contacts spreads over all tasks.

``count`` adds all scores; ``pos_count`` those above 0, which the distance model uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.functions.blocks import bin_of, block_number, block_shape, div
from contactspark.genome import KB, Genome

RESOLUTIONS = (2_500_000, 1_000_000, 500_000, 250_000, 100_000, 50_000, 25_000, 10_000, 5_000, 1_000)
CELL = ["chr1", "chr2", "bin_size", "bin1", "bin2"]


def parse_resolutions(text: str) -> list[int]:
    """A comma list, coarsest first."""
    return sorted((int(x) for x in text.split(",") if x.strip()), reverse=True)


def cells(contacts: DataFrame, bin_size: int) -> DataFrame:
    """chr1, chr2, bin_size, bin1, bin2, count, pos_count of canonical contacts at one resolution."""
    score = F.col("score").cast("double")
    binned = contacts.select("chr1", "chr2", F.lit(bin_size).alias("bin_size"), bin_of(F.col("pos1"), bin_size).alias("bin1"), bin_of(F.col("pos2"), bin_size).alias("bin2"), score.alias("s"))
    return binned.groupBy(*CELL).agg(F.sum("s").alias("count"), F.sum(F.when(F.col("s") > 0, F.col("s")).otherwise(0.0)).alias("pos_count"))


def roll_up(finer: DataFrame, bin_size: int, factor: int) -> DataFrame:
    """Cells at ``bin_size`` from cells at a resolution that is ``factor`` times finer."""
    coarse = finer.select("chr1", "chr2", F.lit(bin_size).alias("bin_size"), bin_of(F.col("bin1"), factor).alias("bin1"), bin_of(F.col("bin2"), factor).alias("bin2"), "count", "pos_count")
    return coarse.groupBy(*CELL).agg(F.sum("count").alias("count"), F.sum("pos_count").alias("pos_count"))


def multi_resolution(contacts: DataFrame, resolutions: list[int], hold: Callable[[DataFrame], DataFrame] = lambda cells: cells) -> dict[int, DataFrame]:
    """Cells by resolution, each rolled up from the nearest finer one that divides it, where there is one. ``hold`` may store a resolution's cells before coarser ones are made of them."""
    made: dict[int, DataFrame] = {}
    for size in sorted(set(resolutions)):
        finer = [r for r in made if size % r == 0]
        made[size] = hold(roll_up(made[max(finer)], size, size // max(finer)) if finer else cells(contacts, size))
    return made


def union(by_size: dict[int, DataFrame]) -> DataFrame:
    frames = list(by_size.values())
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def with_blocks(cell_rows: DataFrame, genome: Genome, depth_base: int = 2, drop_shape: bool = True) -> DataFrame:
    """Cells with ``block_number`` (and, kept if asked, block_columns and block_bins)."""
    lengths = F.create_map(*[F.lit(x) for kv in genome.lengths().items() for x in kv])
    longer = F.greatest(F.try_element_at(lengths, F.col("chr1")), F.try_element_at(lengths, F.col("chr2")))
    intra = F.col("chr1") == F.col("chr2")
    columns, side = block_shape(longer, F.col("bin_size"), intra)
    shaped = cell_rows.withColumns({"block_columns": columns, "block_bins": side})
    numbered = shaped.withColumn("block_number", block_number(F.col("bin1"), F.col("bin2"), intra, F.col("block_columns"), F.col("block_bins"), depth_base))
    return numbered.drop("block_columns", "block_bins") if drop_shape else numbered


def zooms(cell_rows: DataFrame, genome: Genome) -> DataFrame:
    """A row for each matrix and resolution: sum_counts (cells off the diagonal of a chromosome count twice), block columns and bins, and cells."""
    twice = F.when((F.col("chr1") == F.col("chr2")) & (F.col("bin1") != F.col("bin2")), 2).otherwise(1)
    summed = cell_rows.groupBy("chr1", "chr2", "bin_size").agg(F.sum(F.col("count") * twice).alias("sum_counts"), F.count("*").alias("n_cells"))
    lengths = F.create_map(*[F.lit(x) for kv in genome.lengths().items() for x in kv])
    longer = F.greatest(F.try_element_at(lengths, F.col("chr1")), F.try_element_at(lengths, F.col("chr2")))
    columns, side = block_shape(longer, F.col("bin_size"), F.col("chr1") == F.col("chr2"))
    return summed.select("*", columns.alias("block_columns"), side.alias("block_bins"))


def whole_genome(contacts: DataFrame, genome: Genome) -> DataFrame:
    """bin1, bin2, count of the whole-genome matrix (0, 0): positions along all chromosomes, in kilobases."""
    before, offsets = 0, {}
    for i, n in genome.lengths().items():
        offsets[i] = before
        before += n
    table = F.create_map(*[F.lit(x).cast("bigint") if k else F.lit(x) for kv in offsets.items() for k, x in enumerate(kv)])
    place = [div(div(F.try_element_at(table, F.col(f"chr{e}")) + F.col(f"pos{e}"), KB), genome.whole_genome_bin).cast("int") for e in "12"]
    binned = contacts.select(F.least(*place).alias("bin1"), F.greatest(*place).alias("bin2"), F.col("score").cast("double").alias("s"))
    return binned.groupBy("bin1", "bin2").agg(F.sum("s").alias("count"))


def at_least(cell_rows: DataFrame, threshold: float) -> DataFrame:
    """Cells whose count reaches the threshold."""
    return cell_rows.where(F.col("count") >= threshold)
