"""The engine's queries over the driver's tables, and the SQL that gives the same rows.

Contacts come from ``lineitem``: five chromosomes of 50 Mb, positions from its keys,
its quantity as MAPQ. A second set with fractional, partly negative scores comes
from ``events``. What iterates, smooths or writes files has no SQL.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactspark.functions.blocks import BLOCK_CAPACITY, INTER_CUTOFF, INTRA_CUTOFF, MOST_COLUMNS, block_shape, block_shape_of
from contactspark.genome import Genome
from contactspark.genome import genome as genome_from
from contactspark.operators import compare, contacts, expected, matrix, norms, region
from contactspark.operators.scale import ROW_TOLERANCE, distributed_multiply
from contactspark.plans import build
from contactspark.session import fresh_path, keep, ship
from contactspark.sources import binary, container, matrix_source, ranges, text

SIZE, MAPQ = 50_000_000, 10
GENOME = Genome(tuple((f"chr{i}", SIZE) for i in range(1, 6)), "five")
MB, RESOLUTIONS = 1_000_000, (100_000, 500_000, 1_000_000, 2_500_000)
BINS = norms.bins_of(GENOME, [MB])
#: Files that a table is dealt to hold about so many rows, and there are at least so many of them.
FILE_ROWS, FEWEST_FILES = 1_000_000, 6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(table: DataFrame) -> int:
    """To how many files a table is dealt: they follow its rows, so that no task reads more of a larger table."""
    return max(FEWEST_FILES, -(-table.count() // FILE_ROWS))


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read pairs made of ``lineitem``, in the schema of the readers."""
    t = _table(spark, sf_dir, "lineitem")
    mapq = F.col("l_quantity").cast("int")
    return t.select(
        (F.col("l_partkey") % 5 + 1).cast("int").alias("chr1"),
        ((F.col("l_partkey") * 1000003 + F.col("l_linenumber") * 7919) % SIZE).cast("int").alias("pos1"),
        F.lit(0).cast("byte").alias("strand1"),
        F.lit(0).alias("frag1"),
        mapq.alias("mapq1"),
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("chr2"),
        ((F.col("l_orderkey") * 999983 + F.col("l_linenumber") * 104729) % SIZE).cast("int").alias("pos2"),
        F.lit(0).cast("byte").alias("strand2"),
        F.lit(1).alias("frag2"),
        mapq.alias("mapq2"),
        F.lit(1.0).cast("float").alias("score"),
    )


def event_pairs(spark: SparkSession, sf_dir: str, less: int = 100) -> DataFrame:
    """Read pairs made of ``events``, with scores on both sides of 0 (or, with ``less`` = 0, above it)."""
    t = _table(spark, sf_dir, "events")
    ends = {"chr1": F.col("user_id") % 5 + 1, "pos1": (F.col("event_id") * 1000003) % SIZE, "chr2": F.col("event_id") % 5 + 1, "pos2": (F.col("user_id") * 999983 + F.col("event_id") * 7919) % SIZE}
    return t.select(*[v.cast("int").alias(k) for k, v in ends.items()], F.lit(1000).alias("mapq1"), F.lit(1000).alias("mapq2"), F.lit(0).alias("frag1"), F.lit(1).alias("frag2"), (F.col("value") - less).cast("double").alias("score"))


def _contacts(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    return contacts.contacts(raw_pairs(spark, sf_dir), GENOME, mapq=MAPQ, **filters)


def _cells(spark: SparkSession, sf_dir: str, size: int = MB) -> DataFrame:
    return matrix.cells(_contacts(spark, sf_dir), size)


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within chromosomes, stored: norms pass over them several times."""
    return keep(norms.intra(_cells(spark, sf_dir)))


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# --- queries ---------------------------------------------------------------


def contacts_filtered(spark, sf_dir):
    kept = raw_pairs(spark, sf_dir).where(~contacts.skipped(MAPQ))
    return kept.select("chr1", "pos1", "chr2", "pos2", "mapq1")


def canonical_pairs(spark, sf_dir):
    return _contacts(spark, sf_dir).drop("score")


def intra_only(spark, sf_dir):
    return _contacts(spark, sf_dir, intra_only=True).drop("score")


def near_diagonal(spark, sf_dir):
    return _contacts(spark, sf_dir, near_diagonal_only=True).drop("score")


def clamped_pairs(spark, sf_dir):
    short = Genome(tuple((f"chr{i}", 30_000_000) for i in range(1, 6)))
    return contacts.contacts(raw_pairs(spark, sf_dir), short, mapq=MAPQ).drop("score")


def read_skip_counts(spark, sf_dir):
    return contacts.counters(raw_pairs(spark, sf_dir), mapq=MAPQ, near_diagonal_only=True)


def mnd_lines(spark, sf_dir):
    """The pairs, written as lines of the MND layout with MAPQ and score, and parsed again."""
    p = raw_pairs(spark, sf_dir)
    lines = p.select(F.concat_ws(" ", "strand1", F.concat(F.lit("CHR"), "chr1"), "pos1", "frag1", "strand2", "chr2", "pos2", "frag2", "mapq1", "mapq2", F.lit("1.5")).alias("value"))
    parsed = text.known_chromosomes(text._mnd(text._fields(lines), False), GENOME)
    return parsed.select("chr1", "pos1", "chr2", "pos2", "mapq1", "frag2", F.col("score").cast("double").alias("score"))


PARSED = ["chr1", "pos1", "strand1", "frag1", "mapq1", "chr2", "pos2", "strand2", "frag2", "mapq2", "score"]


def _line_parts(spark, sf_dir) -> DataFrame:
    """What lines are made of: among good values, chromosomes that nobody knows and positions below 0, beyond an int, and with letters behind."""
    t = _table(spark, sf_dir, "lineitem")
    p1 = F.when(F.col("l_orderkey") % 11 == 0, "-7").when(F.col("l_orderkey") % 13 == 0, "12abc").when(F.col("l_orderkey") % 17 == 0, "3000000000").otherwise((F.col("l_orderkey") % 1000).cast("string"))
    name = F.when(F.col("l_linenumber") == 7, "chrUn").otherwise(F.concat(F.lit("CHR"), (F.col("l_partkey") % 5 + 1).cast("string")))
    return t.select(name.alias("n1"), p1.alias("p1"), (F.col("l_suppkey") % 5 + 1).cast("string").alias("n2"), (F.col("l_partkey") % 1000).cast("string").alias("p2"), F.col("l_quantity").cast("int").cast("string").alias("q"))


def _parsed(rows: DataFrame) -> DataFrame:
    return text.known_chromosomes(rows, GENOME).select(*PARSED[:-1], F.col("score").cast("double").alias("score"))


def _mnd_layout(*parts: str) -> Callable[[SparkSession, str], DataFrame]:
    """The parser of MND lines on lines of these columns (those of ``_line_parts``; others as they are)."""

    def layout(spark, sf_dir):
        p = _line_parts(spark, sf_dir)
        lines = p.select(F.concat_ws("\t", *[F.col(x) if x in p.columns else F.lit(x) for x in parts]).alias("value"))
        return _parsed(text._mnd(text._fields(lines), False))

    return layout


_EIGHT = ("0", "n1", "p1", "3", "1", "n2", "p2", "4")
MND_LAYOUTS = {
    "mnd_short8": _EIGHT,
    "mnd_short9": (*_EIGHT, "2.5x"),
    "mnd_old10": (*_EIGHT, "q", "33"),
    "mnd_medium11": ("read", *_EIGHT, "q", "33"),
    "mnd_long16": (*_EIGHT, "q", "10M", "ACGT", "33", "10M", "ACGT", "a", "b"),
}


def extra_short_lines(spark, sf_dir):
    p = _line_parts(spark, sf_dir)
    lines = p.select(F.concat_ws("  ", F.lit(""), "n1", "p1", "n2", "p2", F.lit("2.5e0")).alias("value"))
    return _parsed(text._short(text._fields(lines)))


def pairs_lines(spark, sf_dir):
    """.pairs lines under a header that has the optional columns in another order; every fifth line lacks the last of them."""
    p = _line_parts(spark, sf_dir)
    last = F.when(F.col("p2").endswith("5"), F.lit(None)).otherwise("8")
    lines = p.select(F.concat_ws("\t", F.lit("r"), "n1", "p1", "n2", "p2", F.lit("-"), F.lit("+"), F.lit("UU"), F.lit("33"), "q", F.lit("6"), last).alias("value"))
    return _parsed(text._pairs(lines, tuple("readID chr1 pos1 chr2 pos2 strand1 strand2 pair_type mapq2 mapq1 frag2 frag1".split())))


#: Hexadecimal records of a format, made of little-endian columns, and how many runs they are dealt into.
RECORD_LAYOUTS = {
    "bn": (lambda le: F.concat(le("c1"), le("p1"), le("c2"), le("p2"), F.lit("00002040")), 16),
    "bin": (lambda le: F.concat(F.lit("01"), le("c1"), le("p1"), F.lit("03000000"), F.lit("00"), le("c2"), le("p2"), F.lit("04000000")), 16),
}


def bn_records(spark, sf_dir):
    """Binary records with scores, made by expressions in runs and decoded."""
    return _records(spark, sf_dir, "bn")


def bin_records(spark, sf_dir):
    """Binary records with strands and fragments: 1.0 is the score that they get."""
    return _records(spark, sf_dir, "bin")


def _record_runs(spark, sf_dir, hexed, n_runs: int) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 5 + 1).alias("c1"), (F.col("l_orderkey") % 1000 - 5).alias("p1"), (F.col("l_suppkey") % 5 + 1).alias("c2"), (F.col("l_partkey") % 100_000).alias("p2"), (F.col("l_orderkey") % n_runs).alias("run"))
    digits = lambda c: F.lpad(F.hex(F.pmod(F.col(c), F.lit(1 << 32))), 8, "0")
    little = lambda c: F.concat(*[F.substring(digits(c), k, 2) for k in (7, 5, 3, 1)])
    return t.groupBy("run").agg(F.unhex(F.array_join(F.collect_list(hexed(little)), "")).alias("r"))


def _records(spark, sf_dir, fmt):
    runs = _record_runs(spark, sf_dir, RECORD_LAYOUTS[fmt][0], 512)
    return binary.read_runs(runs.select("r"), fmt, len(GENOME.chromosomes)).withColumn("score", F.col("score").cast("double"))


def cells_1mb(spark, sf_dir):
    return _long(_cells(spark, sf_dir), "count").select("chr1", "chr2", "bin1", "bin2", "count")


def cells_multires(spark, sf_dir):
    made = matrix.multi_resolution(_contacts(spark, sf_dir), list(RESOLUTIONS))
    return _long(matrix.union(made), "count").select("bin_size", "chr1", "chr2", "bin1", "bin2", "count")


def cells_threshold(spark, sf_dir):
    return _long(matrix.at_least(_cells(spark, sf_dir), 3), "count").select("chr1", "chr2", "bin1", "bin2", "count")


def _unsigned(x: Column) -> Column:
    """0 for -0, which a sum may round to."""
    return F.when(x == 0, 0.0).otherwise(x)


def event_cells(spark, sf_dir):
    own = matrix.cells(contacts.contacts(event_pairs(spark, sf_dir), GENOME), MB)
    return own.select("chr1", "chr2", "bin1", "bin2", _unsigned(F.round("count", 3)).alias("count"), F.round("pos_count", 3).alias("pos_count"))


def whole_genome_cells(spark, sf_dir):
    return _long(matrix.whole_genome(_contacts(spark, sf_dir), GENOME), "count").select("bin1", "bin2", "count")


def zoom_sum_counts(spark, sf_dir):
    return _long(matrix.zooms(_cells(spark, sf_dir), GENOME), "sum_counts", "n_cells").select("chr1", "chr2", "sum_counts", "n_cells", "block_columns", "block_bins")


def _blocks(spark, sf_dir, size):
    own = matrix.with_blocks(_cells(spark, sf_dir, size), GENOME)
    return own.select("chr1", "chr2", "bin1", "bin2", "block_number")


def block_intra(spark, sf_dir):
    return _blocks(spark, sf_dir, 10_000).where("chr1 = chr2")


def block_inter(spark, sf_dir):
    return _blocks(spark, sf_dir, 1_000).where("chr1 < chr2")


def block_params(spark, sf_dir):
    """Shapes of blocks for chromosomes as long as orders are dear, at bin sizes that follow their customers."""
    sizes = F.array(*[F.lit(r) for r in matrix.RESOLUTIONS])
    t = _table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 500).cast("bigint").alias("length"), F.get(sizes, (F.col("o_custkey") % len(matrix.RESOLUTIONS)).cast("int")).alias("bin_size"), (F.col("o_orderkey") % 2 == 0).alias("intra"))
    columns, side = block_shape(F.col("length"), F.col("bin_size"), F.col("intra"))
    return t.select("o_orderkey", "length", "bin_size", "intra", columns.alias("block_columns"), side.alias("block_bins"))


def chr_offsets(spark, sf_dir):
    """Offsets in a genome whose chromosomes are the nations, as long as their customers' balances."""
    held = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(F.floor(F.abs("c_acctbal"))).cast("bigint").alias("length")).orderBy("c_nationkey").collect()
    genome = Genome(tuple((f"n{r.c_nationkey}", r.length) for r in held))
    return genome.table(spark).select("name", "index", "length", "offset")


def distance_hist(spark, sf_dir):
    by_chr = expected.distances(_cells(spark, sf_dir))
    return _long(expected.histogram(by_chr, GENOME), "weight").select("dist", "weight")


def chr_totals(spark, sf_dir):
    return _long(expected.chromosome_totals(expected.distances(_cells(spark, sf_dir))), "total").select("chr", "total")


def event_distance_hist(spark, sf_dir):
    own = matrix.cells(contacts.contacts(event_pairs(spark, sf_dir), GENOME), MB)
    return expected.histogram(expected.distances(own), GENOME).select("dist", F.round("weight", 3).alias("weight"))


def possible_distances(spark, sf_dir):
    totals = expected.chromosome_totals(expected.distances(_cells(spark, sf_dir)))
    return expected.possible_distances(totals, GENOME).select("dist", F.col("possible").cast("bigint").alias("possible"))


def _model(spark, sf_dir, cells_=None):
    by_chr = keep(expected.distances(_cells(spark, sf_dir) if cells_ is None else cells_))
    totals = expected.chromosome_totals(by_chr)
    dense = expected.density(expected.histogram(by_chr, GENOME), expected.possible_distances(totals, GENOME), GENOME)
    return dense, expected.scale_factors(dense, totals, GENOME), totals


def expected_density(spark, sf_dir):
    return _model(spark, sf_dir)[0].select("dist", F.col("density").cast("double").alias("density"))


def chr_scale_factors(spark, sf_dir):
    return _model(spark, sf_dir)[1].select("chr", F.round(F.col("factor").cast("double"), 5).alias("factor"))


def _rounded(vector: DataFrame, own: DataFrame) -> DataFrame:
    full = norms.densify(vector, own, GENOME)
    return full.select("chr", "bin", F.round("value", 5).alias("value"))


def vc(spark, sf_dir):
    own = _own(spark, sf_dir)
    return _rounded(norms.coverage(own), own)


def vc_scaled(spark, sf_dir):
    own = _own(spark, sf_dir)
    return _rounded(norms.vc(own, BINS), own)


def vc_sqrt(spark, sf_dir):
    own = _own(spark, sf_dir)
    return _rounded(norms.vc_sqrt(own, BINS), own)


def norm_cells_vc(spark, sf_dir):
    own = _own(spark, sf_dir)
    return norms.normalised(own, norms.coverage(own), BINS).select("chr", "bin1", "bin2", F.round("value", 9).alias("value"))


def norm_distance_hist_vc(spark, sf_dir):
    own = _own(spark, sf_dir)
    met = norms.normalised(own, norms.coverage(own), BINS).select("bin_size", F.col("chr").alias("chr1"), F.col("chr").alias("chr2"), "bin1", "bin2", "value")
    by_chr = expected.distances(met, F.col("value"))
    return expected.histogram(by_chr, GENOME).select("dist", F.round("weight", 7).alias("weight"))


def row_nonzeros(spark, sf_dir):
    return norms.row_nonzeros(norms.intra(_cells(spark, sf_dir))).select("chr", "bin", "n")


def coverage_stats(spark, sf_dir):
    s = norms.coverage_stats(norms.intra(_cells(spark, sf_dir)))
    return s.select("chr", "n_rows", F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"), "fifth", "bound")


def _balanceable(spark, sf_dir):
    """Matrices of ``events``; those of ``lineitem`` have rows that only few others touch, which no factors make even."""
    own = matrix.cells(contacts.contacts(event_pairs(spark, sf_dir, 0), GENOME), 5 * MB)
    return keep(norms.intra(own))


def scale_vector(spark, sf_dir):
    v = norms.scaled(_balanceable(spark, sf_dir), GENOME, bins=BINS)
    return v.select("chr", "bin_size", "bin", F.when(~F.isnan("value"), F.round("value", 4)).alias("value"))


def scale_large(spark, sf_dir):
    """The same with the cells of all matrices spread over executors."""
    v = norms.scaled(_balanceable(spark, sf_dir), GENOME, group_cells=0, bins=BINS)
    return v.select("chr", "bin_size", "bin", F.when(~F.isnan("value"), F.round("value", 4)).alias("value"))


def scale_failures(spark, sf_dir):
    """Matrices of ``lineitem`` that can't be balanced."""
    own = _own(spark, sf_dir)
    return own.select("chr", "bin_size").distinct().join(norms.scaled(own, GENOME).select("chr", "bin_size").distinct(), ["chr", "bin_size"], "left_anti")


def scale_row_sum_error(spark, sf_dir):
    """How far the sum of any balanced row is from their mean at most, by chromosome, and whether that is within the row tolerance."""
    own = _balanceable(spark, sf_dir)
    met = norms.normalised(own, norms.scaled(own, GENOME, bins=BINS), BINS).drop("count").withColumnRenamed("value", "count")
    sums = norms.coverage(met.select("chr", "bin_size", "bin1", "bin2", "count"))
    off = F.greatest(F.max("value") / F.avg("value") - 1, 1 - F.min("value") / F.avg("value"))
    return sums.groupBy("chr").agg((off <= ROW_TOLERANCE).alias("even"), F.round(off, 6).alias("off"))


def norm_status(spark, sf_dir):
    """Which matrices have coverage vectors, in a genome with a chromosome that has no contacts."""
    more = Genome((*GENOME.chromosomes, ("chr6", SIZE)), "six")
    cells_ = keep(_cells(spark, sf_dir))
    made = norms.vectors(cells_, more, ("VC", "VC_SQRT"), BINS)
    return norms.status(cells_, made, more, [MB], ("VC", "VC_SQRT"))


def _sorted_file(spark, sf_dir) -> DataFrame:
    """The contacts as lines of files, in order of their positions, read back with where they stood."""
    order = ("pos1", "pos2", "chr1", "chr2")
    p = _contacts(spark, sf_dir).repartitionByRange(_files(_table(spark, sf_dir, "lineitem")), *order).sortWithinPartitions(*order)
    folder = fresh_path(spark, "sorted")
    p.select(F.concat_ws(" ", "chr1", "pos1", "chr2", "pos2").alias("value")).write.text(folder)
    return text.read_pairs(spark, folder, GENOME, "short", ordinal=True)


def contiguity_violations(spark, sf_dir):
    """Chromosome pairs that appear in several runs of the lines of files."""
    found = contacts.scattered_groups(_sorted_file(spark, sf_dir))
    return found.select("chr1", "chr2", F.col("n_runs").cast("bigint").alias("n_runs"))


REGION = ((1, 5_000_000, 25_000_000), (1, 10_000_000, 40_000_000))
BETWEEN = ((4, 0, 20_000_000), (2, 10_000_000, 30_000_000))


def region_observed(spark, sf_dir):
    return region.query(_cells(spark, sf_dir), *REGION, MB).select("x", "y", F.col("value").cast("double").alias("value"))


def region_between(spark, sf_dir):
    return region.query(_cells(spark, sf_dir), *BETWEEN, MB).select("x", "y", F.col("value").cast("double").alias("value"))


def region_vc(spark, sf_dir):
    """The vector is of the region's chromosome alone, so that no other contact is read further than its chromosome."""
    cells_ = keep(matrix.cells(_contacts(spark, sf_dir).where((F.col("chr1") == REGION[0][0]) & (F.col("chr2") == REGION[0][0])), MB))
    picked = region.select(cells_, *REGION, MB)
    own = picked.select(F.col("chr1").alias("chr"), "bin_size", "bin1", "bin2", "count")
    met = norms.normalised(own, norms.coverage(norms.intra(cells_)), BINS)
    return met.select((F.col("bin1") * MB).alias("x"), (F.col("bin2") * MB).alias("y"), F.round("value", 9).alias("value"))


def region_oe(spark, sf_dir):
    cells_ = keep(_cells(spark, sf_dir))
    dense, factors, _ = _model(spark, sf_dir, cells_)
    out = region.query(cells_, *REGION, MB, density=keep(dense), factors=factors)
    return out.select("x", "y", F.round(F.col("value").cast("double"), 4).alias("value"))


def region_oe_between(spark, sf_dir):
    """A region between two chromosomes over what their mean makes expected."""
    cells_ = keep(_cells(spark, sf_dir))
    dense, factors, _ = _model(spark, sf_dir, cells_)
    out = region.query(cells_, *BETWEEN, MB, density=dense, factors=factors, between=expected.between(cells_, GENOME))
    return out.select("x", "y", F.round(F.col("value").cast("double"), 4).alias("value"))


def _cases(t: DataFrame, key: str, other: str, wide: int) -> DataFrame:
    """Region pairs made of two keys of a table."""
    k, o = F.col(key), F.col(other)
    starts = {"1": (k * 7919) % (SIZE - 10 * MB), "2": (o * 104729) % (SIZE - 10 * MB)}
    ends = [x for e, start in starts.items() for x in (start.alias(f"start{e}"), (start + wide + (o % 4) * MB).alias(f"end{e}"))]
    return t.select(k.cast("string").alias("case"), F.lit(MB).alias("bin_size"), (o % 5 + 1).cast("int").alias("chr1"), (k % 5 + 1).cast("int").alias("chr2"), *ends, F.when(k % 2 == 0, "VC").otherwise("NONE").alias("norm"), ((k % 2 == 0) | (k % 3 != 0)).alias("observed"))


def regions_many(spark, sf_dir):
    """A region pair of each order: observed, normalised or over expected, all in one pass over the cells."""
    cells_ = keep(_cells(spark, sf_dir))
    dense, factors, _ = _model(spark, sf_dir, cells_)
    own = norms.intra(cells_)
    vectors = keep(norms.densify(norms.coverage(own), own, GENOME).withColumn("norm", F.lit("VC")))
    cases = _cases(_table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", 2 * MB)
    out = region.query_many(cells_, cases, vectors, keep(dense), factors, expected.between(cells_, GENOME))
    value = F.col("value").cast("double")
    return out.select(F.col("case").cast("bigint").alias("case_id"), "x", "y", F.when(F.col("case").cast("bigint") % 2 == 0, F.round(value, 12)).otherwise(F.round(value, 4)).alias("value"))


def regions_compare(spark, sf_dir):
    """A region pair of each supplier, answered from two stores that differ in their least MAPQ, and how the results compare."""
    strict = matrix.cells(contacts.contacts(raw_pairs(spark, sf_dir), GENOME, mapq=20), MB)
    suppliers = _table(spark, sf_dir, "supplier").withColumn("other", F.call_function("div", "s_suppkey", F.lit(3)))
    cases = keep(_cases(suppliers, "s_suppkey", "other", 4 * MB).withColumns({"norm": F.lit("NONE"), "observed": F.lit(True)}))
    left, right = (region.query_many(df, cases) for df in (_cells(spark, sf_dir), strict))
    told = compare.compare_results(left, right, ["case"])
    numbers = [F.round(F.nanvl(F.coalesce(c, F.lit(-2.0)), F.lit(-2.0)), 9).alias(c) for c in ("pearson", "median_ratio", "median_relative_error", "max_relative_error")]
    return told.select(F.col("case").cast("bigint").alias("case_id"), "rows_left", "rows_right", "coordinates_equal", "exact_values_equal", F.coalesce("common_positive_finite", F.lit(0)).alias("common_positive_finite"), *numbers)


def dump_lines(spark, sf_dir):
    """Lines of a dump: normalised values of a region in twelve significant digits."""
    met = region_vc(spark, sf_dir)
    return met.select("x", "y", region.shortest(F.col("value") * 1000).alias("value"))


def _two_results(spark, sf_dir):
    own = region.query(_cells(spark, sf_dir), *REGION, MB)
    strict = matrix.cells(contacts.contacts(raw_pairs(spark, sf_dir), GENOME, mapq=20), MB)
    return own, region.query(strict, *REGION, MB)


def compare_metrics(spark, sf_dir):
    s = compare.compare_dumps(*_two_results(spark, sf_dir))
    return s.select("rows_left", "rows_right", "coordinates_equal", "exact_values_equal", "common_positive_finite", *[F.round(c, 9).alias(c) for c in ("pearson", "median_ratio", "median_relative_error", "max_relative_error")])


def key_set_diff(spark, sf_dir):
    left, right = _two_results(spark, sf_dir)
    return compare.key_sets(left, right, ["x", "y"])


def duplicate_keys(spark, sf_dir):
    own = _contacts(spark, sf_dir)
    return compare.duplicate_keys(own, ["chr1", "chr2", "pos1"]).select("chr1", "chr2", "pos1", "n")


def first_appearance(spark, sf_dir):
    """Chromosome pairs in the order in which the lines of files first have them."""
    return contacts.first_appearance(_sorted_file(spark, sf_dir))


# files: lines or records are written to the shared folder and read as a user's files are


def _mounted(spark, name: str) -> str:
    """A new folder below the shared one, as a plain path."""
    path = ranges.local(fresh_path(spark, name))
    Path(path).mkdir(parents=True, exist_ok=True)
    return path


def _mnd_file(spark, sf_dir) -> DataFrame:
    """Lines of eight columns, and among them comments, blank lines and lines with too few fields."""
    p = _line_parts(spark, sf_dir)
    good = F.concat_ws("\t", *[F.col(x) if x in p.columns else F.lit(x) for x in _EIGHT])
    return p.select(F.explode(F.when(F.col("q") == "1", F.array(F.lit("# note"), F.lit(""), good, F.lit("0 chr1 5 0 1 chr2 7"), F.lit("   "))).otherwise(F.array(good))).alias("value"))


def file_mnd(spark, sf_dir):
    """A folder of text whose format its name gives."""
    folder = fresh_path(spark, "lines") + ".mnd"
    _mnd_file(spark, sf_dir).write.text(folder)
    return text.read_pairs(spark, folder, GENOME).withColumn("score", F.col("score").cast("double"))


def file_gzip(spark, sf_dir):
    """The same in block gzip, read in byte ranges that cut blocks and lines."""
    folder = _mounted(spark, "lines") + ".mnd.gz"
    Path(folder).mkdir()
    ranges.write_lines(_mnd_file(spark, sf_dir), folder)
    return text.read_pairs(spark, folder, GENOME).withColumn("score", F.col("score").cast("double"))


def file_short(spark, sf_dir):
    """A folder of text whose format its first line gives."""
    folder = fresh_path(spark, "lines")
    p = _line_parts(spark, sf_dir)
    p.select(F.concat_ws(" ", "n1", "p1", "n2", "p2", F.lit("2.5")).alias("value")).write.text(folder)
    return text.read_pairs(spark, folder, GENOME).withColumn("score", F.col("score").cast("double"))


def file_pairs(spark, sf_dir):
    """.pairs files, each with a header of its own."""
    folder = fresh_path(spark, "lines") + ".pairs"
    p = _line_parts(spark, sf_dir)
    line = F.concat_ws("\t", F.lit("r"), "n1", "p1", "n2", "p2", F.lit("-"), F.lit("+"), F.lit("UU"), F.lit("33"), "q", F.lit("6"), F.lit("8"))
    head = [F.lit("## pairs format v1.0"), F.lit("#columns: readID chr1 pos1 chr2 pos2 strand1 strand2 pair_type mapq2 mapq1 frag2 frag1")]
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # of a task, which writes a file
    p.select(line.alias("line"), first.alias("first")).select(F.explode(F.when(F.col("first"), F.array(*head, "line")).otherwise(F.array("line"))).alias("value")).write.text(folder)
    return text.read_pairs(spark, folder, GENOME).withColumn("score", F.col("score").cast("double"))


def _record_file(spark, sf_dir, fmt: str) -> DataFrame:
    """Runs of records, each a file of the folder, read in byte ranges."""
    folder = _mounted(spark, fmt)
    ship(spark)

    def write(batches):
        for batch in batches:
            for run, raw in zip(batch.column("run").to_pylist(), batch.column("r"), strict=True):
                Path(folder, f"{run}.{fmt}").write_bytes(raw.as_py())
            yield batch.select(["run"])

    _record_runs(spark, sf_dir, *RECORD_LAYOUTS[fmt]).mapInArrow(write, "run bigint").count()
    return text.read_pairs(spark, f"{folder}/*.{fmt}", GENOME).withColumn("score", F.col("score").cast("double"))


def file_bn(spark, sf_dir):
    return _record_file(spark, sf_dir, "bn")


def file_bin(spark, sf_dir):
    return _record_file(spark, sf_dir, "bin")


def streaming_cells(spark, sf_dir):
    from contactspark.streaming import cells as stream

    folder = fresh_path(spark, "stream")
    out = stream.run_once(spark, sf_dir, "lineitem.parquet", folder, lambda df: _from_lineitem(df), MB)
    return _long(out, "count").select("chr1", "chr2", "bin1", "bin2", "count")


def streaming_batches(spark, sf_dir):
    """The same from files, six or more, that arrive in three batches."""
    from contactspark.streaming import cells as stream

    folder, files = fresh_path(spark, "stream"), fresh_path(spark, "arriving")
    t = _table(spark, sf_dir, "lineitem")
    n = _files(t)
    t.repartition(n, "l_orderkey").write.parquet(files)
    out = stream.run_once(spark, files, "*.parquet", folder, _from_lineitem, MB, files_together=-(-n // 3))
    return _long(out, "count").select("chr1", "chr2", "bin1", "bin2", "count")


def _from_lineitem(df: DataFrame) -> DataFrame:
    mapq = F.col("l_quantity").cast("int")
    p = df.select(
        (F.col("l_partkey") % 5 + 1).cast("int").alias("chr1"),
        ((F.col("l_partkey") * 1000003 + F.col("l_linenumber") * 7919) % SIZE).cast("int").alias("pos1"),
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("chr2"),
        ((F.col("l_orderkey") * 999983 + F.col("l_linenumber") * 104729) % SIZE).cast("int").alias("pos2"),
        mapq.alias("mapq1"), mapq.alias("mapq2"), F.lit(0).alias("frag1"), F.lit(1).alias("frag2"), F.lit(1.0).cast("float").alias("score"),
    )
    return contacts.contacts(p, GENOME, mapq=MAPQ)


def _container(spark, sf_dir, **kept) -> str:
    """A container with cells at two resolutions, and what else is given."""
    own = matrix.union(matrix.multi_resolution(_contacts(spark, sf_dir), [500_000, 1_000_000]))
    path = f"{_mounted(spark, 'matrix')}/m.hic"
    container.write(spark, path, GENOME, own, **kept)
    matrix_source.register(spark)
    return path


def _source(spark, path: str, table: str = "cells") -> DataFrame:
    return spark.read.format(matrix_source.NAME).option("table", table).load(path)


def v9_roundtrip(spark, sf_dir):
    """Cells at two resolutions, written to a container and read again."""
    return _long(_source(spark, _container(spark, sf_dir)), "count").select("bin_size", "chr1", "chr2", "bin1", "bin2", "count")


def v9_pruned(spark, sf_dir):
    """A part of a container, of which filters leave few blocks to read."""
    found = _source(spark, _container(spark, sf_dir)).where("bin_size = 500000 and chr1 = 2 and chr2 in (2, 3) and bin1 between 10 and 60 and bin2 >= 20 and bin2 < 80")
    return _long(found, "count").select("chr1", "chr2", "bin1", "bin2", "count")


def v9_blocks(spark, sf_dir):
    """The index: which blocks each matrix has."""
    return _source(spark, _container(spark, sf_dir), "blocks").select("bin_size", "chr1", "chr2", "block_number")


def v9_vectors(spark, sf_dir):
    """Coverage vectors, written to a container and read again."""
    own = _own(spark, sf_dir)
    full = norms.densify(norms.coverage(own), own, GENOME).select(F.lit("VC").alias("norm"), "chr", "bin_size", "bin", F.col("value").cast("float").alias("value"))
    read = _source(spark, _container(spark, sf_dir, vectors=keep(full)), "vectors").where("norm = 'VC'")
    return read.select("chr", "bin", F.col("value").cast("double").alias("value"))


def v9_damaged(spark, sf_dir):
    """What becomes of each matrix where a container is normalised in place that has a damaged block."""
    path = _container(spark, sf_dir)
    bad = container.read_index(spark, path).where("chr1 = 3 and chr2 = 3 and bin_size = 500000").orderBy("block_number").first()
    with open(path, "r+b") as f:
        f.seek(bad.position)
        f.write(b"\xff" * bad["size"])
    return build.normalise_container(spark, path, ("VC", "VC_SQRT"))


def v9_matrices(spark, sf_dir):
    """Which matrices a container has."""
    return _source(spark, _container(spark, sf_dir), "matrices").select("chr1", "chr2")


def v9_kept(spark, sf_dir):
    """The cells of a container that was normalised in place: all that stands before the vectors is kept."""
    path = _container(spark, sf_dir)
    build.normalise_container(spark, path, ("VC",))
    return _long(container.read_cells(spark, path), "count").select("bin_size", "chr1", "chr2", "bin1", "bin2", "count")


def v9_expected(spark, sf_dir):
    """Expected values, written to a container and read again, by distance, with each chromosome's factor."""
    dense, factors, _ = _model(spark, sf_dir)
    raw = [df.withColumn("norm", F.lit("NONE")) for df in (keep(dense), factors)]
    path = _container(spark, sf_dir, expected=build.expected_vectors(*raw))
    (e,) = container.read_expected(path)
    rows = [(d, float(v), c, round(float(f), 5)) for d, v in enumerate(e.values) for c, f in e.factors.items()]
    return spark.createDataFrame(rows, "dist int, density double, chr int, factor double")


def v9_inspect(spark, sf_dir):
    """What a container says of itself after all checks."""
    own = _own(spark, sf_dir)
    full = norms.densify(norms.coverage(own), own, GENOME).select(F.lit("VC").alias("norm"), "chr", "bin_size", "bin", F.col("value").cast("float").alias("value"))
    told = container.inspect(_container(spark, sf_dir, vectors=keep(full), scaling_factor=2.0))
    row = (told["version"], told["genome"], len(told["chromosomes"]), ",".join(map(str, told["resolutions"])), told["matrices"], told["vectors"], told["attributes"]["hicFileScaling"])
    return spark.createDataFrame([row], "version int, genome string, n_chromosomes int, resolutions string, n_matrices int, n_vectors int, scaling string")


def dense_blocks(spark, sf_dir):
    """Blocks in the dense representation (whole numbers, gaps marked), made of the cells and decoded."""
    ship(spark)
    own = matrix.with_blocks(_cells(spark, sf_dir), GENOME)

    def through(part: pd.DataFrame) -> pd.DataFrame:
        x, y, n = (part[c].to_numpy() for c in ("bin1", "bin2", "count"))
        x0, y0 = int(x.min()), int(y.min())
        width, height = int(x.max()) - x0 + 1, int(y.max()) - y0 + 1
        grid = np.full((height, width), container.MISSING, dtype="<i2")
        grid[y - y0, x - x0] = n
        raw = struct.pack("<iii4B", len(part), x0, y0, 0, 0, 0, 2) + struct.pack("<ih", grid.size, width) + grid.tobytes()
        x, y, n = container.decode_block(raw)
        return pd.DataFrame({"chr1": part["chr1"].iat[0], "chr2": part["chr2"].iat[0], "bin1": x.astype("int32"), "bin2": y.astype("int32"), "count": n.astype("int64")})

    return own.groupBy("chr1", "chr2", "block_number").applyInPandas(through, "chr1 int, chr2 int, bin1 int, bin2 int, count bigint")


def dump_read(spark, sf_dir):
    """A region's result, written as a dump and read again."""
    folder = fresh_path(spark, "dump")
    region.write_dump(region.query(_cells(spark, sf_dir), *REGION, MB), folder)
    return region.read_dump(spark, folder).withColumn("value", F.col("value").cast("double"))


def file_md5(spark, sf_dir):
    """Digests of files, one for each region, with the names of its nations."""
    folder = _mounted(spark, "named")
    t = _table(spark, sf_dir, "nation").repartition(1).sortWithinPartitions("n_regionkey", "n_nationkey")
    t.select(F.col("n_name").alias("value"), "n_regionkey").write.mode("append").partitionBy("n_regionkey").text(folder)
    found = compare.fingerprint(spark, f"{folder}/*/*.txt")
    return found.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("n_regionkey"), "md5")


def file_sizes(spark, sf_dir):
    """A chrom.sizes file with a chromosome for each customer, comments and lines that can't be read."""
    folder = fresh_path(spark, "sizes")
    t = _table(spark, sf_dir, "customer").repartition(1).sortWithinPartitions("c_custkey")
    line = F.concat_ws("\t", F.concat(F.lit("C"), "c_custkey"), F.floor(F.abs("c_acctbal")).cast("string"))
    bad = F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit("# note"), F.lit("name only"), F.lit(""), line)).otherwise(F.array(line))
    t.select(F.explode(bad).alias("value")).write.text(folder)
    return genome_from(spark, folder).table(spark).select("index", "name", "length", "offset")


def same_fragment(spark, sf_dir):
    """Contacts without those whose ends share a fragment."""
    cut = raw_pairs(spark, sf_dir).withColumns({"frag1": (F.col("pos1") % 3).cast("int"), "frag2": (F.col("pos2") % 3).cast("int")})
    return contacts.contacts(cut, GENOME, mapq=MAPQ, drop_same_fragment=True).drop("score")


def spread_product(spark, sf_dir):
    """The product of each chromosome's matrix, its cells spread over executors, with the vector of its bins' numbers."""
    own = _own(spark, sf_dir)
    sizes = {(c, MB): n // MB + 1 for c, n in GENOME.lengths().items()}
    multiply, done = distributed_multiply(own, sizes)
    try:
        products = multiply({key: np.arange(1.0, n + 1) for key, n in sizes.items()})
    finally:
        done()
    rows = [(c, b, float(v)) for (c, _), product in products.items() for b, v in enumerate(product)]
    return spark.createDataFrame(rows, "chr int, bin int, value double")


def _event_store(spark, sf_dir) -> build.Store:
    return build.build(event_pairs(spark, sf_dir, 0), GENOME, [MB, 5 * MB], depth_base=5)


def build_cells(spark, sf_dir):
    """The cells of a store that ``build`` makes, with blocks by depths in powers of 5."""
    store = build.build(raw_pairs(spark, sf_dir), GENOME, [10_000, MB], mapq=MAPQ, intra_only=True, depth_base=5)
    return _long(store.cells, "count").select("bin_size", "chr1", "chr2", "bin1", "bin2", "count", "block_number")


def scale_gate(spark, sf_dir):
    """What becomes of each matrix of a store where SCALE is asked for from 5 Mb on."""
    return build.normalise(_event_store(spark, sf_dir), ("VC", "SCALE"), min_scale_res=5 * MB).status


def regions_report(spark, sf_dir):
    """A generated set of cases run on two stores: their dumps, and the report that is read back."""
    left, right = (build.build(raw_pairs(spark, sf_dir), GENOME, [MB], mapq=q) for q in (MAPQ, 20))
    report = build.run_cases(left, right, region.random_cases(GENOME, [MB], ("NONE",), pairs=6), fresh_path(spark, "run"))
    numbers = [F.round(F.coalesce(c, F.lit(-2.0)), 9).alias(c) for c in ("pearson", "median_ratio")]
    return report.where("case like '%_observed_%'").select("case", "rows_left", "rows_right", "coordinates_equal", "exact_values_equal", "common_positive_finite", *numbers)


# --- SQL -------------------------------------------------------------------

_PAIRS = f"""
raw AS (SELECT CAST(l_partkey % 5 + 1 AS INT) AS chr1, CAST((l_partkey * 1000003 + l_linenumber * 7919) % {SIZE} AS INT) AS pos1,
  CAST(l_suppkey % 5 + 1 AS INT) AS chr2, CAST((l_orderkey * 999983 + l_linenumber * 104729) % {SIZE} AS INT) AS pos2, CAST(l_quantity AS INT) AS mapq1 FROM lineitem),
good AS (SELECT * FROM raw WHERE mapq1 >= {MAPQ}),
c AS (SELECT least(chr1, chr2) AS chr1, greatest(chr1, chr2) AS chr2,
  CASE WHEN (chr1, pos1) <= (chr2, pos2) THEN pos1 ELSE pos2 END AS pos1, CASE WHEN (chr1, pos1) <= (chr2, pos2) THEN pos2 ELSE pos1 END AS pos2, mapq1 FROM good)"""
_CELLS = _PAIRS + f""",
cells AS (SELECT chr1, chr2, pos1 // {MB} AS bin1, pos2 // {MB} AS bin2, count(*)::BIGINT AS n FROM c GROUP BY ALL)"""
_INTRA = _CELLS + """,
own AS (SELECT chr1 AS chr, bin1, bin2, n FROM cells WHERE chr1 = chr2),
ways AS (SELECT chr, bin1 AS bin, n FROM own UNION ALL SELECT chr, bin2, n FROM own WHERE bin1 <> bin2),
cov AS (SELECT chr, bin, sum(n)::DOUBLE AS v FROM ways GROUP BY ALL)"""
_BINS = f"bins AS (SELECT chr, unnest(range(0, {SIZE // MB + 1}))::INT AS bin FROM (SELECT DISTINCT chr FROM own))"


def _scaled_sql(value: str) -> str:
    return f"""WITH {_INTRA}, v AS (SELECT chr, bin, {value} AS v FROM cov),
f AS (SELECT o.chr, CAST(sqrt(sum(m * n / (a.v * b.v)) / sum(m * n)) AS FLOAT) AS f FROM (SELECT *, CASE WHEN bin1 = bin2 THEN 1 ELSE 2 END AS m FROM own) o
  JOIN v a ON a.chr = o.chr AND a.bin = bin1 JOIN v b ON b.chr = o.chr AND b.bin = bin2 GROUP BY o.chr), {_BINS}
SELECT bins.chr, bins.bin, round(coalesce(v.v * f.f, 0), 5) AS value FROM bins LEFT JOIN v ON v.chr = bins.chr AND v.bin = bins.bin LEFT JOIN f ON f.chr = bins.chr"""


_REGION = f"chr1 = 1 AND chr2 = 1 AND ((bin1 BETWEEN {5_000_000 // MB} AND {25_000_000 // MB} AND bin2 BETWEEN {10_000_000 // MB} AND {40_000_000 // MB}) OR (bin1 BETWEEN {10_000_000 // MB} AND {40_000_000 // MB} AND bin2 BETWEEN {5_000_000 // MB} AND {25_000_000 // MB}))"
_TWO = _PAIRS + f""",
l AS (SELECT pos1 // {MB} * {MB} AS x, pos2 // {MB} * {MB} AS y, count(*)::DOUBLE AS a FROM (SELECT *, pos1 // {MB} AS bin1, pos2 // {MB} AS bin2 FROM c) WHERE {_REGION} GROUP BY ALL),
r AS (SELECT pos1 // {MB} * {MB} AS x, pos2 // {MB} * {MB} AS y, count(*)::DOUBLE AS b FROM (SELECT *, pos1 // {MB} AS bin1, pos2 // {MB} AS bin2 FROM c WHERE mapq1 >= 20) WHERE {_REGION} GROUP BY ALL),
two AS (SELECT coalesce(l.x, r.x) AS x, coalesce(l.y, r.y) AS y, a, b FROM l FULL JOIN r ON l.x = r.x AND l.y = r.y)"""
_EVENTS = f"""
raw AS (SELECT CAST(user_id % 5 + 1 AS INT) AS chr1, CAST((event_id * 1000003) % {SIZE} AS INT) AS pos1, CAST(event_id % 5 + 1 AS INT) AS chr2,
  CAST((user_id * 999983 + event_id * 7919) % {SIZE} AS INT) AS pos2, value - 100 AS s FROM events),
c AS (SELECT least(chr1, chr2) AS chr1, greatest(chr1, chr2) AS chr2, CASE WHEN (chr1, pos1) <= (chr2, pos2) THEN pos1 ELSE pos2 END AS pos1,
  CASE WHEN (chr1, pos1) <= (chr2, pos2) THEN pos2 ELSE pos1 END AS pos2, s FROM raw)"""


def _cases_sql(table: str, key: str, other: str, wide: int) -> str:
    """Region pairs in bins, chromosomes in order."""
    return f"""asked AS (SELECT {key} AS k, {other} AS o FROM {table}),
e AS (SELECT k, (o % 5 + 1)::INT AS ca, (k % 5 + 1)::INT AS cb, (k * 7919) % {SIZE - 10 * MB} AS sa, (o * 104729) % {SIZE - 10 * MB} AS sb, {wide} + (o % 4) * {MB} AS w FROM asked),
cases AS (SELECT k, least(ca, cb) AS q1, greatest(ca, cb) AS q2, CASE WHEN ca <= cb THEN sa ELSE sb END // {MB} AS f1, CASE WHEN ca <= cb THEN sb ELSE sa END // {MB} AS f2,
  (CASE WHEN ca <= cb THEN sa ELSE sb END + w) // {MB} AS l1, (CASE WHEN ca <= cb THEN sb ELSE sa END + w) // {MB} AS l2 FROM e)"""


_HIT = "chr1 = q1 AND chr2 = q2 AND ((bin1 BETWEEN f1 AND l1 AND bin2 BETWEEN f2 AND l2) OR (chr1 = chr2 AND bin1 BETWEEN f2 AND l2 AND bin2 BETWEEN f1 AND l1))"
def _blocks_sql(size: int, intra: bool, base: int = 2) -> str:
    columns, side = block_shape_of(SIZE, size, intra)
    if intra:
        number = f"CAST(floor(ln(1 + abs(bin1 - bin2) / (sqrt(2.0) * {side})) / ln({base}.0)) AS INT) * {columns} + ((bin1 + bin2) // 2) // {side}"
    else:
        number = f"{columns} * (bin2 // {side}) + bin1 // {side}"
    return f"""WITH {_PAIRS}, b AS (SELECT chr1, chr2, pos1 // {size} AS bin1, pos2 // {size} AS bin2, count(*)::BIGINT AS count FROM c WHERE chr1 {'=' if intra else '<'} chr2 GROUP BY ALL)
SELECT chr1, chr2, bin1, bin2, CAST({number} AS INT) AS block_number{', count' if base != 2 else ''} FROM b"""


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) t({names})"


def _shapes_sql() -> str:
    sizes = ", ".join(map(str, matrix.RESOLUTIONS))
    return f"""WITH t AS (SELECT o_orderkey, floor(o_totalprice * 500)::BIGINT AS length, [{sizes}][(o_custkey % {len(matrix.RESOLUTIONS)})::INT + 1]::INT AS bin_size, o_orderkey % 2 = 0 AS intra FROM orders),
n AS (SELECT *, length // bin_size + 1 AS bins, CASE WHEN intra THEN {INTRA_CUTOFF} ELSE {INTER_CUTOFF} END AS cutoff FROM t),
c AS (SELECT *, least(CASE WHEN bin_size < cutoff THEN bins * bin_size // ({BLOCK_CAPACITY} * cutoff) ELSE bins // {BLOCK_CAPACITY} END + 1, {MOST_COLUMNS}) AS columns FROM n)
SELECT o_orderkey, length, bin_size, intra, columns::INT AS block_columns, (bins // columns + 1)::INT AS block_bins FROM c"""


def _lines_sql(strand: tuple[int, int], frag: tuple[str, str], mapq: tuple[str, str], score: float) -> str:
    """What the readers make of ``_line_parts``."""
    at = "CAST(CASE WHEN l_orderkey % 11 = 0 THEN 0 WHEN l_orderkey % 13 = 0 THEN 12 WHEN l_orderkey % 17 = 0 THEN 2147483647 ELSE l_orderkey % 1000 END AS INT)"
    return f"""SELECT CAST(l_partkey % 5 + 1 AS INT) AS chr1, {at} AS pos1, CAST({strand[0]} AS TINYINT) AS strand1, CAST({frag[0]} AS INT) AS frag1, CAST({mapq[0]} AS INT) AS mapq1,
  CAST(l_suppkey % 5 + 1 AS INT) AS chr2, CAST(l_partkey % 1000 AS INT) AS pos2, CAST({strand[1]} AS TINYINT) AS strand2, CAST({frag[1]} AS INT) AS frag2, CAST({mapq[1]} AS INT) AS mapq2,
  CAST({score} AS DOUBLE) AS score FROM lineitem WHERE l_linenumber <> 7"""


def _records_sql(strand: tuple[int, int], frag: tuple[int, int], score: float) -> str:
    return f"""SELECT CAST(l_partkey % 5 + 1 AS INT) AS chr1, CAST(l_orderkey % 1000 - 5 AS INT) AS pos1, CAST({strand[0]} AS TINYINT) AS strand1, CAST({frag[0]} AS INT) AS frag1, CAST(1000 AS INT) AS mapq1,
  CAST(l_suppkey % 5 + 1 AS INT) AS chr2, CAST(l_partkey % 100000 AS INT) AS pos2, CAST({strand[1]} AS TINYINT) AS strand2, CAST({frag[1]} AS INT) AS frag2, CAST(1000 AS INT) AS mapq2, CAST({score} AS DOUBLE) AS score FROM lineitem"""


#: The smoothing one step to a row: it widens (kind 1) or narrows (kind 2) the window low to high until that holds enough, then gives a density and moves on.
_DENSITY = _CELLS + f""",
w AS (SELECT abs(bin1 - bin2) AS d, sum(n)::DOUBLE AS x FROM cells WHERE chr1 = chr2 GROUP BY 1),
k AS (SELECT count(DISTINCT chr1)::DOUBLE AS k FROM cells WHERE chr1 = chr2),
arrays AS (SELECT list(coalesce(x, 0) ORDER BY r.d) AS a, list(k * greatest({SIZE // MB} - r.d, 0) ORDER BY r.d) AS p FROM range(0, {SIZE // MB + 1}) r(d) LEFT JOIN w ON w.d = r.d, k),
steps AS (
  SELECT 0 AS i, 0 AS low, 0 AS high, a[1] AS held, p[1] AS pairs, CASE WHEN a[1] < 400 THEN 1 ELSE 2 END AS kind, CAST(NULL AS DOUBLE) AS density, a, p FROM arrays
  UNION ALL
  SELECT CASE WHEN act = 3 THEN i + 1 ELSE i END, CASE WHEN act = 2 THEN low + 1 ELSE low END, high + CASE act WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE gain END,
    held + new_held, pairs + new_pairs, CASE WHEN act < 3 THEN kind WHEN held + new_held < 400 THEN 1 ELSE 2 END, CASE WHEN act = 3 THEN CASE WHEN pairs > 0 THEN held / pairs ELSE 0 END END, a, p
  FROM (SELECT *,
      CASE act WHEN 1 THEN coalesce(a[high + 2], 0) WHEN 2 THEN -a[low + 1] - a[high + 1] ELSE CASE WHEN gain > 0 THEN a[high + 2] ELSE 0 END + CASE WHEN gain > 1 THEN a[high + 3] ELSE 0 END END AS new_held,
      CASE act WHEN 1 THEN coalesce(p[high + 2], 0) WHEN 2 THEN -p[low + 1] - p[high + 1] ELSE CASE WHEN gain > 0 THEN p[high + 2] ELSE 0 END + CASE WHEN gain > 1 THEN p[high + 3] ELSE 0 END END AS new_pairs
    FROM (SELECT *, CASE WHEN high + 2 < {SIZE // MB} THEN 2 WHEN high + 1 < {SIZE // MB} THEN 1 ELSE 0 END AS gain,
        CASE WHEN kind = 1 AND held < 400 AND high < {SIZE // MB} THEN 1
             WHEN kind = 2 AND high > low AND low <= {SIZE // MB} AND high <= {SIZE // MB} AND held - a[low + 1] - a[high + 1] >= 400 THEN 2 ELSE 3 END AS act
      FROM steps WHERE i < {SIZE // MB}))),
dense AS (SELECT CAST(i - 1 AS INT) AS dist, CAST(CAST(density AS FLOAT) AS DOUBLE) AS density FROM steps WHERE density IS NOT NULL),
factors AS (SELECT t.chr, CAST(sum(({SIZE // MB} - dist) * density) / any_value(t.n) AS FLOAT)::DOUBLE AS factor FROM (SELECT chr1 AS chr, sum(n) AS n FROM cells WHERE chr1 = chr2 GROUP BY 1) t, dense GROUP BY t.chr)"""


_MANY = _DENSITY + f""",
ways AS (SELECT chr1 AS chr, bin1 AS bin, n FROM cells WHERE chr1 = chr2 UNION ALL SELECT chr1, bin2, n FROM cells WHERE chr1 = chr2 AND bin1 <> bin2),
cov AS (SELECT chr, bin, sum(n)::DOUBLE AS v FROM ways GROUP BY ALL),
apart AS (SELECT chr1 AS c1, chr2 AS c2, sum(n)::DOUBLE / {SIZE // MB} / {SIZE // MB} AS mean FROM cells WHERE chr1 <> chr2 GROUP BY ALL),
{_cases_sql("orders", "o_orderkey", "o_custkey", 2 * MB)},
met AS (SELECT k, chr1, chr2, bin1, bin2, n FROM cases JOIN cells ON {_HIT}),
valued AS (
  SELECT k, bin1, bin2, n / (a.v * b.v) AS value FROM met JOIN cov a ON a.chr = chr1 AND a.bin = bin1 JOIN cov b ON b.chr = chr2 AND b.bin = bin2 WHERE k % 2 = 0
  UNION ALL SELECT k, bin1, bin2, n::DOUBLE FROM met WHERE k % 2 = 1 AND k % 3 <> 0
  UNION ALL SELECT k, bin1, bin2, n / (density / factor) FROM met JOIN dense ON dist = abs(bin1 - bin2) JOIN factors ON chr = chr1 WHERE k % 2 = 1 AND k % 3 = 0 AND chr1 = chr2 AND density > 0
  UNION ALL SELECT k, bin1, bin2, n / mean FROM met JOIN apart ON c1 = chr1 AND c2 = chr2 WHERE k % 2 = 1 AND k % 3 = 0)"""
_COMPARED = _PAIRS + f""",
{_cases_sql("supplier", "s_suppkey", "(s_suppkey // 3)", 4 * MB)},
binned AS (SELECT chr1, chr2, pos1 // {MB} AS bin1, pos2 // {MB} AS bin2, count(*)::DOUBLE AS a, nullif(count(*) FILTER (mapq1 >= 20), 0)::DOUBLE AS b FROM c GROUP BY ALL),
g AS (SELECT k, a, b FROM cases JOIN binned ON {_HIT})"""


def _report_sql() -> str:
    """The generated cases as rows, joined to the binned contacts by range."""
    rows = []
    for case in region.random_cases(GENOME, [MB], ("NONE",), pairs=6):
        if case.observed:
            (a, s, e), (b, t, f) = sorted((region.parse_region(r, GENOME) for r in (case.region1, case.region2)), key=lambda r: r[0])
            rows.append(f"('{case.name}', {a}, {b}, {s // MB}, {t // MB}, {e // MB}, {f // MB})")
    return f"""WITH {_PAIRS}, cases(k, q1, q2, f1, f2, l1, l2) AS (VALUES {', '.join(rows)}),
binned AS (SELECT chr1, chr2, pos1 // {MB} AS bin1, pos2 // {MB} AS bin2, count(*)::DOUBLE AS a, nullif(count(*) FILTER (mapq1 >= 20), 0)::DOUBLE AS b FROM c GROUP BY ALL),
g AS (SELECT cases.k, a, b FROM cases LEFT JOIN binned ON {_HIT})
SELECT k AS "case", count(a)::BIGINT AS rows_left, count(b)::BIGINT AS rows_right, count(a) = count(b) AS coordinates_equal, coalesce(bool_and(coalesce(a = b, false)) FILTER (a IS NOT NULL), true) AS exact_values_equal,
  count(b)::BIGINT AS common_positive_finite, coalesce(round(corr(a, b), 9), -2) AS pearson, coalesce(round(median(b / a), 9), -2) AS median_ratio FROM g GROUP BY k"""


def _scale_sql() -> str:
    """Balancing as a recursive query over lists: a row for each matrix and turn, until the vector stands still. Rows without contacts are 0 throughout."""
    n = SIZE // (5 * MB) + 1
    each = lambda x: f"list_transform(range(1, {n + 1}), lambda k: {x})"
    over = lambda a, b: each(f"CASE WHEN {b}[k] <> 0 THEN {a}[k] / {b}[k] ELSE 0 END")
    times = lambda v: f"list_transform(a, lambda w: list_inner_product(w, {v}))"
    return _EVENTS.replace("value - 100 AS s", "value AS s") + f""",
own AS (SELECT chr1 AS chr, pos1 // {5 * MB} AS i, pos2 // {5 * MB} AS j, sum(s) AS n FROM c WHERE chr1 = chr2 GROUP BY ALL HAVING sum(s) > 0),
ways AS (SELECT chr, i, j, n FROM own UNION ALL SELECT chr, j, i, n FROM own WHERE i <> j),
grid AS (SELECT chr, i, j FROM (SELECT DISTINCT chr FROM own), range(0, {n}) x(i), range(0, {n}) y(j)),
lines AS (SELECT chr, i, list(coalesce(n, 0)::DOUBLE ORDER BY j) AS w FROM grid LEFT JOIN ways USING (chr, i, j) GROUP BY chr, i),
m AS (SELECT chr, list(w ORDER BY i) AS a FROM lines GROUP BY chr),
begun AS (SELECT chr, a, list_transform(a, lambda w: CASE WHEN list_sum(w) > 0 THEN 1 ELSE 0 END::DOUBLE) AS one FROM m),
rooted AS (SELECT chr, a, one, {each("sqrt(list_inner_product(a[k], one) * one[k])")} AS now FROM begun),
turns AS (
  SELECT chr, a, one, 0 AS turn, now AS l, now AS r, {each("list_inner_product(a[k], one) * now[k]")} AS sums, now, 1::DOUBLE AS change FROM rooted
  UNION ALL
  SELECT chr, a, one, turn, l, r, {each("list_inner_product(a[k], r) * l[k]")}, now, list_max({each("abs(now[k] - before[k]) / (now[k] + before[k] + 1e-300)")}) FROM (
    SELECT *, {each("sqrt(l[k] * r[k])")} AS now FROM (
      SELECT chr, a, one, turn, before, l, {over("r", "col")} AS r FROM (
        SELECT *, {each("list_inner_product(a[k], l) * r[k]")} AS col FROM (
          SELECT chr, a, one, turn + 1 AS turn, now AS before, {over("l", "sums")} AS l, r FROM turns WHERE change >= 1e-4 AND turn < 1000))))),
done AS (SELECT chr, a, one, now FROM turns WHERE change < 1e-4),
divisor AS (SELECT chr, one, list_transform(now, lambda b: sqrt(list_inner_product({times("now")}, now) / list_inner_product({times("one")}, one)) / nullif(b, 0)) AS v FROM done),
factor AS (SELECT chr, CAST(sqrt(sum(CASE WHEN i = j THEN 1 ELSE 2 END * n / (v[i + 1] * v[j + 1])) / sum(CASE WHEN i = j THEN 1 ELSE 2 END * n)) AS FLOAT)::DOUBLE AS f FROM own JOIN divisor USING (chr) WHERE v[i + 1] > 0 AND v[j + 1] > 0 GROUP BY chr),
vector AS (SELECT chr, bin::INT AS bin, v[bin + 1] * f AS value FROM divisor JOIN factor USING (chr), range(0, {n}) t(bin))"""


def oracle_sql() -> dict[str, str]:
    canonical = "SELECT chr1, pos1, chr2, pos2 FROM c"
    columns, side = block_shape_of(SIZE, MB, True)
    many = " UNION ALL ".join(f"SELECT CAST({r} AS INT) AS bin_size, chr1, chr2, pos1 // {r} AS bin1, pos2 // {r} AS bin2, count(*)::BIGINT AS count FROM c GROUP BY ALL" for r in RESOLUTIONS)
    kb, step = GENOME.total // 1000, GENOME.whole_genome_bin
    assert kb > step
    place = lambda e: f"CAST(((((chr{e} - 1)::BIGINT * {SIZE} + pos{e}) // 1000) // {step}) AS INT)"
    event_cells_ = f"SELECT chr1, chr2, pos1 // {MB} AS bin1, pos2 // {MB} AS bin2, sum(s) AS n, sum(CASE WHEN s > 0 THEN s ELSE 0 END) AS p FROM c GROUP BY ALL"
    normed = "SELECT o.chr, bin1, bin2, n / (a.v * b.v) AS value FROM own o JOIN cov a ON a.chr = o.chr AND a.bin = bin1 JOIN cov b ON b.chr = o.chr AND b.bin = bin2"
    short = "least(pos1, 30000000)"
    return {
        "contacts_filtered": f"WITH {_PAIRS} SELECT chr1, pos1, chr2, pos2, mapq1 FROM good",
        "canonical_pairs": f"WITH {_PAIRS} {canonical}",
        "intra_only": f"WITH {_PAIRS} {canonical} WHERE chr1 = chr2",
        "near_diagonal": f"WITH {_PAIRS} {canonical} WHERE chr1 <> chr2 OR abs(pos1 - pos2) <= 10000000",
        "clamped_pairs": f"WITH {_PAIRS} SELECT chr1, {short} AS pos1, chr2, least(pos2, 30000000) AS pos2 FROM c",
        "read_skip_counts": f"WITH {_PAIRS} SELECT count(*)::BIGINT AS total, count(*) FILTER (mapq1 < {MAPQ} OR (chr1 = chr2 AND abs(pos1 - pos2) > 10000000))::BIGINT AS skipped FROM raw",
        "mnd_lines": f"WITH {_PAIRS} SELECT chr1, pos1, chr2, pos2, mapq1, CAST(1 AS INT) AS frag2, 1.5::DOUBLE AS score FROM raw",
        "cells_1mb": f"WITH {_CELLS} SELECT chr1, chr2, bin1, bin2, n AS count FROM cells",
        "streaming_cells": f"WITH {_CELLS} SELECT chr1, chr2, bin1, bin2, n AS count FROM cells",
        "streaming_batches": f"WITH {_CELLS} SELECT chr1, chr2, bin1, bin2, n AS count FROM cells",
        "cells_multires": f"WITH {_PAIRS} {many}",
        "cells_threshold": f"WITH {_CELLS} SELECT chr1, chr2, bin1, bin2, n AS count FROM cells WHERE n >= 3",
        "event_cells": f"WITH {_EVENTS}, e AS ({event_cells_}) SELECT chr1, chr2, bin1, bin2, CASE WHEN round(n, 3) = 0 THEN 0 ELSE round(n, 3) END AS count, round(p, 3) AS pos_count FROM e",
        "whole_genome_cells": f"WITH {_PAIRS}, p AS (SELECT {place(1)} AS a, {place(2)} AS b FROM c) SELECT least(a, b) AS bin1, greatest(a, b) AS bin2, count(*)::BIGINT AS count FROM p GROUP BY ALL",
        "zoom_sum_counts": f"WITH {_CELLS} SELECT chr1, chr2, sum(CASE WHEN chr1 = chr2 AND bin1 <> bin2 THEN 2 * n ELSE n END)::BIGINT AS sum_counts, count(*)::BIGINT AS n_cells, CAST({columns} AS INT) AS block_columns, CAST({side} AS INT) AS block_bins FROM cells GROUP BY chr1, chr2",
        "block_intra": _blocks_sql(10_000, True),
        "block_inter": _blocks_sql(1_000, False),
        "block_params": _shapes_sql(),
        "chr_offsets": "WITH n AS (SELECT c_nationkey, sum(floor(abs(c_acctbal)))::BIGINT AS length FROM customer GROUP BY 1) SELECT 'n' || c_nationkey AS name, (row_number() OVER (ORDER BY c_nationkey))::INT AS index, length, coalesce(sum(length) OVER (ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM n",
        "distance_hist": f"WITH {_CELLS} SELECT abs(bin1 - bin2) AS dist, sum(n)::BIGINT AS weight FROM cells WHERE chr1 = chr2 GROUP BY 1",
        "chr_totals": f"WITH {_CELLS} SELECT chr1 AS chr, sum(n)::BIGINT AS total FROM cells WHERE chr1 = chr2 GROUP BY 1",
        "event_distance_hist": f"WITH {_EVENTS}, e AS ({event_cells_}) SELECT abs(bin1 - bin2) AS dist, round(sum(p), 3) AS weight FROM e WHERE chr1 = chr2 AND p > 0 GROUP BY 1",
        "possible_distances": f"WITH {_CELLS}, k AS (SELECT DISTINCT chr1 FROM cells WHERE chr1 = chr2) SELECT CAST(d AS INT) AS dist, sum({SIZE // MB} - d)::BIGINT AS possible FROM k, range(0, {SIZE // MB}) t(d) GROUP BY 1",
        "vc": f"WITH {_INTRA}, {_BINS} SELECT bins.chr, bins.bin, round(coalesce(v, 0), 5) AS value FROM bins LEFT JOIN cov ON cov.chr = bins.chr AND cov.bin = bins.bin",
        "vc_scaled": _scaled_sql("v"),
        "vc_sqrt": _scaled_sql("sqrt(v)"),
        "norm_cells_vc": f"WITH {_INTRA} SELECT chr, bin1, bin2, round(value, 9) AS value FROM ({normed})",
        "norm_distance_hist_vc": f"WITH {_INTRA} SELECT abs(bin1 - bin2) AS dist, round(sum(value), 7) AS weight FROM ({normed}) GROUP BY 1",
        "row_nonzeros": f"WITH {_INTRA} SELECT chr, bin, count(*)::BIGINT AS n FROM ways GROUP BY ALL",
        "coverage_stats": f"WITH {_INTRA}, z AS (SELECT chr, bin, count(*) AS k FROM ways GROUP BY ALL) SELECT chr, count(*)::BIGINT AS n_rows, round(avg(k), 9) AS mean, round(stddev_pop(k), 9) AS deviation, list_sort(list(k))[CAST(floor(count(*) * 0.2) AS INT) + 1] AS fifth, CAST(greatest(1, ceil(avg(k) - stddev_pop(k))) AS INT) AS bound FROM z GROUP BY chr",
        "contiguity_violations": f"WITH {_PAIRS}, o AS (SELECT chr1, chr2, lag((chr1, chr2)) OVER (ORDER BY pos1, pos2, chr1, chr2) AS before FROM c) SELECT chr1, chr2, count(*)::BIGINT AS n_runs FROM o WHERE before IS NULL OR before <> (chr1, chr2) GROUP BY ALL HAVING count(*) > 1",
        "region_observed": f"WITH {_CELLS} SELECT bin1 * {MB} AS x, bin2 * {MB} AS y, n::DOUBLE AS value FROM cells WHERE {_REGION}",
        "region_between": f"WITH {_CELLS} SELECT bin1 * {MB} AS x, bin2 * {MB} AS y, n::DOUBLE AS value FROM cells WHERE chr1 = 2 AND chr2 = 4 AND bin1 BETWEEN 10 AND 30 AND bin2 BETWEEN 0 AND 20",
        "region_vc": f"WITH {_INTRA} SELECT bin1 * {MB} AS x, bin2 * {MB} AS y, round(value, 9) AS value FROM ({normed}) WHERE {_REGION.replace('chr1 = 1 AND chr2 = 1', 'chr = 1')}",
        "compare_metrics": f"WITH {_TWO}, g AS (SELECT * FROM two WHERE a > 0 AND b > 0) SELECT (SELECT count(a) FROM two)::BIGINT AS rows_left, (SELECT count(b) FROM two)::BIGINT AS rows_right, (SELECT bool_and(a IS NOT NULL AND b IS NOT NULL) FROM two) AS coordinates_equal, (SELECT bool_and(coalesce(a = b, false)) FROM two) AS exact_values_equal, count(*)::BIGINT AS common_positive_finite, round(corr(a, b), 9) AS pearson, round(median(b / a), 9) AS median_ratio, round(median(abs(a - b) / greatest(a, b)), 9) AS median_relative_error, round(max(abs(a - b) / greatest(a, b)), 9) AS max_relative_error FROM g",
        "expected_density": f"WITH RECURSIVE {_DENSITY} SELECT dist, density FROM dense",
        "chr_scale_factors": f"WITH RECURSIVE {_DENSITY} SELECT chr, round(factor, 5) AS factor FROM factors",
        "region_oe": f"WITH RECURSIVE {_DENSITY} SELECT bin1 * {MB} AS x, bin2 * {MB} AS y, round(CAST(n / (density / factor) AS FLOAT)::DOUBLE, 4) AS value FROM cells JOIN dense ON dist = abs(bin1 - bin2) JOIN factors ON chr = chr1 WHERE {_REGION} AND density > 0",
        "region_oe_between": f"WITH {_CELLS} SELECT bin1 * {MB} AS x, bin2 * {MB} AS y, round(CAST(n / ((SELECT sum(n)::DOUBLE FROM cells WHERE chr1 = 2 AND chr2 = 4) / {SIZE // MB} / {SIZE // MB}) AS FLOAT)::DOUBLE, 4) AS value FROM cells WHERE chr1 = 2 AND chr2 = 4 AND bin1 BETWEEN 10 AND 30 AND bin2 BETWEEN 0 AND 20",
        "regions_many": f"WITH RECURSIVE {_MANY} SELECT k AS case_id, bin1 * {MB} AS x, bin2 * {MB} AS y, CASE WHEN k % 2 = 0 THEN round(CAST(value AS FLOAT)::DOUBLE, 12) ELSE round(CAST(value AS FLOAT)::DOUBLE, 4) END AS value FROM valued",
        "regions_compare": f"WITH {_COMPARED} SELECT k AS case_id, count(a)::BIGINT AS rows_left, count(b)::BIGINT AS rows_right, bool_and(b IS NOT NULL) AS coordinates_equal, bool_and(coalesce(a = b, false)) AS exact_values_equal, count(b)::BIGINT AS common_positive_finite, CASE WHEN count(b) < 2 THEN -2 WHEN min(a) FILTER (b > 0) = max(a) FILTER (b > 0) OR min(b) = max(b) THEN CASE WHEN bool_and(a = b) FILTER (b > 0) THEN 1 ELSE -2 END ELSE round(corr(a, b), 9) END::DOUBLE AS pearson, coalesce(round(median(b / a), 9), -2) AS median_ratio, coalesce(round(median((a - b) / a) FILTER (b > 0), 9), -2) AS median_relative_error, coalesce(round(max((a - b) / a), 9), -2) AS max_relative_error FROM g GROUP BY k",
        "dump_lines": f"WITH {_INTRA} SELECT bin1 * {MB} AS x, bin2 * {MB} AS y, printf('%.12g', round(value, 9) * 1000) AS value FROM ({normed}) WHERE {_REGION.replace('chr1 = 1 AND chr2 = 1', 'chr = 1')}",
        "v9_roundtrip": f"WITH {_PAIRS} " + " UNION ALL ".join(f"SELECT CAST({r} AS INT) AS bin_size, chr1, chr2, pos1 // {r} AS bin1, pos2 // {r} AS bin2, count(*)::BIGINT AS count FROM c GROUP BY ALL" for r in (500_000, 1_000_000)),
        "v9_matrices": f"WITH {_PAIRS} SELECT DISTINCT chr1, chr2 FROM c",
        "v9_kept": f"WITH {_PAIRS} " + " UNION ALL ".join(f"SELECT CAST({r} AS INT) AS bin_size, chr1, chr2, pos1 // {r} AS bin1, pos2 // {r} AS bin2, count(*)::BIGINT AS count FROM c GROUP BY ALL" for r in (500_000, 1_000_000)),
        "v9_expected": f"WITH RECURSIVE {_DENSITY} SELECT dist, density, chr, round(factor, 5) AS factor FROM dense, factors",
        "v9_inspect": f"WITH {_PAIRS} SELECT 9::INT AS version, 'five' AS genome, 6::INT - 1 AS n_chromosomes, '1000000,500000' AS resolutions, count(DISTINCT (chr1, chr2))::INT AS n_matrices, (count(DISTINCT chr1) FILTER (chr1 = chr2))::INT AS n_vectors, '2.0' AS scaling FROM c",
        "dense_blocks": f"WITH {_CELLS} SELECT chr1, chr2, bin1, bin2, n AS count FROM cells",
        "dump_read": f"WITH {_CELLS} SELECT bin1 * {MB} AS x, bin2 * {MB} AS y, n::DOUBLE AS value FROM cells WHERE {_REGION}",
        "file_md5": "SELECT n_regionkey::INT AS n_regionkey, md5(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS md5 FROM nation GROUP BY 1",
        "file_sizes": "WITH t AS (SELECT c_custkey, floor(abs(c_acctbal))::BIGINT AS length FROM customer) SELECT (row_number() OVER (ORDER BY c_custkey))::INT AS index, 'C' || c_custkey AS name, length, coalesce(sum(length) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM t",
        "same_fragment": f"WITH {_PAIRS} {canonical} WHERE NOT (chr1 = chr2 AND pos1 % 3 = pos2 % 3)",
        "spread_product": f"WITH {_INTRA}, {_BINS}, p AS (SELECT chr, bin, sum(n * (o + 1))::DOUBLE AS v FROM (SELECT chr, bin1 AS bin, bin2 AS o, n FROM own UNION ALL SELECT chr, bin2, bin1, n FROM own WHERE bin1 <> bin2) GROUP BY ALL) SELECT bins.chr, bins.bin, coalesce(v, 0) AS value FROM bins LEFT JOIN p ON p.chr = bins.chr AND p.bin = bins.bin",
        "build_cells": " UNION ALL ".join(f"SELECT CAST({r} AS INT) AS bin_size, chr1, chr2, bin1, bin2, count, block_number FROM ({_blocks_sql(r, True, 5)})" for r in (10_000, MB)),
        "scale_gate": f"WITH {_EVENTS} SELECT norm, CAST(i AS INT) AS chr, CAST(r AS INT) AS bin_size, CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE chr1 = i AND chr2 = i) THEN 'no contacts' WHEN norm = 'SCALE' AND r < {5 * MB} THEN 'not asked for' ELSE 'made' END AS status FROM range(1, 6) t(i), (VALUES ({MB}), ({5 * MB})) s(r), (VALUES ('VC'), ('SCALE')) v(norm)",
        "regions_report": _report_sql(),
        "v9_pruned": f"WITH {_PAIRS}, b AS (SELECT chr1, chr2, pos1 // 500000 AS bin1, pos2 // 500000 AS bin2, count(*)::BIGINT AS count FROM c GROUP BY ALL) SELECT * FROM b WHERE chr1 = 2 AND chr2 IN (2, 3) AND bin1 BETWEEN 10 AND 60 AND bin2 >= 20 AND bin2 < 80",
        "v9_blocks": " UNION ALL ".join(f"SELECT DISTINCT CAST({r} AS INT) AS bin_size, chr1, chr2, block_number FROM ({_blocks_sql(r, i)})" for r in (500_000, 1_000_000) for i in (True, False)),
        "v9_vectors": f"WITH {_INTRA}, {_BINS} SELECT bins.chr, bins.bin, CAST(coalesce(v, 0) AS FLOAT)::DOUBLE AS value FROM bins LEFT JOIN cov ON cov.chr = bins.chr AND cov.bin = bins.bin",
        "v9_damaged": f"WITH {_CELLS} SELECT norm, CAST(i AS INT) AS chr, CAST(r AS INT) AS bin_size, CASE WHEN i = 3 AND r = 500000 THEN 'unreadable' WHEN EXISTS (SELECT 1 FROM cells WHERE chr1 = i AND chr2 = i) THEN 'made' ELSE 'no contacts' END AS status FROM range(1, 6) t(i), (VALUES (500000), (1000000)) s(r), (VALUES ('VC'), ('VC_SQRT')) v(norm)",
        "scale_vector": f"WITH RECURSIVE {_scale_sql()} SELECT chr, CAST({5 * MB} AS INT) AS bin_size, bin, round(value, 4) AS value FROM vector",
        "scale_large": f"WITH RECURSIVE {_scale_sql()} SELECT chr, CAST({5 * MB} AS INT) AS bin_size, bin, round(value, 4) AS value FROM vector",
        "scale_row_sum_error": f"WITH RECURSIVE {_scale_sql()}, sums AS (SELECT w.chr, w.i, sum(n / (a.value * b.value)) AS x FROM ways w JOIN vector a ON a.chr = w.chr AND a.bin = w.i JOIN vector b ON b.chr = w.chr AND b.bin = w.j GROUP BY ALL), o AS (SELECT chr, greatest(max(x) / avg(x) - 1, 1 - min(x) / avg(x)) AS off FROM sums GROUP BY chr) SELECT chr, off <= {ROW_TOLERANCE} AS even, round(off, 6) AS off FROM o",
        "norm_status": f"WITH {_CELLS} SELECT norm, CAST(i AS INT) AS chr, CAST({MB} AS INT) AS bin_size, CASE WHEN EXISTS (SELECT 1 FROM cells WHERE chr1 = i AND chr2 = i) THEN 'made' ELSE 'no contacts' END AS status FROM range(1, 7) t(i), (VALUES ('VC'), ('VC_SQRT')) v(norm)",
        "mnd_short8": _lines_sql((0, 1), ("3", "4"), ("1000", "1000"), 1.0),
        "mnd_short9": _lines_sql((0, 1), ("3", "4"), ("1000", "1000"), 2.5),
        "mnd_old10": _lines_sql((0, 1), ("3", "4"), ("l_quantity", "33"), 1.0),
        "mnd_medium11": _lines_sql((0, 1), ("3", "4"), ("l_quantity", "33"), 1.0),
        "mnd_long16": _lines_sql((0, 1), ("3", "4"), ("l_quantity", "33"), 1.0),
        "extra_short_lines": _lines_sql((0, 0), ("0", "0"), ("1000", "1000"), 2.5),
        "pairs_lines": _lines_sql((1, 0), ("CASE WHEN l_partkey % 10 = 5 THEN 0 ELSE 8 END", "CASE WHEN l_partkey % 10 = 5 THEN 1 ELSE 6 END"), ("l_quantity", "33"), 1.0),
        "file_mnd": _lines_sql((0, 1), ("3", "4"), ("1000", "1000"), 1.0),
        "file_gzip": _lines_sql((0, 1), ("3", "4"), ("1000", "1000"), 1.0),
        "file_short": _lines_sql((0, 0), ("0", "0"), ("1000", "1000"), 2.5),
        "file_pairs": _lines_sql((1, 0), ("8", "6"), ("l_quantity", "33"), 1.0),
        "file_bn": _records_sql((0, 1), (0, 1), 2.5),
        "file_bin": _records_sql((0, 1), (3, 4), 1.0),
        "bn_records": _records_sql((0, 1), (0, 1), 2.5),
        "bin_records": _records_sql((0, 1), (3, 4), 1.0),
        "key_set_diff": f"WITH {_TWO} SELECT x, y, CASE WHEN b IS NULL THEN 'left' WHEN a IS NULL THEN 'right' ELSE 'both' END AS side FROM two",
        "duplicate_keys": f"WITH {_PAIRS} SELECT chr1, chr2, pos1, count(*)::BIGINT AS n FROM c GROUP BY ALL HAVING count(*) > 1",
        "first_appearance": f"WITH {_PAIRS}, f AS (SELECT chr1, chr2, min((pos1, pos2)) AS spot FROM c GROUP BY ALL) SELECT chr1, chr2, (row_number() OVER (ORDER BY spot, chr1, chr2))::INT AS place FROM f",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        contacts_filtered, canonical_pairs, intra_only, near_diagonal, clamped_pairs, read_skip_counts, mnd_lines, cells_1mb, cells_multires, cells_threshold, event_cells,
        whole_genome_cells, zoom_sum_counts, block_intra, block_inter, block_params, chr_offsets, distance_hist, chr_totals, event_distance_hist, possible_distances,
        expected_density, chr_scale_factors, vc, vc_scaled, vc_sqrt, norm_cells_vc, norm_distance_hist_vc, row_nonzeros, coverage_stats, scale_vector, scale_large, scale_failures, scale_row_sum_error,
        contiguity_violations, region_observed, region_between, region_vc, region_oe, compare_metrics, key_set_diff, duplicate_keys, first_appearance, streaming_cells, v9_roundtrip,
    )
    own += (file_mnd, file_gzip, file_short, file_pairs, file_bn, file_bin, v9_pruned, v9_blocks, v9_vectors, v9_damaged)
    own += (v9_matrices, v9_kept, v9_expected, v9_inspect, dense_blocks, dump_read, file_md5, file_sizes, same_fragment, spread_product, build_cells, scale_gate, regions_report)
    own += (streaming_batches, region_oe_between, regions_many, regions_compare, norm_status, dump_lines, extra_short_lines, pairs_lines, bn_records, bin_records)
    return {f.__name__: f for f in own} | {name: _mnd_layout(*parts) for name, parts in MND_LAYOUTS.items()}
