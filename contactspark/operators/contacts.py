"""From read pairs to contacts: filters, canonical order, clamping, counters, and the check of contiguous groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.genome import Genome

NEAR_DIAGONAL = 10_000_000


def skipped(mapq: int = 0, intra_only: bool = False, near_diagonal_only: bool = False, drop_same_fragment: bool = False) -> Column:
    """Whether a pair is left out. Positions are compared as they were read; pairs between chromosomes are never far from the diagonal."""
    intra = F.col("chr1") == F.col("chr2")
    tests = [F.least("mapq1", "mapq2") < mapq]
    if intra_only:
        tests.append(~intra)
    if near_diagonal_only:
        tests.append(intra & (F.abs(F.col("pos1").cast("bigint") - F.col("pos2")) > NEAR_DIAGONAL))
    if drop_same_fragment:
        tests.append(intra & (F.col("frag1") == F.col("frag2")))
    return reduce(lambda a, b: a | b, tests)


def canonical(pairs: DataFrame) -> DataFrame:
    """chr1, pos1, chr2, pos2, score with the end that comes first (by chromosome, then position) in front."""
    turned = (F.col("chr1") > F.col("chr2")) | ((F.col("chr1") == F.col("chr2")) & (F.col("pos1") > F.col("pos2")))
    ends = [(F.col(f"{x}{e}"), F.col(f"{x}{3 - e}"), f"{x}{e}") for e in (1, 2) for x in ("chr", "pos")]
    return pairs.select(*[F.when(turned, other).otherwise(own).alias(name) for own, other, name in ends], *[c for c in ("score", "ordinal") if c in pairs.columns])


def clamp(pairs: DataFrame, genome: Genome) -> DataFrame:
    """Positions at most the chromosome's length."""
    lengths = F.create_map(*[F.lit(x) for kv in genome.lengths().items() for x in kv])
    capped = {f"pos{e}": F.least(F.col(f"pos{e}").cast("bigint"), F.try_element_at(lengths, F.col(f"chr{e}")).cast("bigint")).cast("int") for e in "12"}
    return pairs.withColumns(capped)


def contacts(pairs: DataFrame, genome: Genome, mapq: int = 0, intra_only: bool = False, near_diagonal_only: bool = False, drop_same_fragment: bool = False, scaling_factor: float = 1.0) -> DataFrame:
    """Filtered, clamped contacts in canonical order; narrow work only, so a scan flows into the first aggregation."""
    kept = pairs.where(~skipped(mapq, intra_only, near_diagonal_only, drop_same_fragment))
    kept = clamp(kept, genome).withColumn("score", F.col("score") * F.lit(scaling_factor).cast("float"))
    return canonical(kept)


def counters(pairs: DataFrame, **filters) -> DataFrame:
    """total and skipped: pairs read and pairs left out."""
    return pairs.agg(F.count("*").alias("total"), F.count_if(skipped(**filters)).alias("skipped"))


def scattered_groups(ordered: DataFrame, order: list[str] | None = None) -> DataFrame:
    """chr1, chr2, n_runs of the chromosome pairs that don't stand together in the input's order.

    Without ``order`` that is the order of the files' lines, by the column ``ordinal`` of
    ``read_pairs``: its ranges are the parts, and nothing is sorted across them. With
    ``order``, rows are sorted in ranges first. Runs are counted where a row's pair
    differs from the row before; a part's first row is compared with the last of the
    part before.
    """
    if order is None:
        parts = ordered.select("chr1", "chr2", F.struct("ordinal.file", "ordinal.start").alias("part"), F.col("ordinal.place").alias("place"))
        inside = Window.partitionBy("part").orderBy("place")
    else:
        parts = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("chr1", "chr2", *order, F.spark_partition_id().alias("part"))
        inside = Window.partitionBy("part").orderBy(*order)
    key = F.struct("chr1", "chr2")
    marked = parts.select("part", "chr1", "chr2", (F.lag(key).over(inside) != key).alias("turn"), F.row_number().over(inside).alias("n"))
    inner = marked.where("turn").groupBy("chr1", "chr2").agg(F.count("*").alias("runs"))
    edge = marked.groupBy("part").agg(F.min_by(key, "n").alias("head"), F.max_by(key, "n").alias("tail"))  # a row for each part
    before = F.lag("tail").over(Window.orderBy("part"))
    starts = edge.select("head", (before.isNull() | (before != F.col("head"))).alias("new")).where("new").select("head.*").groupBy("chr1", "chr2").agg(F.count("*").alias("runs"))
    runs = inner.unionByName(starts).groupBy("chr1", "chr2").agg(F.sum("runs").alias("n_runs"))
    return runs.where("n_runs > 1")


def require_contiguous(ordered: DataFrame, order: list[str] | None = None) -> None:
    """Raises where a chromosome pair appears in several blocks of the input."""
    bad = scattered_groups(ordered, order).orderBy("chr1", "chr2").limit(1).collect()
    if bad:
        raise ValueError(f"chromosome pair {bad[0].chr1}-{bad[0].chr2} appears in multiple blocks")


def first_appearance(ordered: DataFrame) -> DataFrame:
    """chr1, chr2 and ``place``, from 1, in the order in which chromosome pairs first appear in the input (by the column ``ordinal`` of ``read_pairs``).

    The least place is taken within each range of a file first: that is a number, which
    lines are summed up to by hash, where the least of structs would sort all lines.
    """
    inside = ordered.groupBy("chr1", "chr2", "ordinal.file", "ordinal.start").agg(F.min("ordinal.place").alias("place"))
    first = inside.groupBy("chr1", "chr2").agg(F.min(F.struct("file", "start", "place")).alias("at"))  # a row for each pair of chromosomes
    return first.select("chr1", "chr2", F.row_number().over(Window.orderBy("at")).alias("place"))
