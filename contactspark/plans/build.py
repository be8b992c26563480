"""The engine's interface: build a store of matrices from read pairs, normalise it, query it, keep it and exchange it."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from contactspark.genome import Genome
from contactspark.operators import compare, contacts, expected, matrix, norms, region
from contactspark.session import keep
from contactspark.sources import container


@dataclass
class Store:
    """Matrices of a genome as frames; ``vectors`` and normalised expected values come with ``normalise``."""

    genome: Genome
    cells: DataFrame
    whole_genome: DataFrame
    zooms: DataFrame
    density: DataFrame
    factors: DataFrame
    counters: DataFrame
    depth_base: int = 2
    scaling_factor: float = 1.0
    vectors: DataFrame | None = None
    resolutions: tuple[int, ...] = ()
    status: DataFrame | None = None
    between: DataFrame | None = None


def build(pairs: DataFrame, genome: Genome, resolutions: list[int] | tuple[int, ...] = matrix.RESOLUTIONS, mapq: int = 0, intra_only: bool = False, near_diagonal_only: bool = False, drop_same_fragment: bool = False, count_threshold: float = 0, depth_base: int = 2, scaling_factor: float = 1.0) -> Store:
    """All matrices of the pairs.

    The pairs are read once: their contacts go to the shared folder as a table, and the
    counters are taken in passing. Cells of each resolution are stored before coarser
    ones, sums, distances and norms are made of them.
    """
    if not 2 <= depth_base <= 10:
        raise ValueError("depth_base must be from 2 to 10")
    filters = {"mapq": mapq, "intra_only": intra_only, "near_diagonal_only": near_diagonal_only, "drop_same_fragment": drop_same_fragment}
    seen = Observation()
    counted = pairs.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(contacts.skipped(**filters)).alias("skipped"))
    kept = keep(contacts.contacts(counted, genome, **filters, scaling_factor=scaling_factor))
    counters = pairs.sparkSession.createDataFrame([(seen.get["total"], seen.get["skipped"])], "total bigint, skipped bigint")
    cell_rows = matrix.union(matrix.multi_resolution(kept, list(resolutions), keep))
    by_chr = keep(expected.distances(cell_rows))
    totals = expected.chromosome_totals(by_chr)
    dense = keep(expected.density(expected.histogram(by_chr, genome), expected.possible_distances(totals, genome), genome))
    shown = matrix.at_least(cell_rows, count_threshold) if count_threshold else cell_rows
    numbered, sums, factors = matrix.with_blocks(shown, genome, depth_base), matrix.zooms(shown, genome), expected.scale_factors(dense, totals, genome)
    apart = keep(expected.between(cell_rows, genome))
    return Store(genome, numbered, matrix.whole_genome(kept, genome), sums, dense, factors, counters, depth_base, scaling_factor, resolutions=tuple(sorted(set(resolutions))), between=apart)


def _normed_model(cells: DataFrame, made: DataFrame, genome: Genome, bins: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Density and factors of cells within chromosomes, and expected values between them, of each norm that ``made`` has vectors of; ``bins`` bounds their rows."""
    keys = ("norm", "bin_size")
    few = F.broadcast if bins <= norms.BROADCAST_BINS else (lambda df: df)
    one, two = (few(made.select("norm", "bin_size", F.col("chr").alias(f"chr{e}"), F.col("bin").alias(f"bin{e}"), F.col("value").alias(f"n{e}"))) for e in "12")
    met = cells.where("count > 0").join(one, ["bin_size", "chr1", "bin1"]).join(two, ["norm", "bin_size", "chr2", "bin2"])
    met = met.where(norms.usable(F.col("n1")) & norms.usable(F.col("n2"))).select(*keys, "chr1", "chr2", "bin1", "bin2", (F.col("count") / (F.col("n1") * F.col("n2"))).alias("value"))
    by_chr = keep(expected.distances(met, F.col("value"), keys))
    totals = expected.chromosome_totals(by_chr, keys)
    dense = keep(expected.density(expected.histogram(by_chr, genome, keys), expected.possible_distances(totals, genome, keys), genome, keys))
    return dense, expected.scale_factors(dense, totals, genome, keys), keep(expected.between(met, genome, F.col("value"), keys))


def normalise(store: Store, names: tuple[str, ...] = norms.NORMS, tol: float = 1e-4, max_iter: int = 2000, min_scale_res: int = 0, diagonal_width: int = -1) -> Store:
    """The store with normalisation vectors, with expected values of every norm besides the raw ones, and with ``status``, which names the matrices that got no vector. ``diagonal_width`` above 0 masks, for SCALE, rows with few contacts within so many bins of the diagonal."""
    options = {"tol": tol, "max_iter": max_iter, "min_res": min_scale_res, "diagonal_width": diagonal_width} if "SCALE" in names else {}
    sizes = list(store.resolutions) or sorted(r.bin_size for r in store.cells.select("bin_size").distinct().collect())
    bins = norms.bins_of(store.genome, sizes)
    made = keep(norms.vectors(store.cells, store.genome, names, bins, **options))
    dense, factors, apart = _normed_model(store.cells, made, store.genome, bins * len(names))
    raw = lambda df: df.withColumn("norm", F.lit("NONE")) if "norm" not in df.columns else df.where("norm = 'NONE'")
    told = norms.status(store.cells, made, store.genome, sizes, names, min_scale_res)
    apart = apart if store.between is None else raw(store.between).unionByName(apart)
    return replace(store, vectors=made, status=told, density=raw(store.density).unionByName(dense), factors=raw(store.factors).unionByName(factors), between=apart)


def normalise_container(spark: SparkSession, path: str, names: tuple[str, ...] = norms.NORMS, tol: float = 1e-4, max_iter: int = 2000, min_scale_res: int = 0, diagonal_width: int = -1) -> DataFrame:
    """Gives a container file new normalisation vectors, and expected values of each norm, of its matrices within chromosomes; returns ``status`` as ``normalise`` does.

    A matrix of which a block or the index can't be read gets none and is told as
    ``unreadable``; the others are done.
    """
    header = container.read_header(path)
    genome, sizes = header.genome, header.resolutions
    cells, problems = container.read_checked(spark, path, "chr1 = chr2")
    lost = keep(problems.select(F.col("chr1").alias("lost_chr"), F.col("bin_size").alias("lost_size")).distinct())
    is_lost = lambda chr_: (F.col(chr_) == F.col("lost_chr")) & (F.col("lost_size").isNull() | (F.col("bin_size") == F.col("lost_size")))
    good = cells.join(F.broadcast(lost), is_lost("chr1"), "left_anti")  # a row for each matrix at most
    bins = norms.bins_of(genome, sizes)
    options = {"tol": tol, "max_iter": max_iter, "min_res": min_scale_res, "diagonal_width": diagonal_width} if "SCALE" in names else {}
    made = keep(norms.vectors(good, genome, names, bins, **options))
    dense, factors, _ = _normed_model(good, made, genome, bins * len(names))
    container.replace_vectors(spark, path, made, expected_vectors(dense, factors))
    told = norms.status(good, made, genome, sizes, names, min_scale_res)
    marked = told.join(F.broadcast(lost.withColumn("lost", F.lit(True))), is_lost("chr"), "left").groupBy(*told.columns).agg(F.max("lost").alias("lost"))
    return keep(marked.select("norm", "chr", "bin_size", F.when(F.col("lost"), "unreadable").otherwise(F.col("status")).alias("status")))


def query(store: Store, region1: str, region2: str, bin_size: int, norm: str = "NONE", observed: bool = True) -> DataFrame:
    """x, y, value of two regions (``chr`` or ``chr:start:end``)."""
    if norm != "NONE" and store.vectors is None:
        raise ValueError("the store is not normalised")
    a, b = (region.parse_region(r, store.genome) for r in (region1, region2))
    model = {}
    if not observed:
        pick = lambda df: df.where(F.col("norm") == norm) if df is not None and "norm" in df.columns else df
        model = {name: pick(getattr(store, name)) for name in ("density", "factors", "between")}
    return region.query(store.cells, a, b, bin_size, store.vectors, norm, **model)


def query_many(store: Store, cases: list[region.RegionCase] | DataFrame) -> DataFrame:
    """case, x, y, value of many region queries, in one pass over the cells. A frame of cases has the columns that ``region.query_many`` takes."""
    table = cases if isinstance(cases, DataFrame) else region.cases_table(store.cells.sparkSession, cases, store.genome)
    return region.query_many(store.cells, table, store.vectors, store.density, store.factors, store.between)


def compare_stores(left: Store, right: Store, cases: list[region.RegionCase] | DataFrame) -> DataFrame:
    """A row for each case: rows of either store's result, whether they agree, and metrics of the values that both have. Cases of which neither has a row agree."""
    table = cases if isinstance(cases, DataFrame) else region.cases_table(left.cells.sparkSession, cases, left.genome)
    return _told(table, compare.compare_results(query_many(left, table), query_many(right, table), ["case"]))


def _told(cases: DataFrame, met: DataFrame) -> DataFrame:
    none = {"rows_left": 0, "rows_right": 0, "coordinates_equal": True, "exact_values_equal": True, "common_positive_finite": 0}
    return cases.select("case").join(met, "case", "left").withColumns({name: F.coalesce(name, F.lit(x)) for name, x in none.items()})


def run_cases(left: Store, right: Store, cases: list[region.RegionCase], folder: str) -> DataFrame:
    """Answers all cases on both stores, keeps the results below ``folder`` as sorted dumps by case (``left``, ``right``), and their comparison as lines of JSON (``report``), which it returns."""
    spark = left.cells.sparkSession
    table = region.cases_table(spark, cases, left.genome)
    for name, store in (("left", left), ("right", right)):
        region.write_dumps(query_many(store, table), f"{folder}/{name}")
    read = lambda name: region.read_dumps(spark, f"{folder}/{name}")
    met = _told(table, compare.compare_results(read("left"), read("right"), ["case"]))
    met.write.json(f"{folder}/report")
    return spark.read.schema(met.schema).json(f"{folder}/report")


def expected_vectors(density: DataFrame, factors: DataFrame) -> list[container.Expected]:
    """Expected vectors (density: norm, bin_size, dist, density), with their factors by chromosome: one number for each bin of the longest chromosome."""
    values = density.groupBy("norm", "bin_size").agg(F.sort_array(F.collect_list(F.struct("dist", "density"))).alias("v"))
    scale: dict[tuple[str, int], dict[int, float]] = {}
    for r in factors.collect():
        scale.setdefault((r.norm, r.bin_size), {})[r.chr] = float(r.factor)
    rows = values.select("norm", "bin_size", F.transform("v", lambda x: x["density"]).alias("v")).orderBy("norm", "bin_size").collect()
    return [container.Expected(r.norm, r.bin_size, np.array(r.v, dtype=np.float32), scale.get((r.norm, r.bin_size), {})) for r in rows]


def export(store: Store, path: str) -> None:
    """The store as a V9 container."""
    named = [df if "norm" in df.columns else df.withColumn("norm", F.lit("NONE")) for df in (store.density, store.factors)]
    raw, normed = (expected_vectors(*[df.where(which) for df in named]) for which in ("norm = 'NONE'", "norm <> 'NONE'"))
    container.write(store.cells.sparkSession, path, store.genome, store.cells, store.whole_genome, raw, normed, store.vectors, store.depth_base, store.scaling_factor)


_PARTS = ("whole_genome", "zooms", "density", "factors", "counters", "vectors", "status", "between")


def save(store: Store, folder: str) -> None:
    """The store as Parquet: cells by bin size and chromosomes, sorted by block, so that queries read little."""
    keys = ["bin_size", "chr1", "chr2"]
    spread = F.floor(F.col("block_number") / 64)
    store.cells.repartition(*keys, spread).sortWithinPartitions(*keys, "block_number").write.partitionBy(*keys).parquet(f"{folder}/cells")
    for name in _PARTS:
        part = getattr(store, name)
        if part is not None:
            part.write.parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, genome: Genome) -> Store:
    parts = {}
    for name in _PARTS:
        try:
            parts[name] = spark.read.parquet(f"{folder}/{name}")
        except Exception as error:
            if name not in ("vectors", "status", "between") or "PATH_NOT_FOUND" not in str(error):
                raise
            parts[name] = None
    return Store(genome, spark.read.parquet(f"{folder}/cells"), **parts)


def register(store: Store, prefix: str) -> None:
    """The store's frames as views, for SQL."""
    for name in ("cells", *_PARTS):
        part = getattr(store, name)
        if part is not None:
            part.createOrReplaceTempView(f"{prefix}_{name}")
