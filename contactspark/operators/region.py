"""Region queries: observed or observed / expected counts of two regions at a resolution, raw or normalised."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.functions.blocks import div
from contactspark.functions.parse import usable
from contactspark.genome import Genome


def parse_region(text: str, genome: Genome) -> tuple[int, int, int]:
    """Chromosome index, start and end of ``chr`` or ``chr:start:end``."""
    name, *ends = text.split(":")
    index = genome.aliases().get(name.lower())
    if not index:
        raise ValueError(f"unknown chromosome {name!r}")
    if len(ends) not in (0, 2):
        raise ValueError(f"a region is chr or chr:start:end, not {text!r}")
    start, end = map(int, ends) if ends else (0, genome.lengths()[index])
    return index, start, end


def select(cell_rows: DataFrame, region1: tuple[int, int, int], region2: tuple[int, int, int], bin_size: int) -> DataFrame:
    """Cells of one matrix whose bins overlap the regions (ends included). A matrix within a chromosome is searched on both sides of its diagonal.

    All conditions are on columns that a store is partitioned or sorted by, so the scan is pruned.
    """
    (c1, s1, e1), (c2, s2, e2) = sorted([region1, region2], key=lambda r: r[0]) if region1[0] > region2[0] else (region1, region2)
    inside = lambda name, s, e: F.col(name).between(s // bin_size, e // bin_size)
    hit = inside("bin1", s1, e1) & inside("bin2", s2, e2)
    if c1 == c2:
        hit = hit | (inside("bin1", s2, e2) & inside("bin2", s1, e1))
    return cell_rows.where((F.col("bin_size") == bin_size) & (F.col("chr1") == c1) & (F.col("chr2") == c2) & hit)


def query(cell_rows: DataFrame, region1: tuple[int, int, int], region2: tuple[int, int, int], bin_size: int, vectors: DataFrame | None = None, norm: str = "NONE", density: DataFrame | None = None, factors: DataFrame | None = None, between: DataFrame | None = None) -> DataFrame:
    """x, y (bin starts in base pairs) and value. With ``vectors``, count / (n1 n2); with ``density`` and ``factors``, over the expected value too, which between chromosomes is that of ``between``.

    Cells whose bins have no usable norm, or whose distance has no expected value,
    are left out. An absent vector or expected value is an error, but two chromosomes
    without contacts have none.
    """
    own = select(cell_rows, region1, region2, bin_size)
    value = F.col("count")
    c1, c2 = sorted([region1[0], region2[0]])
    if norm != "NONE":
        mine = vectors.where((F.col("norm") == norm) & (F.col("bin_size") == bin_size) & F.col("chr").isin(c1, c2))
        there = {r.chr for r in mine.select("chr").distinct().collect()}
        if not {c1, c2} <= there:
            raise ValueError(f"there is no {norm} vector of chromosome {min({c1, c2} - there)} at {bin_size}")
        for end in "12":
            side = mine.select(F.col("chr").alias(f"chr{end}"), F.col("bin").alias(f"bin{end}"), F.col("value").alias(f"n{end}"))
            own = own.join(side, [f"chr{end}", f"bin{end}"])
        own = own.where(usable(F.col("n1")) & usable(F.col("n2")))
        value = value / (F.col("n1") * F.col("n2"))
    if density is not None and c1 == c2:
        dense = density.where(F.col("bin_size") == bin_size).select("dist", "density")
        own = own.withColumn("dist", F.abs(F.col("bin1") - F.col("bin2"))).join(dense, "dist")
        factor = factors.where((F.col("bin_size") == bin_size) & (F.col("chr") == c1)).select("factor").limit(1).collect()
        if not factor:
            raise ValueError(f"there is no expected value for chromosome {c1} at {bin_size}")
        expected = F.col("density").cast("double") / F.lit(float(factor[0].factor))
        own, value = own.where("density > 0"), value / expected
    elif density is not None:
        means = None if between is None else between.where(F.col("bin_size") == bin_size)
        if means is None or means.isEmpty():
            raise ValueError(f"there is no expected value between chromosomes at {bin_size}")
        own = own.join(F.broadcast(means.select("chr1", "chr2", "expected")), ["chr1", "chr2"])  # a row for each pair of chromosomes
        value = value / F.col("expected")
    return own.select(*_places(), value.cast("float").alias("value"))


def _places() -> list[Column]:
    return [(F.col(f"bin{e}").cast("bigint") * F.col("bin_size")).cast("int").alias(name) for e, name in (("1", "x"), ("2", "y"))]


#: What names a region pair once its chromosomes are in order: bin size, chromosomes, first and last bins.
REGION = ["bin_size", "chr1", "first1", "last1", "chr2", "first2", "last2"]
#: Tiles that a region's side spans at most (and one), and region pairs up to which their tiles (at most 25 each) are broadcast.
SPAN, FEW = 4, 5000


def ordered_cases(cases: DataFrame) -> DataFrame:
    """``REGION``, case, norm, observed of ``cases`` (case, bin_size, chr1, start1, end1, chr2, start2, end2, norm, observed)."""
    turned = F.col("chr1") > F.col("chr2")
    ends = []
    for own, other in (("1", "2"), ("2", "1")):
        pick = lambda name, own=own, other=other: F.when(turned, F.col(f"{name}{other}")).otherwise(F.col(f"{name}{own}"))
        ends += [pick("chr").alias(f"chr{own}"), div(pick("start"), F.col("bin_size")).alias(f"first{own}"), div(pick("end"), F.col("bin_size")).alias(f"last{own}")]
    return cases.select("case", "bin_size", *ends, "norm", "observed")


def _level() -> Column:
    """Follows a region pair's wider side, so that it touches few tiles however wide it is."""
    wide = F.greatest(F.col("last1") - F.col("first1"), F.col("last2") - F.col("first2"))
    return F.when(wide < SPAN, 0).otherwise(F.length(F.bin(div(wide, F.lit(SPAN))))).cast("int")


def tiles(regions: DataFrame) -> DataFrame:
    """The tiles that hold a region pair's bins: ``REGION``, level, tile1, tile2. Bins share a tile if they are equal but for their last ``level`` bits.

    Within a chromosome tiles of the mirrored pair count too; each is named once, and,
    as cells are, on one side of the diagonal.
    """
    tile = lambda name: F.expr(f"shiftright({name}, level)")
    spans = regions.select(*REGION, _level().alias("level"))
    spans = spans.select("*", *[F.sequence(tile(f"first{e}"), tile(f"last{e}")).alias(f"side{e}") for e in "12"])
    pair = lambda x, y: F.struct(x.alias("tile1"), y.alias("tile2"))
    pairs = F.flatten(F.transform("side1", lambda x: F.transform("side2", lambda y: pair(x, y))))
    ordered = F.array_distinct(F.transform(pairs, lambda p: pair(F.least(p["tile1"], p["tile2"]), F.greatest(p["tile1"], p["tile2"]))))
    named = F.when(F.col("chr1") == F.col("chr2"), ordered).otherwise(pairs)
    return spans.select(*REGION, "level", F.explode(named).alias("t")).select(*REGION, "level", "t.*")


def select_many(cell_rows: DataFrame, regions: DataFrame, few: bool) -> DataFrame:
    """Cells of each of ``regions`` (distinct ``REGION`` rows), with these columns, in one pass over the cells: an interval join.

    A cell is hashed to its tile at each level that any region of its matrix has, meets
    the regions that touch this tile, and is tested exactly. Matrices that no region asks
    for are pruned. ``few``: whether the regions' tiles are broadcast.
    """
    asked = tiles(regions)
    matrix = ["bin_size", "chr1", "chr2"]
    levels = regions.select(*matrix, _level().alias("level")).groupBy(*matrix).agg(F.collect_set("level").alias("levels"))  # a row for each matrix of the genome at most
    own = cell_rows.select(*matrix, "bin1", "bin2", "count").join(F.broadcast(levels), matrix)
    own = own.select(*matrix, "bin1", "bin2", "count", F.explode("levels").alias("level"))
    own = own.withColumns({f"tile{e}": F.expr(f"shiftright(cast(bin{e} as bigint), level)") for e in "12"})
    inside = lambda name, e: F.col(name).between(F.col(f"first{e}"), F.col(f"last{e}"))
    hit = (inside("bin1", "1") & inside("bin2", "2")) | ((F.col("chr1") == F.col("chr2")) & inside("bin1", "2") & inside("bin2", "1"))
    # many tiles are more than their regions' table shows, so they are never broadcast by its size
    met = own.join(F.broadcast(asked) if few else asked.hint("merge"), [*matrix, "level", "tile1", "tile2"]).where(hit)
    return met.select(*REGION, "bin1", "bin2", "count")


def _require(wanted: DataFrame, there: DataFrame | None, keys: list[str], what: str) -> None:
    lacking = wanted if there is None else wanted.join(there.select(*keys).distinct(), keys, "left_anti")
    bad = lacking.orderBy(*keys).limit(1).collect()
    if bad:
        raise ValueError(f"there is no {what} for " + ", ".join(f"{k} {bad[0][k]}" for k in keys))


def query_many(cell_rows: DataFrame, cases: DataFrame, vectors: DataFrame | None = None, density: DataFrame | None = None, factors: DataFrame | None = None, between: DataFrame | None = None) -> DataFrame:
    """case, x, y, value of many region queries at once, as ``query`` gives them one by one; cells are read once.

    ``cases``: case, bin_size, chr1, start1, end1, chr2, start2, end2, norm, observed.
    Cases that differ in norm or model only share their regions. ``density``, ``factors``
    and ``between`` have a column norm, or hold the raw model. An absent vector is an
    error, and so is a norm without a model at a bin size; of a chromosome that has no
    expected value (none of its contacts, or none of its bins, count) no rows are given.
    """
    normed = lambda df: df if df is None or "norm" in df.columns else df.withColumn("norm", F.lit("NONE"))
    density, factors, between = normed(density), normed(factors), normed(between)
    all_cases = ordered_cases(cases)
    mixed = all_cases.groupBy("norm", "observed").agg(F.count("*").alias("n")).collect()  # a row for each norm and model
    regions = all_cases.select(*REGION).distinct()
    few = sum(r.n for r in mixed) <= FEW
    found = select_many(cell_rows, regions, few)
    found = found.join(F.broadcast(all_cases) if few else all_cases, REGION)
    value = F.col("count")
    if any(r.norm != "NONE" for r in mixed):
        ends = all_cases.where("norm <> 'NONE'").select("norm", "bin_size", F.explode(F.array("chr1", "chr2")).alias("chr")).distinct()
        _require(ends, vectors, ["norm", "bin_size", "chr"], "vector")
        for e in "12":
            side = vectors.select("norm", "bin_size", F.col("chr").alias(f"chr{e}"), F.col("bin").alias(f"bin{e}"), F.col("value").alias(f"n{e}"))
            found = found.join(side, ["norm", "bin_size", f"chr{e}", f"bin{e}"], "left")
        raw = F.col("norm") == "NONE"
        found = found.where(raw | F.coalesce(usable(F.col("n1")) & usable(F.col("n2")), F.lit(False)))
        value = F.when(raw, value).otherwise(F.try_divide(value, F.col("n1") * F.col("n2")))
    if not all(r.observed for r in mixed):
        modelled = all_cases.where("not observed")
        _require(modelled.where("chr1 = chr2").select("norm", "bin_size").distinct(), factors, ["norm", "bin_size"], "expected value")
        _require(modelled.where("chr1 <> chr2").select("norm", "bin_size").distinct(), between, ["norm", "bin_size"], "expected value between chromosomes")
        far = F.when(F.col("chr1") == F.col("chr2"), F.abs(F.col("bin1") - F.col("bin2")))
        found = found.withColumn("dist", far)
        if density is not None:
            found = found.join(density.select("norm", "bin_size", "dist", "density"), ["norm", "bin_size", "dist"], "left")
            found = found.join(factors.select("norm", "bin_size", F.col("chr").alias("chr1"), "factor"), ["norm", "bin_size", "chr1"], "left")
        if between is not None:
            found = found.join(between.select("norm", "bin_size", "chr1", "chr2", "expected"), ["norm", "bin_size", "chr1", "chr2"], "left")
        one = F.when(F.col("density") > 0, F.col("density").cast("double") / F.col("factor")) if density is not None else F.lit(None).cast("double")
        two = F.col("expected") if between is not None else F.lit(None).cast("double")
        expected = F.when(F.col("chr1") == F.col("chr2"), one).otherwise(two)
        value = F.when(F.col("observed"), value).otherwise(F.try_divide(value, expected))
    return found.select("case", *_places(), value.cast("float").alias("value")).where("value is not null")


def shortest(value: Column, digits: int = 12) -> Column:
    """A number in at most so many significant digits, without zeros at the end, as C prints it with %g."""
    long_ = F.format_string(f"%.{digits}g", value)
    short = F.regexp_replace(F.regexp_replace(long_, r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    endless = F.when(value > 0, "inf").otherwise("-inf")
    return F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), endless).otherwise(short)


def write_dump(result: DataFrame, path: str) -> None:
    """Tab-separated x, y, value (twelve significant digits), sorted; each part a sorted range."""
    text = result.orderBy("x", "y").select("x", "y", shortest(F.col("value").cast("double")).alias("value"))
    text.write.csv(path, sep="\t")


def write_dumps(results: DataFrame, folder: str) -> None:
    """The dumps of many cases (case, x, y, value), a folder for each; a case's rows are sorted in ranges, so that a large one is many parts."""
    text = results.select("case", "x", "y", shortest(F.col("value").cast("double")).alias("value"))
    text.repartitionByRange("case", "x", "y").sortWithinPartitions("case", "x", "y").write.partitionBy("case").csv(folder, sep="\t")


def read_dumps(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.csv(folder, sep="\t", schema="x int, y int, value float, case string")


def read_dump(spark, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="x int, y int, value float")


@dataclass(frozen=True)
class RegionCase:
    """A region query of a set."""

    name: str
    resolution: int
    region1: str
    region2: str
    observed: bool
    norm: str


def random_cases(genome: Genome, resolutions: list[int], norms: tuple[str, ...] = ("NONE", "VC", "VC_SQRT", "SCALE"), pairs: int = 1, bins: int = 25, least: int = 2_000_000) -> list[RegionCase]:
    """A fixed set: at each resolution ``pairs`` region pairs within a chromosome and as many between two, each observed and over expected and with each norm.

    A region has ``bins`` bins, and ``least`` base pairs at least, as far as its chromosome
    reaches. Chromosomes and starts come from a hash of what the pair is: its kind,
    resolution and number.
    """
    lengths = genome.lengths()

    def drawn(below: int, *what) -> int:
        return int.from_bytes(hashlib.blake2b(repr(what).encode(), digest_size=8).digest()) % max(1, below)

    def region(chromosome: int, resolution: int, *what) -> str:
        width = min(lengths[chromosome], max(bins * resolution, least))
        start = drawn(lengths[chromosome] - width + 1, *what) // resolution * resolution
        return f"{genome.chromosomes[chromosome - 1][0]}:{start}:{start + width}"

    found = []
    for resolution in resolutions:
        for number in range(pairs):
            one = 1 + drawn(len(lengths), "first", resolution, number)
            two = 1 + (one + drawn(len(lengths) - 1, "second", resolution, number)) % len(lengths)
            for kind, ends in {"within": (one, one), "between": (one, two)}.items():
                if kind == "between" and one == two:
                    continue
                regions = [region(c, resolution, kind, resolution, number, e) for e, c in enumerate(ends)]
                for norm in norms:
                    found += [RegionCase(f"{kind}_{resolution}_{number}_{'observed' if seen else 'oe'}_{norm}", resolution, *regions, seen, norm) for seen in (True, False)]
    return found


def cases_table(spark: SparkSession, cases: list[RegionCase], genome: Genome) -> DataFrame:
    """The cases as ``query_many`` takes them."""
    rows = [(c.name, c.resolution, *parse_region(c.region1, genome), *parse_region(c.region2, genome), c.norm, c.observed) for c in cases]
    return spark.createDataFrame(rows, "case string, bin_size int, chr1 int, start1 bigint, end1 bigint, chr2 int, start2 bigint, end2 bigint, norm string, observed boolean")
