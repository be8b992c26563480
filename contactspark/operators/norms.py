"""Normalisation vectors: coverage (VC), its square root (VC_SQRT) and balancing (SCALE), and what is normalised with them.

Only matrices within a chromosome are normalised, and only their cells with a
count above 0. Coverage is built-in expressions; balancing is a grouped map with
one matrix to a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.functions.blocks import div
from contactspark.functions.parse import positive_finite, usable
from contactspark.genome import Genome
from contactspark.operators import scale
from contactspark.session import ship

NORMS = ("VC", "VC_SQRT", "SCALE")
#: Cells of a matrix that one task balances in memory (about 100 bytes each, with pandas' copies and what a product takes).
GROUP_CELLS = 4_000_000
#: Bins of all matrices up to which a vector (some 20 bytes for each) is broadcast to the cells; beyond, cells are dealt by bin.
BROADCAST_BINS = 1_000_000


def intra(cell_rows: DataFrame) -> DataFrame:
    """chr, bin_size, bin1, bin2 (in order), count of cells above 0 within chromosomes."""
    own = cell_rows.where("chr1 = chr2 and count > 0")
    return own.select(F.col("chr1").alias("chr"), "bin_size", F.least("bin1", "bin2").alias("bin1"), F.greatest("bin1", "bin2").alias("bin2"), "count")


def both_ways(own: DataFrame) -> DataFrame:
    """chr, bin_size, bin, other, count: each cell from both of its bins, those on the diagonal once. One pass, no union."""
    ends = F.when(F.col("bin1") == F.col("bin2"), F.array(F.struct(F.col("bin1").alias("bin"), F.col("bin2").alias("other")))).otherwise(
        F.array(F.struct(F.col("bin1").alias("bin"), F.col("bin2").alias("other")), F.struct(F.col("bin2").alias("bin"), F.col("bin1").alias("other")))
    )
    return own.select("chr", "bin_size", "count", F.explode(ends).alias("e")).select("chr", "bin_size", "e.bin", "e.other", "count")


def coverage(own: DataFrame) -> DataFrame:
    """chr, bin_size, bin, value: sums of the symmetric matrix's rows (bins without contacts have no row)."""
    return both_ways(own).groupBy("chr", "bin_size", "bin").agg(F.sum("count").alias("value"))


def densify(vector: DataFrame, own: DataFrame, genome: Genome, fill: float = 0.0) -> DataFrame:
    """A value for every bin of the chromosomes that have a matrix: length / bin_size + 1 of them."""
    lengths = F.create_map(*[F.lit(x) for kv in genome.lengths().items() for x in kv])
    matrices = own.select("chr", "bin_size").distinct()
    bins = matrices.withColumn("bin", F.explode(F.sequence(F.lit(0), div(F.try_element_at(lengths, F.col("chr")), F.col("bin_size")).cast("int"))))
    return bins.join(vector, ["chr", "bin_size", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def bins_of(genome: Genome, sizes: list[int]) -> int:
    """How many values a full vector has over all chromosomes at these bin sizes: a bound on a vector's rows that needs no job."""
    return sum(n // size + 1 for n in genome.lengths().values() for size in sizes)


def on_cells(own: DataFrame, vector: DataFrame, bins: int | None = None) -> DataFrame:
    """Cells with n1 and n2, the vector's values at their bins; two hash joins on (chr, bin_size, bin). With ``bins``, a bound of its rows, a vector of few is broadcast, and cells stay where they are."""
    if bins is not None and bins <= BROADCAST_BINS:
        vector = F.broadcast(vector)
    one = vector.select("chr", "bin_size", F.col("bin").alias("bin1"), F.col("value").alias("n1"))
    two = vector.select("chr", "bin_size", F.col("bin").alias("bin2"), F.col("value").alias("n2"))
    return own.join(one, ["chr", "bin_size", "bin1"]).join(two, ["chr", "bin_size", "bin2"])


def sum_factor(own: DataFrame, vector: DataFrame, bins: int | None = None) -> DataFrame:
    """chr, bin_size, factor: the root of normalised over raw counts, so that a matrix keeps its sum; none where either is 0."""
    good = on_cells(own, vector, bins).where(positive_finite(F.col("n1")) & positive_finite(F.col("n2")))
    times = F.when(F.col("bin1") == F.col("bin2"), 1).otherwise(2)
    sums = good.groupBy("chr", "bin_size").agg(F.sum(times * F.col("count")).alias("raw"), F.sum(times * F.col("count") / (F.col("n1") * F.col("n2"))).alias("normed"))
    return sums.where("raw > 0 and normed > 0").select("chr", "bin_size", F.sqrt(F.col("normed") / F.col("raw")).cast("float").alias("factor"))


def rescale(vector: DataFrame, factors: DataFrame) -> DataFrame:
    """The vector times its matrix's factor, where values are positive and finite."""
    met = vector.join(factors, ["chr", "bin_size"], "left")
    changed = F.when(F.col("factor").isNotNull() & positive_finite(F.col("value")), F.col("value") * F.col("factor")).otherwise(F.col("value"))
    return met.withColumn("value", changed).drop("factor")


def vc(own: DataFrame, bins: int | None = None) -> DataFrame:
    raw = coverage(own)
    return rescale(raw, sum_factor(own, raw, bins))


def vc_sqrt(own: DataFrame, bins: int | None = None) -> DataFrame:
    """From the unscaled coverage."""
    root = coverage(own).withColumn("value", F.sqrt("value"))
    return rescale(root, sum_factor(own, root, bins))


def scaled(own: DataFrame, genome: Genome, tol: float = scale.TOLERANCE, max_iter: int = scale.TOTAL_ITERATIONS, min_res: int = 0, group_cells: int = GROUP_CELLS, diagonal_width: int = -1, bins: int | None = None) -> DataFrame:
    """chr, bin_size, bin, value of SCALE, NaN on masked bins; matrices that can't be balanced have no rows.

    A matrix of at most ``group_cells`` cells is balanced by one task; larger ones
    together, their cells spread over executors, in as many jobs as one of them takes.
    """
    ship(own.sparkSession)
    lengths = genome.lengths()

    def group(part: pd.DataFrame) -> pd.DataFrame:
        chr_, size = int(part["chr"].iat[0]), int(part["bin_size"].iat[0])
        n = lengths[chr_] // size + 1
        got = scale.balance(part["bin1"].to_numpy(), part["bin2"].to_numpy(), part["count"].to_numpy(dtype=np.float64), n, tol=tol, total_iterations=max_iter, diagonal_width=diagonal_width)
        if got is None:
            return pd.DataFrame({"chr": [], "bin_size": [], "bin": [], "value": []}).astype({"chr": "int32", "bin_size": "int32", "bin": "int32", "value": "float64"})
        return pd.DataFrame({"chr": np.int32(chr_), "bin_size": np.int32(size), "bin": np.arange(n, dtype=np.int32), "value": got})

    wanted = own if not min_res else own.where(F.col("bin_size") >= min_res)
    sizes = wanted.groupBy("chr", "bin_size").count().collect()  # a row for each chromosome and resolution
    large = [(r.chr, r.bin_size) for r in sizes if r["count"] > group_cells]
    is_large = F.lit(False)
    for c, b in large:
        is_large = is_large | ((F.col("chr") == c) & (F.col("bin_size") == b))
    schema = "chr int, bin_size int, bin int, value double"
    raw = (wanted.where(~is_large) if large else wanted).groupBy("chr", "bin_size").applyInPandas(group, schema)
    if large:
        made = scale.balance_many(wanted.where(is_large), {(c, b): lengths[c] // b + 1 for c, b in large}, tol, max_iter, diagonal_width)
        for (c, b), got in made.items():
            if got is not None:
                raw = raw.unionByName(own.sparkSession.createDataFrame(pd.DataFrame({"chr": c, "bin_size": b, "bin": np.arange(len(got)), "value": got}), schema))
    raw = raw.withColumn("value", F.coalesce("value", F.lit(float("nan"))))  # Arrow made it null
    return rescale(raw, sum_factor(own, raw, bins))


def vectors(cell_rows: DataFrame, genome: Genome, norms: tuple[str, ...] = NORMS, bins: int | None = None, **options) -> DataFrame:
    """norm, chr, bin_size, bin, value (float): full vectors of the chosen norms. ``options`` are SCALE's; ``bins`` as for ``on_cells``."""
    own = intra(cell_rows)
    out = None
    for name in norms:
        if name == "SCALE":
            v = scaled(own, genome, bins=bins, **options)
        else:
            v = densify({"VC": vc, "VC_SQRT": vc_sqrt}[name](own, bins), own, genome)
        v = v.select(F.lit(name).alias("norm"), "chr", "bin_size", "bin", F.col("value").cast("float").alias("value"))
        out = v if out is None else out.unionByName(v)
    return out


def status(cell_rows: DataFrame, made: DataFrame, genome: Genome, sizes: list[int], norms: tuple[str, ...] = NORMS, min_res: int = 0) -> DataFrame:
    """norm, chr, bin_size, status for each chromosome and bin size: ``made``, ``no contacts``, ``not asked for`` (SCALE below ``min_res``) or ``not balanced``."""
    spark = cell_rows.sparkSession
    every = [(norm, c, size) for norm in norms for c in genome.lengths() for size in sizes]
    asked = spark.createDataFrame(every, "norm string, chr int, bin_size int")
    held = intra(cell_rows).groupBy("chr", "bin_size").agg(F.lit(True).alias("held"))
    found = made.groupBy("norm", "chr", "bin_size").agg(F.lit(True).alias("found"))
    met = asked.join(held, ["chr", "bin_size"], "left").join(found, ["norm", "chr", "bin_size"], "left")
    late = (F.col("norm") == "SCALE") & (F.col("bin_size") < min_res)
    told = F.when(F.col("found"), "made").when(F.col("held").isNull(), "no contacts").when(late, "not asked for").otherwise("not balanced")
    return met.select("norm", "chr", "bin_size", told.alias("status"))


def normalised(own: DataFrame, vector: DataFrame, bins: int | None = None) -> DataFrame:
    """Cells with ``value`` = count / (n1 n2); cells whose bins have no usable value are left out."""
    good = on_cells(own, vector, bins).where(usable(F.col("n1")) & usable(F.col("n2")))
    return good.withColumn("value", F.col("count") / (F.col("n1") * F.col("n2")))


def row_nonzeros(own: DataFrame) -> DataFrame:
    """chr, bin_size, bin, n: cells that a row of the symmetric matrix holds."""
    return both_ways(own).groupBy("chr", "bin_size", "bin").agg(F.count("*").alias("n"))


def coverage_stats(own: DataFrame) -> DataFrame:
    """chr, bin_size with rows that hold cells (n_rows), their mean and population deviation, the count a fifth of the way up, and the fewest cells a row should hold by mean and deviation.

    All from a histogram: of a matrix's rows by how many cells they hold, cumulated, so
    that no task holds more than the different counts. The sums are whole numbers and the
    bound is compared with them, so rounding can't move it where mean less deviation is whole.
    """
    keys = ["chr", "bin_size"]
    held = row_nonzeros(own).groupBy(*keys, "n").agg(F.count("*").alias("k"))
    upto, every = Window.partitionBy(*keys).orderBy("n"), Window.partitionBy(*keys)
    held = held.withColumns({"upto": F.sum("k").over(upto), "n_rows": F.sum("k").over(every)})
    place = F.floor(F.col("n_rows") * scale.PERCENTILE)
    whole = lambda x: x.cast("decimal(19,0)")
    squares = F.sum(whole(F.col("n") * F.col("n")) * whole(F.col("k")))
    s = held.groupBy(*keys).agg(F.first("n_rows").alias("n_rows"), F.sum(F.col("n") * F.col("k")).alias("s1"), squares.alias("s2"), F.min(F.when(F.col("upto") > place, F.col("n"))).alias("fifth"))
    s = s.withColumn("spread", whole(F.col("n_rows")) * F.col("s2") - whole(F.col("s1")) * whole(F.col("s1")))  # the variance times n_rows squared
    s = s.select(*keys, "n_rows", (F.col("s1") / F.col("n_rows")).alias("mean"), (F.sqrt(F.col("spread").cast("double")) / F.col("n_rows")).alias("deviation"), "fifth", "s1", "spread")

    def reached(bound: Column) -> Column:
        """Whether ``bound`` is at least the mean less the deviation."""
        short = F.col("s1") - bound * F.col("n_rows")
        return (short <= 0) | (whole(short) * whole(short) <= F.col("spread"))

    near = F.ceil(F.col("mean") - F.col("deviation"))
    bound = F.when(reached(near - 1), near - 1).when(reached(near), near).otherwise(near + 1)
    return s.withColumn("bound", F.greatest(F.lit(1), bound).cast("int")).drop("s1", "spread")
