"""How contact counts fall with distance: histograms, possible distances, smoothed density and scale factors.

The histogram comes from cells within chromosomes, by distance in bins; totals of
a chromosome count before the range check. Between chromosomes the model is their mean. The density is a sequential smoothing
over at most one number for each bin of the longest chromosome, so a resolution is
one small group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.functions.blocks import div
from contactspark.genome import Genome
from contactspark.session import ship

#: Contacts that a window should hold.
ENOUGH = 400.0


def distances(cell_rows: DataFrame, weight: Column | None = None, keys: tuple[str, ...] = ("bin_size",)) -> DataFrame:
    """keys, chr, dist, weight summed over cells within chromosomes (by default what scores above 0 gave)."""
    weight = F.col("pos_count") if weight is None else weight
    intra = cell_rows.where("chr1 = chr2").select(*keys, F.col("chr1").alias("chr"), F.abs(F.col("bin1") - F.col("bin2")).alias("dist"), weight.alias("weight"))
    return intra.where("weight > 0").groupBy(*keys, "chr", "dist").agg(F.sum("weight").alias("weight"))


def histogram(by_chr: DataFrame, genome: Genome, keys: tuple[str, ...] = ("bin_size",)) -> DataFrame:
    """keys, dist, weight over all chromosomes; distances beyond the longest chromosome don't count."""
    longest = max(genome.lengths().values())
    within = F.col("dist") < div(F.lit(longest), F.col("bin_size")) + 1  # in the sum: as a filter it would be computed for each contact again
    return by_chr.groupBy(*keys, "dist").agg(F.sum(F.when(within, F.col("weight"))).alias("weight")).where("weight is not null")


def chromosome_totals(by_chr: DataFrame, keys: tuple[str, ...] = ("bin_size",)) -> DataFrame:
    return by_chr.groupBy(*keys, "chr").agg(F.sum("weight").alias("total"))


def possible_distances(totals: DataFrame, genome: Genome, keys: tuple[str, ...] = ("bin_size",)) -> DataFrame:
    """keys, dist, possible: pairs of bins at a distance, over the chromosomes that have contacts.

    A chromosome of n bins adds n - d for each d below n. Summed by cumulation: those
    that reach beyond d are counted from the far end.
    """
    lengths = F.create_map(*[F.lit(x) for kv in genome.lengths().items() for x in kv])
    bins = totals.select(*keys, div(F.try_element_at(lengths, F.col("chr")), F.col("bin_size")).alias("n")).where("n > 0")
    ends = bins.groupBy(*keys, "n").agg(F.count("*").alias("k"))
    far = Window.partitionBy(*keys).orderBy(F.desc("n"))
    reach = ends.select(*keys, "n", F.sum("k").over(far).alias("k"), F.sum(F.col("n") * F.col("k")).over(far).alias("nk"), F.coalesce(F.lead("n").over(far), F.lit(0)).alias("low"))
    spread = reach.select(*keys, "k", "nk", F.explode(F.sequence("low", F.col("n") - 1)).alias("dist"))
    return spread.select(*keys, F.col("dist").cast("int").alias("dist"), (F.col("nk") - F.col("k") * F.col("dist")).alias("possible"))


def between(cell_rows: DataFrame, genome: Genome, weight: Column | None = None, keys: tuple[str, ...] = ("bin_size",)) -> DataFrame:
    """keys, chr1, chr2, expected: of two different chromosomes the weight (by default what scores above 0 gave) of all cells over the pairs of bins they may have. There is no distance between chromosomes, so one value holds for all cells."""
    weight = F.col("pos_count") if weight is None else weight
    lengths = F.create_map(*[F.lit(x) for kv in genome.lengths().items() for x in kv])
    apart = cell_rows.where("chr1 <> chr2").select(*keys, "chr1", "chr2", weight.alias("weight")).where("weight > 0")
    sums = apart.groupBy(*keys, "chr1", "chr2").agg(F.sum("weight").alias("weight"))
    bins = [F.greatest(div(F.try_element_at(lengths, F.col(f"chr{e}")), F.col("bin_size")), F.lit(1)) for e in "12"]
    return sums.select(*keys, "chr1", "chr2", (F.col("weight").cast("double") / bins[0] / bins[1]).alias("expected"))


def smooth(actual: np.ndarray, possible: np.ndarray, reach: int, enough: float = ENOUGH) -> np.ndarray:
    """Density by distance: contacts over possible pairs within a window that widens until it holds enough.

    The window [low, high] gains bins at its far end while it holds too little; else it
    loses one at each end as long as enough remains. From one distance to the next its
    far end moves on by up to two.
    """
    if reach <= 0:
        return np.zeros(1, dtype=np.float32)
    n = len(actual)
    density = np.zeros(reach, dtype=np.float32)
    low = high = 0
    held, pairs = float(actual[0]), float(possible[0])
    for i in range(reach):
        if held < enough:
            while held < enough and high < reach:
                high += 1
                if high < n:
                    held += actual[high]
                    pairs += possible[high]
        else:
            while high > low and low < n and high < n and held - actual[low] - actual[high] >= enough:
                held -= actual[low] + actual[high]
                pairs -= possible[low] + possible[high]
                low, high = low + 1, high - 1
        density[i] = held / pairs if pairs > 0 else 0.0
        for _ in range(2 if high + 2 < reach else 1 if high + 1 < reach else 0):
            high += 1
            held += actual[high]
            pairs += possible[high]
    return density


def density(hist: DataFrame, possible: DataFrame, genome: Genome, keys: tuple[str, ...] = ("bin_size",)) -> DataFrame:
    """keys, dist, density (float)."""
    ship(hist.sparkSession)
    longest = max(genome.lengths().values())
    both = hist.join(possible, [*keys, "dist"], "full").select(*keys, "dist", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"), F.coalesce("possible", F.lit(0)).cast("double").alias("possible"))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", dist int, density float"

    def group(part: pd.DataFrame) -> pd.DataFrame:
        size = int(part["bin_size"].iat[0])
        actual, room = np.zeros(longest // size + 1), np.zeros(longest // size + 1)
        dist = part["dist"].to_numpy()
        actual[dist], room[dist] = part["weight"], part["possible"]
        reach = int(dist[part["possible"].to_numpy() > 0].max(initial=-1)) + 1
        values = smooth(actual, room, reach)
        return pd.DataFrame({**{k: part[k].iat[0] for k in keys}, "dist": np.arange(len(values), dtype=np.int32), "density": values})

    return both.groupBy(*keys).applyInPandas(group, schema)


def scale_factors(dense: DataFrame, totals: DataFrame, genome: Genome, keys: tuple[str, ...] = ("bin_size",)) -> DataFrame:
    """keys, chr, factor (float): what the density expects of a chromosome over what it has. Expected counts are density / factor."""
    lengths = F.create_map(*[F.lit(x) for kv in genome.lengths().items() for x in kv])
    t = totals.withColumn("n", div(F.try_element_at(lengths, F.col("chr")), F.col("bin_size")))
    met = t.join(dense, list(keys)).where("dist < n").groupBy(*keys, "chr", "total").agg(F.sum((F.col("n") - F.col("dist")) * F.col("density").cast("double")).alias("expected"))
    return met.where("expected > 0 and total > 0").select(*keys, "chr", (F.col("expected") / F.col("total")).cast("float").alias("factor"))
