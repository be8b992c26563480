"""Genomes: chromosome tables, their aliases and offsets.

Index 0 is the whole genome (``ALL``, its length in kilobases); chromosomes count
from 1 in file order. Names are matched without regard to case, with and without
a leading ``chr``; where two chromosomes claim one alias, the later has it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ALL = "ALL"
#: Bins that the whole-genome matrix is cut into about, and base pairs in its unit.
WHOLE_GENOME_BINS, KB = 500, 1000

# Public assembly lengths of chromosomes, in their files' order.
ASSEMBLIES = {
    "hg19": """1 249250621 2 243199373 3 198022430 4 191154276 5 180915260 6 171115067 7 159138663 8 146364022 9 141213431 10 135534747
        11 135006516 12 133851895 13 115169878 14 107349540 15 102531392 16 90354753 17 81195210 18 78077248 19 59128983 20 63025520
        21 48129895 22 51304566 X 155270560 Y 59373566 MT 16569""",
    "hg38": """chr1 248956422 chr2 242193529 chr3 198295559 chr4 190214555 chr5 181538259 chr6 170805979 chr7 159345973 chr8 145138636
        chr9 138394717 chr10 133797422 chr11 135086622 chr12 133275309 chr13 114364328 chr14 107043718 chr15 101991189 chr16 90338345
        chr17 83257441 chr18 80373285 chr19 58617616 chr20 64444167 chr21 46709983 chr22 50818468 chrX 156040895 chrY 57227415 chrM 16569""",
    "mm9": """chr1 197195432 chr2 181748087 chr3 159599783 chr4 155630120 chr5 152537259 chr6 149517037 chr7 152524553 chr8 131738871
        chr9 124076172 chr10 129993255 chr11 121843856 chr12 121257530 chr13 120284312 chr14 125194864 chr15 103494974 chr16 98319150
        chr17 95272651 chr18 90772031 chr19 61342430 chrX 166650296 chrY 15902555 chrM 16300""",
    "mm10": """chr1 195471971 chr2 182113224 chr3 160039680 chr4 156508116 chr5 151834684 chr6 149736546 chr7 145441459 chr8 129401213
        chr9 124595110 chr10 130694993 chr11 122082543 chr12 120129022 chr13 120421639 chr14 124902244 chr15 104043685 chr16 98207768
        chr17 94987271 chr18 90702639 chr19 61431566 chrM 16299 chrX 171031299 chrY 91744698""",
}


@dataclass(frozen=True)
class Genome:
    """Chromosomes (name, length) in order; ``id`` is what containers record."""

    chromosomes: tuple[tuple[str, int], ...]
    id: str = ""

    @property
    def total(self) -> int:
        return sum(n for _, n in self.chromosomes)

    @property
    def whole_genome_bin(self) -> int:
        return max(1, self.total // KB // WHOLE_GENOME_BINS)

    def lengths(self) -> dict[int, int]:
        return dict(enumerate((n for _, n in self.chromosomes), 1))

    def aliases(self) -> dict[str, int]:
        """Every name that finds a chromosome, in lower case."""
        found = {ALL.lower(): 0}
        for i, (name, _) in enumerate(self.chromosomes, 1):
            low = name.lower()
            found[low] = i
            found[low[3:] if low.startswith("chr") else f"chr{low}"] = i
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        """index, name, length, and offset: the lengths of all chromosomes before."""
        rows = spark.createDataFrame([(i, name, n) for i, (name, n) in enumerate(self.chromosomes, 1)], "index int, name string, length bigint")
        before = Window.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))

    def alias_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.aliases().items()), "alias string, index int")


def built_in(name: str) -> Genome:
    """A built-in assembly by name, in any case."""
    key = name.lower()
    if key not in ASSEMBLIES:
        raise ValueError(f"unknown genome {name!r}; built in are {', '.join(ASSEMBLIES)}")
    words = ASSEMBLIES[key].split()
    return Genome(tuple(zip(words[::2], map(int, words[1::2]), strict=True)), key)


def from_sizes(spark: SparkSession, path: str, genome_id: str = "") -> Genome:
    """A chrom.sizes file (name and length parted by white space; comments, blank and unreadable lines are skipped)."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(parts[0].alias("name"), F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("length"), F.monotonically_increasing_id().alias("n"))
    found = rows.where("length is not null and name <> ''").orderBy("n").collect()
    if not found:
        raise ValueError(f"no chromosomes in {path}")
    return Genome(tuple((r.name, r.length) for r in found), genome_id)


def genome(spark: SparkSession, spec: str | Genome) -> Genome:
    """A genome from a built-in name, a chrom.sizes path or itself."""
    if isinstance(spec, Genome):
        return spec
    return built_in(spec) if spec.lower() in ASSEMBLIES else from_sizes(spark, spec)
