"""Read pairs in text: the MND layouts, the short layout, and .pairs with a header.

All layouts give ``PAIRS``: chr1, pos1, strand1, frag1, mapq1 and the same for the
other end, and score. Lines whose chromosomes are unknown, and lines with too few
fields, are dropped; positions below 0 become 0. Files may be gzipped. Block gzip (BGZF)
on a mounted path is read by many tasks; another gzip file is one partition, so
``read_pairs`` spreads its rows after parsing when asked to.

With ``ordinal`` rows say where their line stood: file, the start of the range that a
task read, and place in it. These order lines as the files have them (files by name), and
no sort is needed to make them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.functions.parse import leading_float, leading_int
from contactspark.genome import Genome
from contactspark.sources import ranges

PAIRS = ["chr1", "pos1", "strand1", "frag1", "mapq1", "chr2", "pos2", "strand2", "frag2", "mapq2", "score"]
FORMATS = ("bin", "bn", "pairs", "mnd", "short")
#: MAPQ of layouts that hold none, most fields of a line that count, and header columns that count.
NO_MAPQ, MOST_FIELDS, MOST_COLUMNS = 1000, 17, 32


#: Where a line stood.
ORDINAL = "ordinal"


def _lines(spark: SparkSession, path: str | list[str], ordinal: bool = False) -> DataFrame:
    """The column value, and, if asked for, ``ORDINAL``."""
    paths = [path] if isinstance(path, str) else path
    files = [f for p in paths for f in ranges.listed(spark, p)] if all(p.endswith(".gz") for p in paths) else []
    if ranges.mounted(files) and all(ranges.is_bgzf(ranges.local(uri)) for uri, n in files if n):
        lines = ranges.read_lines(spark, files)
        return lines.select("value", F.struct("file", "start", "place").alias(ORDINAL)) if ordinal else lines.select("value")
    lines = spark.read.text(path)
    if not ordinal:
        return lines
    # ids rise within a split, which one task reads from its start to its end; across splits they need not
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    return lines.select("value", where.alias(ORDINAL))


def _also(rows: DataFrame) -> list[str]:
    return [ORDINAL] if ORDINAL in rows.columns else []


def detect_format(spark: SparkSession, path: str) -> str:
    """By suffix (``.gz`` aside), else by the first line that is no comment: four or five fields are ``short``."""
    if path.endswith(".bin"):
        return "bin"
    if path.endswith(".bn"):
        return "bn"
    plain = path.removesuffix(".gz")
    for suffix in ("pairs", "mnd"):
        if plain.endswith(f".{suffix}"):
            return suffix
    head = [r.value for r in _lines(spark, path).limit(1).collect()]
    if head and head[0].startswith("## pairs"):
        return "pairs"
    first = [r.value for r in _lines(spark, path).where(~F.col("value").startswith("#")).limit(1).collect()]
    return "short" if first and len(first[0].split()) in (4, 5) else "mnd"


def _fields(lines: DataFrame) -> DataFrame:
    """Data lines as an array ``f`` of fields, parted by runs of blanks and tabs.

    A line is split in a generator of one row, which neither filters nor projections
    that stand above are merged with: so it is split once, however many fields are asked for.
    """
    trimmed = F.trim("value", F.lit(" \t\r"))
    kept = lines.where(~F.col("value").startswith("#") & (trimmed != ""))
    return kept.select(*_also(lines), F.explode(F.array(F.split(trimmed, r"[ \t]+"))).alias("f"))


def _at(i: Column | int) -> Column:
    return F.get(F.col("f"), F.lit(i) if isinstance(i, int) else i)


def _position(field: Column) -> Column:
    return F.greatest(leading_int(field), F.lit(0))


def _strand(field: Column) -> Column:
    return F.when(F.substring(field, 1, 1).isin("1", "-"), 1).otherwise(0).cast("byte")


def _short(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.size("f") >= 4)
    score = F.when(F.size("f") >= 5, leading_float(_at(4))).otherwise(F.lit(1.0)).cast("float")
    zero, mapq = F.lit(0), F.lit(NO_MAPQ)
    ends = [_at(0).alias("n1"), _position(_at(1)).alias("pos1"), zero.cast("byte").alias("strand1"), zero.alias("frag1"), mapq.alias("mapq1")]
    ends += [_at(2).alias("n2"), _position(_at(3)).alias("pos2"), zero.cast("byte").alias("strand2"), zero.alias("frag2"), mapq.alias("mapq2")]
    return rows.select(*_also(rows), *ends, score.alias("score"))


def _mnd(rows: DataFrame, sam_flag_strands: bool) -> DataFrame:
    first = _at(0).isin("0", "1", "+", "-")
    if sam_flag_strands:
        first = first | _at(0).rlike("^[0-9]+$")
    rows = rows.select(*_also(rows), "f", F.when(first, 0).otherwise(1).alias("o"), F.least(F.size("f"), F.lit(MOST_FIELDS)).alias("n"))
    rows = rows.where(F.col("n") - F.col("o") >= 8)
    o, n = F.col("o"), F.col("n")
    long_ = (n == 16) & (o == 0)
    mapq1 = F.when(n - o >= 10, leading_int(_at(o + 8))).otherwise(NO_MAPQ)
    mapq2 = F.when(long_, leading_int(_at(11))).when(n - o >= 10, leading_int(_at(o + 9))).otherwise(NO_MAPQ)
    score = F.when((n == 9) & (o == 0), leading_float(_at(8))).when((n == 11) & (o == 0), leading_float(_at(10))).otherwise(F.lit(1.0))

    def strand(i: Column) -> Column:
        flag = F.when(_at(i).rlike("^[0-9]{2,}$"), leading_int(_at(i)).bitwiseAND(16) / 16).cast("byte")
        return F.coalesce(flag, _strand(_at(i))) if sam_flag_strands else _strand(_at(i))

    ends = []
    for k, end in ((0, "1"), (4, "2")):
        ends += [_at(o + 1 + k).alias(f"n{end}"), _position(_at(o + 2 + k)).alias(f"pos{end}"), strand(o + k).alias(f"strand{end}"), leading_int(_at(o + 3 + k)).alias(f"frag{end}")]
    return rows.select(*_also(rows), *ends, mapq1.cast("int").alias("mapq1"), mapq2.cast("int").alias("mapq2"), score.cast("float").alias("score"))


def pairs_columns(spark: SparkSession, path) -> tuple[str, ...]:
    """``path`` is a Hadoop path; the names that a .pairs file's ``#columns:`` line gives. Only its head is read, up to the first data line, by Spark's own file systems and codecs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        while (line := reader.readLine()) is not None:
            if line.startswith("#columns:"):
                return tuple(line[len("#columns:") :].split()[:MOST_COLUMNS])
            if line.strip() and not line.startswith("#"):
                break
    finally:
        stream.close()
    return ()


def _read_pairs_files(spark: SparkSession, path: str, ordinal: bool) -> DataFrame:
    """.pairs files, each by its own header; files of equal headers are one scan."""
    by: dict[tuple[str, ...], list[str]] = {}
    jvm = spark.sparkContext._jvm
    for file in sorted(spark.read.text(path).inputFiles()):
        one = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        by.setdefault(pairs_columns(spark, one), []).append(one.toString())
    parts = [_pairs(_lines(spark, files, ordinal), names) for names, files in sorted(by.items())]
    return reduce(DataFrame.unionByName, parts) if parts else _pairs(_lines(spark, path, ordinal), ())


def _pairs(lines: DataFrame, names: tuple[str, ...]) -> DataFrame:
    where = {name: i for i, name in reversed(list(enumerate(names)))}
    rows = _fields(lines).where(F.size("f") >= 5)

    def both(a: str, b: str, low: int, high: int) -> tuple[Column, Column]:
        """Two optional columns, of which a row has both or neither."""
        if a not in where or b not in where:
            return F.lit(low), F.lit(high)
        there = (F.size("f") > where[a]) & (F.size("f") > where[b])
        return F.when(there, leading_int(_at(where[a]))).otherwise(low), F.when(there, leading_int(_at(where[b]))).otherwise(high)

    frag = both("frag1", "frag2", 0, 1)
    mapq = both("mapq1", "mapq2", NO_MAPQ, NO_MAPQ)
    stranded = F.size("f") >= 7
    ends = []
    for k, end in enumerate("12"):
        strand = F.when(stranded & _at(5 + k).startswith("-"), 1).otherwise(0).cast("byte")
        ends += [_at(1 + 2 * k).alias(f"n{end}"), _position(_at(2 + 2 * k)).alias(f"pos{end}"), strand.alias(f"strand{end}"), frag[k].cast("int").alias(f"frag{end}"), mapq[k].cast("int").alias(f"mapq{end}")]
    return rows.select(*_also(rows), *ends, F.lit(1.0).cast("float").alias("score"))


def known_chromosomes(rows: DataFrame, genome: Genome) -> DataFrame:
    """Rows whose names n1 and n2 the genome knows, with chr1 and chr2. Two lookups in a map of its aliases: a genome has some dozens."""
    pairs = [F.lit(x) for kv in genome.aliases().items() for x in kv]
    lookup = F.create_map(*pairs)
    found = [F.try_element_at(lookup, F.lower(f"n{end}")).alias(f"chr{end}") for end in "12"]
    return rows.select("*", *found).where("chr1 is not null and chr2 is not null").select(*PAIRS, *_also(rows))


def read_pairs(spark: SparkSession, path: str, genome: Genome, fmt: str = "auto", sam_flag_strands: bool = False, partitions: int | None = None, ordinal: bool = False) -> DataFrame:
    """The pairs of a file or folder in one of ``FORMATS``; ``partitions`` spreads the rows of unsplittable files, ``ordinal`` adds a column that orders rows as their lines stood (text only)."""
    fmt = detect_format(spark, path) if fmt == "auto" else fmt
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; there are auto, {', '.join(FORMATS)}")
    if fmt in ("bin", "bn"):
        from contactspark.sources.binary import read_binary

        if ordinal:
            raise ValueError("binary records have no ordinal")
        return read_binary(spark, path, genome, fmt)
    if fmt == "pairs":
        rows = _read_pairs_files(spark, path, ordinal)
    else:
        fields = _fields(_lines(spark, path, ordinal))
        rows = _short(fields) if fmt == "short" else _mnd(fields, sam_flag_strands)
    out = known_chromosomes(rows, genome)
    return out.repartition(partitions) if partitions else out
