"""Comparing two stores or two query results: key sets, coordinates, and metrics of paired values."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.functions.parse import positive_finite

KEY = ["norm", "chr", "bin_size"]


def duplicate_keys(index: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return index.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_sets(left: DataFrame, right: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """keys and ``side``: both, left (missing on the right) or right."""
    a, b = left.select(*keys).distinct().withColumn("_a", F.lit(1)), right.select(*keys).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return a.join(b, keys, "full").select(*keys, side.alias("side"))


def same_coordinates(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("x", "y")) -> bool:
    return left.select(*keys).exceptAll(right.select(*keys)).isEmpty() and right.select(*keys).exceptAll(left.select(*keys)).isEmpty()


def metrics(paired: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """by, common_positive_finite, pearson, median_ratio, median_relative_error, max_relative_error of value pairs that are both positive and finite.

    Where a side doesn't vary, pearson is 1 if the sides are equal and NaN otherwise; below two pairs it is NaN.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    good = paired.where(positive_finite(x) & positive_finite(y))
    off = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-30))
    s = good.groupBy(*by).agg(
        F.count("*").alias("common_positive_finite"),
        F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("_r"),
        F.min(x).alias("_x0"),
        F.max(x).alias("_x1"),
        F.min(y).alias("_y0"),
        F.max(y).alias("_y1"),
        F.bool_and(x == y).alias("_same"),
        F.median(y / x).alias("median_ratio"),
        F.median(off).alias("median_relative_error"),
        F.max(off).alias("max_relative_error"),
    )
    flat = (F.col("_x0") == F.col("_x1")) | (F.col("_y0") == F.col("_y1"))
    nan = F.lit(float("nan"))
    pearson = F.when(F.col("common_positive_finite") < 2, nan).when(flat, F.when(F.col("_same"), 1.0).otherwise(nan)).otherwise(F.col("_r"))
    return s.select(*by, "common_positive_finite", pearson.alias("pearson"), "median_ratio", "median_relative_error", "max_relative_error")


def compare_vectors(left: DataFrame, right: DataFrame) -> DataFrame:
    """``metrics`` of the vectors that both have, by norm, chromosome and bin size, with both lengths."""
    a = left.select(*KEY, "bin", F.col("value").alias("a"))
    b = right.select(*KEY, "bin", F.col("value").alias("b"))
    lengths = a.groupBy(*KEY).agg(F.count("*").alias("length_left")).join(b.groupBy(*KEY).agg(F.count("*").alias("length_right")), KEY)
    return lengths.join(metrics(a.join(b, [*KEY, "bin"]), KEY), KEY, "left")


def compare_dumps(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows of either result, whether coordinates agree, whether all rows do, and ``metrics`` of the values they share."""
    one = lambda df: df.select(F.lit(1).alias("_"), "x", "y", "value")
    return compare_results(one(left), one(right), ["_"]).drop("_")


def compare_results(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``compare_dumps`` of many results at once, a row for each ``by`` that either side has."""
    both = left.select(*by, "x", "y", F.col("value").alias("a")).join(right.select(*by, "x", "y", F.col("value").alias("b")), [*by, "x", "y"], "full")
    sides = both.groupBy(*by).agg(F.count("a").alias("rows_left"), F.count("b").alias("rows_right"), F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("coordinates_equal"), F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("exact_values_equal"))
    return sides.join(metrics(both.where("a is not null and b is not null"), by), by, "left")


def fingerprint(spark, path: str) -> DataFrame:
    """path and MD5 of each file. On a mounted path a task reads its files piece by piece, however large they are; elsewhere files come whole, of at most 2 GB."""
    from contactspark.session import ship
    from contactspark.sources import ranges

    files = ranges.listed(spark, path)
    if not ranges.mounted(files):
        return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))
    ship(spark)

    def digest(batches):
        for batch in batches:
            uris, found = batch.column("path").to_pylist(), []
            for uri in uris:
                with open(ranges.local(uri), "rb") as f:
                    found.append(hashlib.file_digest(f, "md5").hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(uris), pa.array(found)], names=["path", "md5"])

    return spark.createDataFrame([(uri,) for uri, _ in files], "path string").repartition(len(files)).mapInArrow(digest, "path string, md5 string")


def compare_containers(spark, left: str, right: str) -> dict:
    """A report on two containers: whether their structure agrees, which vectors only one has, and ``metrics`` of those that both have."""
    from contactspark.sources import container

    a, b = container.inspect(left), container.inspect(right)
    same = {f"{name}_equal": a[name] == b[name] for name in ("version", "genome", "chromosomes", "resolutions", "fragment_resolutions")}
    counts = {f"{name}_{side}": x[name] for name in ("matrices", "expected", "norm_expected", "vectors") for side, x in (("left", a), ("right", b))}
    v, w = container.read_vectors(spark, left), container.read_vectors(spark, right)
    sides = {side: [] for side in ("left", "right")}
    for r in key_sets(v, w).where("side <> 'both'").orderBy(*KEY).collect():
        sides[r.side].append([r.norm, r.chr, r.bin_size])
    shared = [r.asDict() for r in compare_vectors(v, w).orderBy(*KEY).collect()]
    return {"structure": same | counts, "only_left": sides["left"], "only_right": sides["right"], "vectors": shared}


def as_json(report: dict | DataFrame) -> str:
    """A report (a frame of one row counts as one) as JSON, keys in order. NaN and infinities are written as Python does."""
    if isinstance(report, DataFrame):
        report = report.first().asDict()

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        return x if x is None or isinstance(x, str | int | float | bool) else str(x)

    return json.dumps(plain(report), indent=2, sort_keys=True)
