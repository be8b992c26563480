"""Reading numbers the lenient way: the longest numeric prefix counts, and 0 where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Least and greatest 32-bit and 64-bit numbers: what lies beyond counts as these.
INT, LONG = (-(1 << 31), (1 << 31) - 1), (-(1 << 63), (1 << 63) - 1)


def leading_long(field: Column) -> Column:
    """A field that is a number is cast at once; only others are searched for a prefix."""
    number = F.regexp_extract(field, r"^\s*([+-]?[0-9]+)", 1)
    beyond = F.when(number == "", 0).when(number.startswith("-"), LONG[0]).otherwise(LONG[1])
    return F.when(field.isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce(field.try_cast("bigint"), number.try_cast("bigint"), beyond.cast("bigint")))


def leading_int(field: Column) -> Column:
    return F.greatest(F.least(leading_long(field), F.lit(INT[1])), F.lit(INT[0])).cast("int")


def leading_float(field: Column) -> Column:
    number = F.regexp_extract(field, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity|nan))", 1)
    return F.coalesce(field.try_cast("double"), number.try_cast("double"), F.lit(0.0)).cast("float")


def usable(x: Column) -> Column:
    """Neither null nor NaN nor 0: what a normalised value may be divided by."""
    return x.isNotNull() & ~F.isnan(x) & (x != 0)


def positive_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
