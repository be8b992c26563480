"""Sharding by sampled splitters.

Every record gets a key (a hash of its group and then a running number, so keys
are unique and copies of a text lie side by side). Records are sampled with a
chance in proportion to their size; quantiles of the sample become splitters of
many fine ranges. Their exact sizes are counted, and overfull ranges are
subdivided with a denser sample of their own (another one in each round), until
none is left but for single records. Shards are then cut where the running size
passes a multiple of its share: only inside a fine range are rows ever numbered one
after the other, so a hot group is spread over as many ranges as its size asks for.

The law is ``bytes``: shards differ by about one record's size.

What the driver holds is bounded: about ``SAMPLE`` sampled keys a round and the
totals of ``RANGES`` ranges (eight times that in a later round).

Defined cases: null sizes count as 0; repeated rows are dealt like any others;
an empty table gives an empty result; with fewer records than shards some shards
stay empty; further columns are kept, and a column named ``shard`` or ``slot`` is
replaced.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.llm.common import cut, literal_longs

LAW = "bytes"
SHARDS = 24
#: Fine ranges, and sampled keys, at the first round.
RANGES, SAMPLE = 768, 24_576
#: A range is overfull from this many times the mean, and a round of subdividing gives it this many samples for each mean.
OVERFULL, DENSER = 2, 8


def range_of(high: Column, low: Column, splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below the key (high, low), by binary search."""
    highs, lows = literal_longs([s[0] for s in splitters]), literal_longs([s[1] for s in splitters])
    step, steps = 1, []
    while step <= len(splitters):
        steps.insert(0, F.lit(step))
        step *= 2
    if not steps:
        return F.lit(0)

    def go(at: Column, step: Column) -> Column:
        h, s = F.get(highs, at + step - 1), F.get(lows, at + step - 1)
        return F.when((h < high) | ((h == high) & (s <= low)), at + step).otherwise(at)

    return F.aggregate(F.array(*steps), F.lit(0), go)


def _sampled(rows: DataFrame, size: str, high: str, low: str, step: float, seed: int) -> list:
    chance = F.pmod(F.xxhash64(F.lit(seed), high, low), F.lit(1 << 20)) / F.lit(float(1 << 20))
    hits = F.floor(F.col(size) / F.lit(step) + chance)
    return rows.select(F.col(high).alias("h"), F.col(low).alias("l"), hits.alias("hits"), "range").where("hits > 0").collect()


def _quantiles(drawn: list, every: float) -> list[tuple[int, int]]:
    found, seen = [], 0.0
    for r in sorted(drawn, key=lambda r: (r.h, r.l)):
        if int((seen + r.hits) / every) > int(seen / every):
            found.append((r.h, r.l))
        seen += r.hits
    return found


def assign(records: DataFrame, size: Column, group: Column, shards: int = SHARDS, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """``records`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard, in the order of the keys)."""
    names = [c for c in records.columns if c.lower() not in ("shard", "slot")]
    s, h, m, r, load = "_size", "_group", "_number", "_range", "_load"
    held = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in names])
    rows = records.select(held.alias("_own"), F.coalesce(size, F.lit(0)).cast("long").alias(s), F.xxhash64(group).alias(h))
    rows = cut(rows.withColumn(m, F.monotonically_increasing_id()))
    total, n = rows.agg(F.coalesce(F.sum(s), F.lit(0)), F.count("*")).first()
    weight = s
    if not total:  # nothing but empty records: deal them by number
        weight, total = "_one", max(n, 1)
        rows = rows.withColumn(weight, F.lit(1))

    # ranges are made even in size and rows together, so that neither empty nor large records crowd one
    rows = rows.withColumn(load, F.col(weight) + F.lit(max(1, total // max(n, 1))))
    everything = rows.agg(F.coalesce(F.sum(load), F.lit(1))).first()[0]
    fair = everything / ranges
    splitters = sorted(_quantiles(_sampled(rows.withColumn("range", F.lit(0)), load, h, m, everything / sample, 1), sample / ranges))
    for turn in count(2):
        dealt = rows.withColumn(r, range_of(F.col(h), F.col(m), splitters))
        sizes = {x[r]: x for x in dealt.groupBy(r).agg(F.sum(weight).alias("w"), F.sum(load).alias("load"), F.max(load).alias("most"), F.count("*").alias("n")).collect()}
        full = [k for k, x in sizes.items() if x.load - x.most > OVERFULL * fair]  # a single record can't be divided
        if not full:
            break
        drawn = _sampled(dealt.where(F.array_contains(literal_longs(full), F.col(r).cast("long"))).withColumn("range", F.col(r)), load, h, m, fair / DENSER, turn)
        more = {q for k in full for q in _quantiles([d for d in drawn if d.range == k], DENSER)}
        splitters = sorted(more | set(splitters))

    before_w, before_n, w, c = [], [], 0, 0
    for k in range(len(splitters) + 1):
        before_w.append(w)
        before_n.append(c)
        if k in sizes:
            w, c = w + sizes[k].w, c + sizes[k].n

    own = Window.partitionBy(r).orderBy(h, m)
    at = F.get(literal_longs(before_w), F.col(r)) + F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    rank = F.get(literal_longs(before_n), F.col(r)) + F.row_number().over(own) - 1
    middle = ((2 * at + F.col(weight)).cast("decimal(38,0)") * shards / F.lit(2 * total).cast("decimal(38,0)")).cast("double")
    placed = dealt.withColumn("shard", F.least(F.floor(middle).cast("int"), F.lit(shards - 1))).withColumn("slot", rank.cast("long"))

    def shard_at(x: int) -> int:
        return min(shards - 1, x * shards // total)

    mixed = [k for k, x in sizes.items() if shard_at(before_w[k]) != shard_at(before_w[k] + x.w)]
    first: dict[int, int] = {}
    if mixed:
        for x in placed.where(F.array_contains(literal_longs(mixed), F.col(r).cast("long"))).groupBy("shard").agg(F.min("slot").alias("slot")).collect():
            first[x.shard] = x.slot
    for k in sizes.keys() - set(mixed):
        i = shard_at(before_w[k])
        first[i] = min(first.get(i, n), before_n[k])
    starts = literal_longs([first.get(i, 0) for i in range(shards)])
    return placed.select(*[F.col(f"_own.`{c}`") for c in names], "shard", (F.col("slot") - F.get(starts, F.col("shard"))).alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """One folder a shard, its rows in the order of their slots; a large shard is written by many tasks."""
    parts = F.floor(F.col("slot") / 1_000_000)
    sharded.repartition("shard", parts).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
