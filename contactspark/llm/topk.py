"""Exact top-k search by inner product, by aggregation without random access.

Vectors are dealt into blocks, queries into blocks of their own, and each pair of
blocks meets in one task (a block nested loop: no task holds more than a block of
each, and a block's candidates are copied and sorted once for ``QUERIES`` queries).
There every component is a list of the block's candidates sorted by value, read from
the end that favours a query: from the top for a positive weight, from the bottom for a
negative one. Lists are read in steps of equal depth. A candidate's lower bound takes
what was read of it and the worst value of each list where it wasn't met; its upper
bound takes the value that list has reached. Candidates that no open query can still
want are read no further. A query is done when no candidate outside its k best lower
bounds can qualify by its upper bound; the few that stay in question are then resolved
exactly. The blocks' winners are merged by rank.

Components become floor(scale * x); scores are exact (``products``), held within the
range of a long. Where sums of a block may pass what doubles hold exactly, its bounds
are widened by what rounding may have taken, so that only more candidates are resolved.

Defined cases: vectors that are null or hold null or non-finite components (or that
aren't finite times the scale) take no part, nor do rows without an id; only vectors of one length meet; repeated rows
(equal id and vector) are as many candidates and queries, and a row is no
candidate of its own but of its copies; ties go to the smaller id; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.llm.common import cut
from contactspark.llm.products import EXACT, products, whole
from contactspark.session import ship

#: Candidates and queries in a block, and the depths (as a share of a list) that are read in turn.
CANDIDATES, QUERIES, DEPTHS = 4096, 8192, (0.1, 0.2, 0.35, 0.5, 0.75, 1.0)
#: Queries of a block whose bounds are held together, and more than what may be lost where numbers become too small for a double.
TOGETHER, TINY = 512, 2.0**-1000
FOUND = "query_id bigint, query_key bigint, query_rows bigint, vec_id bigint, score bigint, vec_rows bigint"


def search(queries: np.ndarray, candidates: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query in order, the candidates that may be among its k best (all ties of the last included) and their exact scores."""
    exact = lambda q, own: products(queries[q : q + 1], candidates[own])[0]
    n, dims = candidates.shape
    if n <= k or not dims:
        for q in range(len(queries)):
            yield np.arange(n), exact(q, np.arange(n))
        return
    # bounds don't need the size of numbers, only their order: powers of two keep their products finite
    (_, up), (_, high) = np.frexp(np.abs(queries).max(initial=0)), np.frexp(np.abs(candidates).max(initial=0))
    slack = 0.0 if up + high + np.ceil(np.log2(dims)) < np.log2(EXACT) else (dims + 4) * 2.0**-51
    asked, held = (queries, candidates) if not slack else (np.ldexp(queries, -up), np.ldexp(candidates, -high))
    end = np.ldexp(1.0, 63 - int(up) - int(high)) if slack else np.inf
    order = np.argsort(candidates, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
    ranked = np.take_along_axis(held, order, axis=0)
    for first in range(0, len(queries), TOGETHER):
        yield from ((own, exact(q, own)) for q, own in enumerate(_read(asked[first : first + TOGETHER], held, place, ranked, k, slack, end), first))


def _read(queries: np.ndarray, candidates: np.ndarray, place: np.ndarray, ranked: np.ndarray, k: int, slack: float, end: float) -> list[np.ndarray]:
    """For each of a few queries the candidates that may be among its k best. ``place``: of a candidate in each sorted list; ``ranked``: the lists' values; ``slack``: the share of a sum's absolute terms by which it may be off; ``end``: what scores are held within, so that those beyond are ties.

    Lists are read from both ends at once, step by step. After a step, queries leave
    that few candidates are left for, and candidates that can't qualify for any other.
    """
    n = len(candidates)
    left, todo = np.arange(n), np.arange(len(queries))
    kept: list[np.ndarray] = [left] * len(queries)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    for share in DEPTHS:
        depth = min(n, max(k, int(np.ceil(n * share))))
        own, at = candidates[left], place[left]
        top, low = at >= n - depth, at < depth
        # a value that was read counts as it is; of others, the bounds that the list's order gives
        a, b = up[todo], down[todo]
        worst, best = (np.where(top, own, ranked[0]).T, np.where(low, own, ranked[-1]).T), (np.where(top, own, ranked[n - depth]).T, np.where(low, own, ranked[depth - 1]).T)
        least, most = a @ worst[0] + b @ worst[1], a @ best[0] + b @ best[1]
        if slack:
            least -= slack * (a @ np.abs(worst[0]) - b @ np.abs(worst[1])) + TINY
            most += slack * (a @ np.abs(best[0]) - b @ np.abs(best[1])) + TINY
        bar = np.minimum(np.partition(least, len(left) - k, axis=1)[:, len(left) - k], end)
        bar[bar <= -end] = -np.inf
        open_ = most >= bar[:, None]
        few = open_.sum(axis=1) <= max(4 * k, n // 64) if depth < n else np.ones(len(todo), dtype=bool)
        for q, mine in zip(todo[few], open_[few], strict=True):
            kept[q] = left[mine]
        todo = todo[~few]
        if not len(todo):
            break
        left = left[open_[~few].any(axis=0)]
    return kept


def _meet(k: int, scale: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            winners = search(*(whole(side["v"].to_list(), scale) for side in (q, c)), k + 1)
            ids, rows = c["vec_id"].to_numpy(), c["n_rows"].to_numpy()
            for (own_id, own_key, own_rows, own_v), (own, scores) in zip(zip(q["vec_id"], q["key"], q["n_rows"], q["v"], strict=True), winners, strict=True):
                best = own[np.lexsort((ids[own], -scores))]
                score = dict(zip(own.tolist(), scores.tolist(), strict=True))
                taken = 0
                for i in best.tolist():
                    m = int(rows[i])
                    if ids[i] == own_id and np.array_equal(c["v"].iat[i], own_v):
                        m -= 1
                    if m > 0:
                        found.append((own_id, own_key, own_rows, ids[i], score[i], min(m, k)))
                        taken += m
                    if taken >= k:
                        break
        return pd.DataFrame(found, columns=["query_id", "query_key", "query_rows", "vec_id", "score", "vec_rows"]).astype("int64")

    return meet


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row of ``vectors`` (vec_id, embedding) where ``is_query`` holds."""
    ship(vectors.sparkSession)
    good = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = cut(rows.groupBy("vec_id", "v").agg(F.count("*").alias("n_rows"), F.max("asks").alias("asks")))
    n, n_asked = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).first()
    blocks, asked = max(1, -(-n // candidates)), max(1, -(-n_asked // queries))
    of = lambda m: F.pmod("key", F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    side = rows.withColumn("dims", F.size("v")).withColumn("key", F.xxhash64("vec_id", "v"))
    left = side.where("asks").withColumn("qb", of(asked)).withColumn("cb", every(blocks)).groupBy("dims", "qb", "cb")
    right = side.withColumn("cb", of(blocks)).withColumn("qb", every(asked)).groupBy("dims", "qb", "cb")
    pairs = left.cogroup(right).applyInPandas(_meet(k, scale), FOUND)
    first = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("vec_rows"))))
    best = pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("query_rows"))).alias("_")).drop("_")
