"""Hard negatives: for each anchor and each of its positives, the rows of other labels that come nearest below a share of the positive's score.

All rows are scored against all anchors, in blocks: anchors are dealt into blocks, rows
into others, and each pair of blocks meets in one task (a block nested loop; no task
holds more than a block of each). There an anchor's scores are sorted, ties by id.

1. Of the rows of the anchor's label each block gives the first ``positives``; the
   anchor's own are the first of all blocks'.
2. Of the rows of other labels each block sorts all scores once for an anchor, finds each
   positive's upper limit by binary search, and reads on from there, ``negatives`` rows at
   most and none below the lower limit. The first of all blocks' are returned.

So what leaves a block is a few rows for an anchor, however many rows a label has.
Components become floor(scale * x) and scores are exact (``products``).

Defined cases: rows without id, label or vector, and those whose vector holds null or
non-finite components (or that aren't finite times the scale), take no part; only
vectors of one length meet; repeated rows (equal id, label and vector) count one by one,
as anchors, positives and negatives; a row is never its own positive, but its copies
are; a positive of a score below 0 has no negatives, as the limits cross; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.llm.common import cut
from contactspark.llm.products import products, whole
from contactspark.session import ship

#: Rows and anchors in a block, and anchors whose scores are held together.
ROWS, ANCHORS, TOGETHER = 4096, 2048, 256
_FOUND = "anchor_key bigint, place int, vec_id bigint, key bigint, score bigint, n_rows bigint"


def _sorted_scores(anchors: pd.DataFrame, rows: pd.DataFrame, scale: int, same: bool):
    """For each anchor (its place) the rows of its label, or of all others, by falling score and rising id: their places and scores."""
    a, b = whole(anchors["v"].to_list(), scale), whole(rows["v"].to_list(), scale)
    labels, ids = rows["label"].to_numpy(), rows["vec_id"].to_numpy()
    by_id = np.argsort(ids, kind="stable")
    for label, own in anchors.groupby("label").indices.items():
        allowed = by_id[(labels[by_id] == label) == same]
        for first in range(0, len(own), TOGETHER):
            some = own[first : first + TOGETHER]
            for place, scores in zip(some.tolist(), products(a[some], b[allowed]), strict=True):
                order = np.lexsort((ids[allowed], -scores))
                yield place, allowed[order], scores[order]


def _result(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["anchor_key", "place", "vec_id", "key", "score", "n_rows"]).astype("int64").astype({"place": "int32"})


def _positives(k: int, scale: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def positives(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(rows):
            keys, ids, copies, mine = (x.to_numpy() for x in (rows["row_key"], rows["vec_id"], rows["n_rows"], anchors["key"]))
            for place, order, scores in _sorted_scores(anchors, rows, scale, same=True):
                for i, score in zip(order[: k + 1].tolist(), scores[: k + 1].tolist(), strict=True):
                    n = copies[i] - (keys[i] == mine[place])
                    if n > 0:
                        found.append((mine[place], 0, ids[i], keys[i], score, min(n, k)))
        return _result(found)

    return positives


def _negatives(k: int, low: int, high: int, scale: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def negatives(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(rows):
            keys, ids, copies, mine, limits = (x.to_numpy() for x in (rows["row_key"], rows["vec_id"], rows["n_rows"], anchors["key"], anchors["scores"]))
            for place, order, scores in _sorted_scores(anchors, rows, scale, same=False):
                for turn, positive in enumerate(limits[place].tolist()):
                    least, most = -(-low * positive // 100), high * positive // 100
                    if least > most:
                        continue
                    at = int(np.searchsorted(-scores, -most))
                    for i, score in zip(order[at : at + k].tolist(), scores[at : at + k].tolist(), strict=True):
                        if score < least:
                            break
                        found.append((mine[place], turn, ids[i], keys[i], score, min(copies[i], k)))
        return _result(found)

    return negatives


def _copies(n: str) -> Column:
    return F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k first of each group, copies one by one, with ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "key")
    return found.withColumn("_copy", _copies("n_rows")).drop("_copy").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, rows_together: int = ROWS, anchors_together: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for the rows of ``vectors`` (vec_id, label, embedding) where ``is_anchor`` holds, and each of their first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose scores are ``low`` to ``high`` percent of the positive's."""
    ship(vectors.sparkSession)
    good = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")), F.lit(False)))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(good)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.groupBy("vec_id", "label", "v").agg(F.count("*").alias("n_rows"), F.max("asks").alias("asks"))
    rows = cut(rows.withColumn("key", F.xxhash64("vec_id", "label", "v")).withColumn("dims", F.size("v")))
    n, n_anchors = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, asked = max(1, -(-n // rows_together)), max(1, -(-n_anchors // anchors_together))
    of = lambda m: F.pmod("key", F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cells = ["dims", "ab", "rb"]
    anchors = rows.where("asks")
    names = ["vec_id", "label", "v", "n_rows", "key", "dims"]
    right = rows.select(*[F.col(c).alias(f"row_{c}" if c == "key" else c) for c in names], of(blocks).alias("rb"), every(asked).alias("ab")).groupBy(*cells)
    meet = lambda left, task: left.withColumn("ab", of(asked)).withColumn("rb", every(blocks)).groupBy(*cells).cogroup(right).applyInPandas(task, _FOUND)

    near = meet(anchors.select("label", "v", "key", "dims"), _positives(positives, scale))
    near = cut(_first(near, ["anchor_key"], positives).select("anchor_key", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    held = near.groupBy("anchor_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asking = anchors.select("label", "v", "key", "dims").join(held, F.col("key") == F.col("anchor_key")).drop("anchor_key")
    hard = _first(meet(asking, _negatives(negatives, low, high, scale)), ["anchor_key", "place"], negatives)
    named = hard.select("anchor_key", (F.col("place") + 1).alias("turn"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    paired = named.join(near.withColumnRenamed("rank", "turn"), ["anchor_key", "turn"])
    owners = anchors.select(F.col("key").alias("anchor_key"), F.col("vec_id").alias("anchor_id"), _copies("n_rows").alias("_copy"))
    return owners.join(paired, "anchor_key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
