"""Ranked lexical search: WAND over the inverted index of each shard of documents, the shards' heaps merged.

Texts are cut into terms once; of each document what is kept is its number of terms
and how often it holds each term that any item asks for. Numbers of documents and of
terms, and the documents that hold a term, are counted over all documents. Then
documents are dealt into shards of bounded size, and each shard meets the items
(both in blocks). There each term has a list of documents, in order of their ids, with
the impact the term has on each, and a list has a maximum impact.

An item's search keeps its ``k`` best documents so far and their least score, the
threshold. Documents are passed in order, in windows that grow. Pivots of a window are
the documents whose terms' maximum impacts add up to more than the threshold: lists
whose maxima together don't pass it can't make a pivot, so only documents of the other
lists are looked at, and the rest are looked up from the highest maximum on, until what
may still come can't lift a document above the threshold. Only pivots are scored.
Where all maxima together don't pass the threshold, the search ends.

Items' terms go to the workers as one table of at most about ``TERMS`` terms; where
items have more, they are dealt into portions, each of which is a pass over the documents.

Defined cases: a null text has no terms; every row of items and of documents counts by
itself, equal ones too; of equal scores smaller doc_ids come first, null ones last;
items without terms, and those whose terms no document holds, have no rows; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from contactspark.llm.common import cut, keep
from contactspark.session import ship

#: Documents, and terms of theirs, of a shard, about; items of a block; terms that go to the workers at once; shards whose heaps are merged first.
DOCUMENTS, POSTINGS, ITEMS, TERMS, LANE = 8192, 2_000_000, 1024, 200_000, 256
#: Documents in the first window.
FIRST = 256
#: Share of a document's length in its weight, of 100, and what the score's formula multiplies with.
LENGTH, SCALE, UNIT, DAMP = 75, 1_000_000_000, 1000, 8
#: Bytes as terms have them: ASCII other than letters and digits parts terms, letters of ASCII are small.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_TERMS = "array<struct<term:binary,n:int>>"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def _counted(text: pa.Array) -> pa.Array:
    out = [[{"term": t, "n": n} for t, n in Counter(terms(x.as_py() or b"")).items()] for x in text.cast(pa.binary())]
    return pa.array(out, type=pa.list_(pa.struct([("term", pa.binary()), ("n", pa.int32())])))


def _indexed(known: Broadcast) -> Callable:
    """A text's number of terms, and which of the known ones it holds how often."""

    @arrow_udf("struct<n:bigint,term:array<int>,tf:array<int>>")
    def indexed(text: pa.Array) -> pa.Array:
        number, sizes, ends, ids, counts = known.value, [], [0], [], []
        for x in text.cast(pa.binary()):
            own = terms(x.as_py() or b"")
            sizes.append(len(own))
            for t, n in Counter(own).items():
                if (i := number.get(t)) is not None:
                    ids.append(i)
                    counts.append(n)
            ends.append(len(ids))
        ends = pa.array(ends, type=pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v, type=pa.int32())) for v in (ids, counts)]
        return pa.StructArray.from_arrays([pa.array(sizes, type=pa.int64()), *lists], names=["n", "term", "tf"])

    return indexed


def _best(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((docs, -scores))[:k]
    return docs[order], scores[order]


def wand(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, first: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """The k best of documents 0 to n - 1 by the sum of their impacts (above 0), ties to the smaller number, and their sums. Each list has documents in order and their impacts."""
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: int(x[1].max()))
    most = np.array([int(x[1].max()) for x in lists], dtype=np.int64)
    upto = np.cumsum(most)  # of a list's maximum and all smaller ones
    best, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    ends, start, width = [0] * len(lists), 0, first
    while start < n and lists:
        bar = int(scores[-1]) if len(best) == k else 0
        weak = int(np.searchsorted(upto, bar, side="right"))  # so many lists alone can't make a pivot
        if weak == len(lists):
            break
        stop = min(n, start + width)
        froms, ends = ends, [int(np.searchsorted(x[0], stop)) for x in lists]
        bound = np.zeros(stop - start, dtype=np.int64)
        for (own, _), a, b, top in zip(lists[weak:], froms[weak:], ends[weak:], most[weak:], strict=True):
            bound[own[a:b] - start] += top
        pivots = np.flatnonzero(bound)
        bound, pivots = bound[pivots], pivots + start
        for i in range(weak - 1, -2, -1):
            open_ = bound + (upto[i] if i >= 0 else 0) > bar
            bound, pivots = bound[open_], pivots[open_]
            if i >= 0 and len(pivots):
                bound = bound + most[i] * (_found(lists[i][0][froms[i] : ends[i]], pivots)[0])
        if len(pivots):
            total = np.zeros(len(pivots), dtype=np.int64)
            for (own, impact), a, b in zip(lists, froms, ends, strict=True):
                there, at = _found(own[a:b], pivots)
                total[there] += impact[a:b][at[there]]
            good = total > bar
            best, scores = _best(np.concatenate([best, pivots[good]]), np.concatenate([scores, total[good]]), k)
        start, width = stop, 2 * width
    return best, scores


def _found(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are in ``held`` (in order), and where."""
    if not len(held):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return held[at] == wanted, at


def _search(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(docs: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        found = {"iid": [], "doc": [], "score": []}
        docs = docs.sort_values(["nameless", "doc_id"], kind="stable", ignore_index=True)
        if len(docs) and len(items):
            own = np.repeat(np.arange(len(docs)), docs["term"].map(len))
            term, tf = np.concatenate(docs["term"].to_list()).astype(np.int64), np.concatenate(docs["tf"].to_list()).astype(np.int64)
            order = np.argsort(term, kind="stable")
            term, own, tf = term[order], own[order], tf[order]
            impact = (SCALE * tf) // (UNIT * tf + DAMP * docs["m"].to_numpy()[own])
            starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            lists = dict(zip(term[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(term)], strict=True), strict=True))
            for iid, asked, weights in zip(items["iid"], items["term"], items["weight"], strict=True):
                mine = [(own[a:b], impact[a:b] * int(w)) for t, w in zip(asked, weights, strict=True) if w > 0 and t in lists for a, b in [lists[t]]]
                at, scores = wand(mine, len(docs), k)
                found["iid"] += [iid] * len(at)
                found["doc"] += at.tolist()
                found["score"] += scores.tolist()
        out = pd.DataFrame({"iid": found["iid"], "doc_id": docs["doc_id"].iloc[found["doc"]].to_numpy(), "score": found["score"], "shard": 0}, dtype="int64")
        return out.assign(nameless=docs["nameless"].iloc[found["doc"]].to_numpy(dtype=bool), shard=docs["shard"].iat[0] if len(docs) else 0)

    return search


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Each item's k best of all shards, by rank: first those of ``LANE`` shards at a time."""
    best = [F.desc("score"), "nameless", "doc_id"]
    lane = F.floor(F.col("shard") / LANE)
    some = found.withColumn("lane", lane).withColumn("rank", F.row_number().over(Window.partitionBy("iid", "lane").orderBy(*best))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("iid").orderBy(*best))).where(F.col("rank") <= k)


def _rank(docs: DataFrame, asked: DataFrame, k: int, documents: int, postings: int, items: int) -> DataFrame:
    """iid, rank, doc_id, score for the items whose terms are ``asked`` (iid, term, n)."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast({bytes(r.term): i for i, r in enumerate(asked.select("term").distinct().toLocalIterator())})
    held = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), _indexed(known)("text").alias("x"))
    held = keep(held.select("doc_id", "uid", "x.*"))
    n_docs, n_terms, n_held, n_postings = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.size("term") > 0), F.coalesce(F.sum(F.size("term")), F.lit(0))).first()

    @arrow_udf("int")
    def number(term: pa.Array) -> pa.Array:
        return pa.array([known.value[t.as_py()] for t in term], type=pa.int32())

    holders = held.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long") * F.col("n")
    weighed = asked.select("iid", number("term").alias("term"), "n").join(holders, "term")
    weighed = cut(weighed.groupBy("iid").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("t")).select("iid", "t.term", "t.weight"))

    shards = max(1, -(-n_held // documents), -(-n_postings // postings))
    blocks = max(1, -(-weighed.count() // items))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    of = lambda column, m: F.pmod(F.xxhash64(column), F.lit(m)).cast("int")
    m = F.lit(100 - LENGTH) + F.expr(f"({LENGTH} * n * {n_docs}L) div {max(1, n_terms)}L")
    left = held.where(F.size("term") > 0).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), "term", "tf", m.alias("m"), of("uid", shards).alias("shard"), every(blocks).alias("block"))
    right = weighed.select("iid", "term", "weight", of("iid", blocks).alias("block"), every(shards).alias("shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_search(k), "iid bigint, doc_id bigint, score bigint, shard bigint, nameless boolean")
    return _merged(found, k).select("iid", "rank", F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, documents: int = DOCUMENTS, postings: int = POSTINGS, items_together: int = ITEMS, terms_together: int = TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best of ``docs`` (doc_id, text) with a score above 0 for each row of ``items`` (item_id, text)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = keep(items.select("item_id", F.monotonically_increasing_id().alias("iid"), arrow_udf(_counted, _TERMS)("text").alias("t")))
    asked = own.select("iid", F.explode("t").alias("t")).select("iid", "t.*")
    n, distinct = asked.count(), asked.select("term").distinct().count()
    portions = 1 if distinct <= terms_together else -(-2 * n // terms_together)
    out = None
    for p in range(portions):
        some = asked.where(F.pmod(F.xxhash64("iid"), F.lit(portions)) == p)
        found = _rank(docs, some, k, documents, postings, items_together)
        found = found if portions == 1 else keep(found)
        out = found if out is None else out.unionByName(found)
    return own.select("iid", "item_id").join(out, "iid").select("item_id", "rank", "doc_id", "score")
