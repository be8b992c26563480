"""Near-duplicates: DartMinHash signatures, banded joining, exact checks, connected classes.

Equal texts are one text from the start (by MD5), so a group of copies is one row.
Texts whose signatures agree in a band meet in that band's bucket. Then links are
sought without listing a bucket's pairs:

1. Each member meets the bucket's star, its member that most other texts share
   buckets with (where copies were made from one text, this is likely to be it).
   Pairs are checked on the whole texts; links make classes. A star that many meet
   is dealt in salted parts.
2. Buckets whose other members are still in several classes are compared in full,
   but only across classes: such a bucket is cut into cells of pairs of chunks of at
   most ``CHUNK`` members, and a cell holds its members' shingles. In it texts are
   checked exactly, one against all that are in another class and share no earlier
   bucket with it; a link joins two classes there and then, so a cell gives fewer
   links than it has classes, however many pairs it compares.

``layout`` takes bands from the threshold, so that of the pairs just similar enough
at most ``LOSS`` share no band: 32 bands of 4 at 0.8. More similar pairs are lost
more rarely. Of the pairs that share a band no link between classes is lost.

The similarity is the weighted Jaccard coefficient of five-word shingles with
their counts; it is checked exactly (on 64-bit hashes of the shingles).

Defined cases: a null text is never a near-duplicate and its class is the row
alone; texts without words are one class with equal texts only; texts of fewer
than five words are one shingle; rows with equal ids and texts count as copies; a
class is named by its smallest doc_id (null if all its ids are null); an empty
table gives an empty result; further columns are kept, and a column named
``class_id`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from contactspark.llm.common import cut, keep
from contactspark.llm.shingles import band_keys, dart_minhash, shingles, similarity
from contactspark.session import ship

SIMILARITY = 0.8
#: Members of a chunk, and shingles of it, about; pairs of a star that are checked in one part.
CHUNK, ELEMENTS, PART = 1024, 1_000_000, 1024
#: Most of the pairs just similar enough that the bands may lose; least coordinates of a signature.
LOSS, COORDINATES = 5e-8, 128


@dataclass(frozen=True)
class Layout:
    """Bands of a signature, and coordinates of a band."""

    bands: int
    rows: int


def layout(threshold: float) -> Layout:
    """The longest bands that lose no more than ``LOSS`` at ``threshold``."""
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    s, size, rows = min(threshold, 1 - 1e-12), COORDINATES, 16
    while (1 - s**rows) ** (size // rows) > LOSS:
        size, rows = (size, rows // 2) if rows > 1 else (2 * size, 1)
    return Layout(size // rows, rows)


def _signed(plan: Layout) -> Callable:
    @arrow_udf("struct<keys:array<bigint>,n:bigint>")
    def signed(text: pa.Array) -> pa.Array:
        keys, n = [], []
        for t in text.cast(pa.binary()):
            elements, weights = shingles(t.as_py() or b"")
            keys.append(band_keys(dart_minhash(elements, weights, plan.bands * plan.rows), plan.bands) if len(elements) else None)
            n.append(int(weights.sum()))
        return pa.StructArray.from_arrays([pa.array(keys, type=pa.list_(pa.int64())), pa.array(n, type=pa.int64())], names=["keys", "n"])

    return signed


def _shingles(text: pa.Array) -> pa.Array:
    """Each shingle as often as it occurs, as 64-bit hashes in order."""
    return pa.array([np.repeat(*shingles(t.as_py())).astype("<u8").tobytes() for t in text.cast(pa.binary())], type=pa.binary())


def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    out, held, star = [], None, None
    for x, y in zip(a.cast(pa.binary()), b.cast(pa.binary()), strict=True):
        y = y.as_py()
        if y != held:
            held, star = y, shingles(y)
        out.append(similarity(shingles(x.as_py()), star))
    return pa.array(out, type=pa.float64())


def components(edges: DataFrame) -> DataFrame:
    """tid, root (the smallest tid that it is linked with) for edges (a, b), by large-star and small-star turns.

    Least neighbours are written before edges join them, so that Spark can split what one hub joins.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("tid"), F.lit(1).alias("up")), F.struct(F.col("b").alias("tid"), F.lit(0).alias("up")))).alias("e"))
        ends = ends.groupBy("e.tid").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("low"))
        if ends.where("ups > 1 or ups = 1 and low = 0").isEmpty():  # no text has two above it, or one above and one below
            return edges.select(F.col("a").alias("tid"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = cut(both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"))
        held = large.join(least, F.col("a") == F.col("u"))
        small = held.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = cut(small.where("a > b").distinct())


def across(threshold: float, band: int, one: bool, keys: np.ndarray, sets: list[np.ndarray], root: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links of a cell, as places of its members, that join all its classes (``root``) with a link between them.

    ``one``: whether the cell is a chunk with itself; else only members of different ``side`` meet.
    Pairs that share an earlier band's bucket are compared there.
    """
    size = np.array([len(x) for x in sets])
    element = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    # an element that a text holds for the second time is another one than at first
    order = np.lexsort((element, owner))
    element, owner = element[order], owner[order]
    fresh = np.concatenate([[True], (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])])
    at = np.arange(len(element))
    turn = at - np.maximum.accumulate(np.where(fresh, at, 0))
    if turn.any():
        element = np.unique(element * (turn.max() + 1) + turn, return_inverse=True)[1]
    ends = np.concatenate([[0], np.cumsum(np.bincount(element))])
    holders = owner[np.argsort(element, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(size)])
    label, found = root.copy(), []
    for i in range(len(sets) - 1):
        open_ = label[i + 1 :] != label[i]
        if not one:
            open_ &= side[i + 1 :] != side[i]
        open_ &= np.minimum(size[i + 1 :], size[i]) >= threshold * np.maximum(size[i + 1 :], size[i])
        rest = np.flatnonzero(open_) + i + 1
        if band and len(rest):
            rest = rest[~(keys[rest, :band] == keys[i, :band]).any(axis=1)]
        if not len(rest):
            continue
        own = element[starts[i] : starts[i + 1]]
        n = ends[own + 1] - ends[own]
        listed = np.repeat(ends[own + 1] - np.cumsum(n), n) + np.arange(n.sum())
        shared = np.bincount(holders[listed], minlength=len(sets))[rest]
        for j in rest[shared / (size[i] + size[rest] - shared) >= threshold]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((i, int(j)))
    return found


def _cells(threshold: float, plan: Layout) -> Callable:
    """Roots of classes that ``across`` links, for rows that come sorted by cell; a cell that the end of a batch cuts waits for the next one."""
    names = ["bucket", "kind", "i", "j"]

    def links(rows: pa.Table) -> pa.RecordBatch:
        cell = np.column_stack([rows.column(c).to_numpy() for c in names])
        edges = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1, [len(cell)]])
        side, band, one = (rows.column(c).to_numpy() for c in ("side", "band", "one"))
        root, names_of = pd.factorize(rows.column("root").to_pandas())
        found = []
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2 or (root[a:b] == root[a]).all():
                continue
            own = rows.slice(a, b - a)
            keys = own.column("keys").combine_chunks().flatten().to_numpy().reshape(b - a, plan.bands)
            sets = [np.frombuffer(x.as_buffer(), dtype="<u8") for x in own.column("shingles")]
            found += [(names_of[root[a + i]], names_of[root[a + j]]) for i, j in across(threshold, int(band[a]), bool(one[a]), keys, sets, root[a:b], side[a:b])]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], type=pa.binary()) for k in (0, 1)], names=["a", "b"])

    def _cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            if not part.num_rows:
                continue
            cell = np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in names])
            last = np.flatnonzero((cell != cell[-1]).any(axis=1))
            whole = int(last[-1]) + 1 if len(last) else 0
            if held and (whole or [held[0].column(c)[0].as_py() for c in names] != cell[0].tolist()):
                yield links(pa.Table.from_batches([*held, part.slice(0, whole)]))
                held = []
            elif whole:
                yield links(pa.Table.from_batches([part.slice(0, whole)]))
            held.append(part.slice(whole))
        if held:
            yield links(pa.Table.from_batches(held))

    return _cells


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """tid, text for the distinct texts whose tid is in ``wanted``; equal texts are merged before they are dealt."""
    return docs.groupBy("tid").agg(F.first("text").alias("text")).join(wanted, "tid", "left_semi")


def _checked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, part) whose texts are similar enough; b's text goes to each of its parts."""
    one = texts.select(F.col("tid").alias("a"), F.col("text").alias("ta"))
    two = pairs.select("b", "part").distinct().join(texts.select(F.col("tid").alias("b"), F.col("text").alias("tb")), "b")
    met = pairs.join(one, "a").join(two, ["b", "part"])
    return cut(met.where(arrow_udf(_similarity, "double")("ta", "tb") >= threshold).select("a", "b"))


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """tid (a text's MD5), root for each text that is linked with a text of smaller tid."""
    ship(docs.sparkSession)
    plan = layout(threshold)
    docs = docs.where(F.col("text").isNotNull()).select("text", _tid().alias("tid"))
    signed = docs.select("tid", _signed(plan)("text").alias("s")).groupBy("tid").agg(F.first("s").alias("s"))
    signed = cut(signed.select("tid", F.col("s.keys").alias("keys"), F.col("s.n").alias("size")))
    members = signed.select("tid", "size", F.posexplode("keys").alias("band", "bucket"))
    shared = cut(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(members.join(shared, "bucket"))
    fame = members.groupBy("tid").agg(F.sum("n").alias("fame"))
    star = members.join(fame, "tid").groupBy("bucket").agg(F.max(F.struct("fame", "tid")).alias("s"))
    members = cut(members.join(cut(star.select("bucket", F.col("s.tid").alias("star"))), "bucket")).where(F.col("tid") != F.col("star"))
    pairs = members.groupBy(F.col("tid").alias("a"), F.col("star").alias("b")).agg(F.max("n").alias("n"))
    pairs = cut(pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / PART)).alias("part")))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct()
    texts = keep(_texts(docs, wanted))
    links = _checked(pairs, texts, threshold)
    roots = components(links)

    placed = cut(members.join(roots, "tid", "left").select("bucket", "band", "tid", "size", F.coalesce("root", "tid").alias("root")))
    groups = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    big = F.max(F.struct("n", "size", "root"))
    mixed = groups.groupBy("bucket").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("size"), big.alias("big")).where("roots > 1")
    chunks = lambda n, size: F.greatest(F.ceil(n / CHUNK), F.ceil(size / ELEMENTS), F.lit(1)).cast("int")
    n_big, n_rest = chunks(F.col("big.n"), F.col("big.size")), chunks(F.col("n") - F.col("big.n"), F.col("size") - F.col("big.size"))
    mixed = cut(mixed.select("bucket", F.col("big.root").alias("big"), (chunks(F.col("n"), F.col("size")) == 1).alias("whole"), n_big.alias("n_big"), n_rest.alias("n_rest")))
    open_ = placed.join(mixed, "bucket").withColumn("in_big", F.col("root") == F.col("big"))
    own = F.pmod(F.xxhash64("tid"), F.when(F.col("in_big"), F.col("n_big")).otherwise(F.col("n_rest"))).cast("int")
    open_ = open_.withColumn("own", own)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def cell(rows: DataFrame, kind: int, i: Column, j: Column, side: Column, one: Column) -> DataFrame:
        return rows.select("bucket", "band", F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), "tid", "root", side.alias("side"), one.alias("one"))

    zero, col = F.lit(0), F.col
    # a bucket of one chunk is a cell; in others members of the largest class meet the rest, and the rest meet each other
    single = cell(open_.where("whole"), 0, zero, zero, zero, F.lit(True))
    large = cell(open_.where("not whole and in_big").select("*", upto("n_rest").alias("other")), 1, col("own"), col("other"), zero, F.lit(False))
    small = cell(open_.where("not whole and not in_big").select("*", upto("n_big").alias("other")), 1, col("other"), col("own"), F.lit(1), F.lit(False))
    rest = cell(open_.where("not whole and not in_big").select("*", upto("n_rest").alias("other")), 2, F.least("own", "other"), F.greatest("own", "other"), col("own"), col("own") == col("other"))
    dealt = cut(single.unionByName(large).unionByName(small).unionByName(rest))
    sets = _texts_of(dealt, texts).join(signed.select("tid", "keys"), "tid")
    names = ["bucket", "kind", "i", "j"]
    more = dealt.join(keep(sets), "tid").repartition(*names).sortWithinPartitions(*names).mapInArrow(_cells(threshold, plan), "a binary, b binary")
    joined = components(more).select(F.col("tid").alias("root"), F.col("root").alias("top"))
    return roots.unionByName(joined.select(F.col("root").alias("tid"), F.col("root"))).join(joined, "root", "left").select("tid", F.coalesce("top", "root").alias("root")).where("tid <> root")


def _texts_of(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """tid and shingles of the texts in ``dealt``."""
    return texts.join(dealt.select("tid").distinct(), "tid", "left_semi").select("tid", arrow_udf(_shingles, "binary")("text").alias("shingles"))


def _named(docs: DataFrame, threshold: float) -> DataFrame:
    """tid, class_id, and keeper: whether this text's smallest doc_id is the one that stands for the class."""
    roots = classes(docs, threshold)
    ids = docs.select("doc_id", _tid().alias("tid")).where("tid is not null")
    least = ids.groupBy("tid").agg(F.min("doc_id").alias("least")).join(roots, "tid", "left").select("tid", "least", F.coalesce("root", "tid").alias("root"))
    least = cut(least)
    first = least.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("least"), F.col("tid").alias("tid"))).alias("f"))
    named = least.join(cut(first), "root").select("tid", F.col("f.least").alias("class_id"), (F.col("tid") == F.col("f.tid")).alias("keeper"))
    return cut(named)


def _tid() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def classify(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with ``class_id``: the smallest doc_id among the documents that are linked, directly or by others, with this one."""
    named = _named(docs, threshold).select(F.col("tid").alias("_tid"), F.col("class_id").alias("_class"))
    kept = [c for c in docs.columns if c.lower() != "class_id"]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), _tid().alias("_tid"), F.col("doc_id").alias("_id")).join(named, "_tid", "left")
    return held.select(*[F.col(f"_doc.`{c}`") for c in kept], F.when(F.col("_tid").isNull(), F.col("_id")).otherwise(F.col("_class")).alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, that with the class's smallest doc_id; null texts all stay."""
    stay = _named(docs, threshold).where("keeper").select(F.col("tid").alias("_tid"), F.coalesce("class_id", F.lit(0)).alias("_id"), F.col("class_id").isNull().alias("_none"))
    key = ["_tid", "_id", "_none"]
    held = docs.where(F.col("text").isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), _tid().alias("_tid"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"))
    held = held.join(stay, key).withColumn("_turn", F.row_number().over(Window.partitionBy(*key).orderBy(*key))).where("_turn = 1")
    return held.select("_doc.*").unionByName(docs.where(F.col("text").isNull()))
