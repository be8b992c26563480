"""Line dedup by content-defined chunks of lines, with an exact way for what they leave.

A document's lines are hashed, and a hash rolls over each window of lines: where it
falls in one of ``DIVISOR`` classes, a chunk ends. So boundaries depend on a few lines
around them and not on what stands before: a passage that moves between documents
is cut the same way. Chunks of several lines (and lines of at least ``LONG_WORDS``
words, which are passages by themselves) that occur again anywhere are removed after
comparing their bytes; their first place, by smallest (doc_id, text, place), stays.

``dedup`` does that only. The lines at the ends of a repeated passage share a chunk with
what stands around it, and a short passage may have no chunk of its own; so
``dedup_runs``, which the queries use, goes on with the pairs of neighbouring worded lines
(with the blank lines between them), but for those in chunks that are removed: pairs that
occur again go too, but for their first place. As the pairs of a run overlap, a run
of two worded lines or more goes from its first line to its last, and at least one copy
of each line stays. Chunks then go from their first worded line to their last, as a run
of pairs does; as a removed chunk's pairs all stand in its first place as well, the
outcome is that of all pairs. Not found: what is repeated from or up to the middle of a
line, and single lines of fewer words.

Two passes go over the texts. The first emits hashes only, and those that occur
once leave at once. The second takes the chunks and pairs still in question with their
bytes; equal ones are merged before they are dealt, so a passage that a third of
all documents hold is a few rows. What such a passage's places are joined with is
written first, so that Spark can split the join.

Defined cases: a null or empty text is left as it is; what holds no word is
never removed by itself; a document that has no word left becomes an empty text;
rows equal in doc_id and text keep and lose the same lines; equal texts under
different ids lose what the first keeps; repeats may overlap, so of equal lines
in a row one stays; documents of null id come first; an empty table gives an empty
result; further columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from contactspark.llm.common import cut, keep
from contactspark.session import ship

#: Lines in the rolling window; one in so many places ends a chunk; most lines of a chunk; words that make a line a passage.
WINDOW, DIVISOR, MOST, LONG_WORDS = 2, 4, 16, 50
_MASK, _BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15
_OUT = _BASE**WINDOW & _MASK
#: Chunks are numbered from here on and pairs from 0, so that the numbers tell which is which.
_FIRST = -(1 << 30)


def chunks(text: bytes) -> list[tuple[int, int, int]]:
    """Chunks of a text as (first line, lines, byte length with inner line feeds), from first to last line.

    The hash of the last ``WINDOW`` lines rolls: the new line enters, the oldest leaves.
    """
    lines = text.split(b"\n")
    out, first, size, rolled, held = [], 0, -1, 0, []
    for i, line in enumerate(lines):
        if len(line.split(None, LONG_WORDS)) >= LONG_WORDS:  # a passage by itself: it is a chunk, whatever stands around it
            if i > first:
                out.append((first, i - first, size))
            out.append((i, 1, len(line)))
            first, size, rolled, held = i + 1, -1, 0, []
            continue
        h = xxhash.xxh64_intdigest(line)
        held.append(h)
        rolled = (rolled * _BASE + h) & _MASK
        if len(held) > WINDOW:
            rolled = (rolled - held.pop(0) * _OUT) & _MASK
        size += len(line) + 1
        if (len(held) == WINDOW and (rolled ^ rolled >> 29) % DIVISOR == 0) or i - first + 1 == MOST:
            out.append((first, i - first + 1, size))
            first, size = i + 1, -1
    if first < len(lines):
        out.append((first, len(lines) - first, size))
    return out


def removable(chunk: bytes, n_lines: int) -> bool:
    """Whether a chunk may be removed if it occurs again: several lines with words, or a passage by itself."""
    return sum(1 for x in chunk.split(b"\n") if x.strip()) > 1 if n_lines > 1 else len(chunk.split(None, LONG_WORDS)) >= LONG_WORDS


def _bytes(text: bytes) -> Iterator[tuple[int, bytes, int]]:
    at = 0
    for number, (_, n, size) in enumerate(chunks(text)):
        yield number, text[at : at + size], n
        at += size + 1


def _chunks(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    return ((_FIRST + number, 0, chunk) for number, chunk, n in _bytes(text) if removable(chunk, n))


def _without_chunks(text: bytes, gone: set[int]) -> tuple[bytes, int]:
    return b"\n".join(c for i, c, _ in _bytes(text) if _FIRST + i not in gone), len(gone)


def _places(text: bytes, lines: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """Each removable chunk, then each pair of neighbouring worded lines, as (number, number of the chunk that a pair lies in or 0, first worded line, last worded line)."""
    worded, pairs, last = [], [], None
    for number, (first, n, _) in enumerate(chunks(text)):
        own = [i for i in range(first, first + n) if lines[i].strip()]
        if own and last is not None:
            pairs.append((0, last, own[0]))
        pairs += [(_FIRST + number, i, j) for i, j in zip(own, own[1:], strict=False)]
        if len(own) > 1 or (n == 1 and len(lines[first].split(None, LONG_WORDS)) >= LONG_WORDS):
            worded.append((_FIRST + number, 0, own[0], own[-1]))
        last = own[-1] if own else last
    yield from worded
    yield from ((number, *pair) for number, pair in enumerate(pairs))


def _runs(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    lines = text.split(b"\n")
    return ((number, chunk, b"\n".join(lines[i : j + 1])) for number, chunk, i, j in _places(text, lines))


def _without_runs(text: bytes, gone: set[int]) -> tuple[bytes, int]:
    lines = text.split(b"\n")
    lost = {k for number, _, i, j in _places(text, lines) if number in gone for k in range(i, j + 1)}
    rest = [line for k, line in enumerate(lines) if k not in lost]
    return b"\n".join(rest) if any(line.strip() for line in rest) else b"", len(lost)


#: What of a text may be removed: number, number of the chunk that a pair lies in (else 0), bytes.
Parts = Callable[[bytes], Iterator[tuple[int, int, bytes]]]


def _hashed(parts: Parts) -> Callable:
    @arrow_udf("array<struct<number:int,h:bigint>>")
    def hashed(text: pa.Array) -> pa.Array:
        out = [[{"number": i, "h": xxhash.xxh3_64_intdigest(c, seed=i < 0) - (1 << 63)} for i, _, c in parts(t.as_py() or b"")] for t in text.cast(pa.binary())]
        return pa.array(out, type=pa.list_(pa.struct([("number", pa.int32()), ("h", pa.int64())])))

    return hashed


def _chosen(parts: Parts) -> Callable:
    @arrow_udf("array<struct<number:int,within:int,chunk:binary>>")
    def chosen(text: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for t, wanted in zip(text.cast(pa.binary()), numbers.to_pylist(), strict=True):
            wanted = set(wanted or ())
            out.append([{"number": i, "within": w, "chunk": c} for i, w, c in parts(t.as_py() or b"") if i in wanted])
        return pa.array(out, type=pa.list_(pa.struct([("number", pa.int32()), ("within", pa.int32()), ("chunk", pa.binary())])))

    return chosen


def _without(take: Callable[[bytes, set[int]], tuple[bytes, int]]) -> Callable:
    @arrow_udf("struct<text:string,n:bigint>")
    def without(text: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for t, gone in zip(text.cast(pa.binary()), numbers.to_pylist(), strict=True):
            rest, n = (None, 0) if gone is None else take(t.as_py(), set(gone))
            out.append({"text": None if rest is None else rest.decode("utf-8", "replace"), "n": n})
        return pa.array(out, type=pa.struct([("text", pa.string()), ("n", pa.int64())]))

    return without


KEY = ["_id", "_none", "_k1", "_k2"]


def _keyed() -> list[Column]:
    """What tells documents apart: doc_id and two hashes of the text."""
    return [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2")]


def _place() -> Column:
    return F.struct((~F.col("_none")).alias("named"), "_id", "_k1", "_k2", "number")


def _again(parts: DataFrame) -> DataFrame:
    """Where parts stand whose bytes have an earlier place among ``parts``."""
    same = cut(parts.groupBy("chunk").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first <> last").select(F.col("chunk").alias("bytes"), "first"))
    return parts.join(same, F.col("chunk") == F.col("bytes")).where(_place() != F.col("first")).select(*KEY, "number")


def _dedup(docs: DataFrame, parts: Parts, take: Callable[[bytes, set[int]], tuple[bytes, int]], pairs: bool) -> DataFrame:
    """``docs`` without the ``parts`` of texts that occur before, which ``take`` takes out: chunks, then ``pairs`` but for those in chunks that go.

    Texts are dealt once, to meet the numbers of their parts in question, and the
    outcome is written; what follows moves the bytes of those parts and the documents
    that hold them, and all others are read straight from there. Up to the bytes,
    documents and parts go by 64-bit hashes; equal hashes only add to what is compared.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != "n_removed"]
    brief = F.xxhash64(F.lit(2), "doc_id", "text").alias("_k")
    hashed = keep(docs.where("text is not null").select(brief, _hashed(parts)("text").alias("c")))
    each = hashed.select("_k", F.explode("c").alias("c")).select("_k", "c.*")
    several = cut(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    asked = each.join(several, "h").groupBy("_k").agg(F.collect_set("number").alias("numbers"))
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), brief, *_keyed())
    held = keep(told.join(asked, "_k", "left").drop("_k"))

    some = held.where("numbers is not null")
    taken = keep(some.select(*KEY, F.explode(_chosen(parts)(F.col("_doc.text"), F.col("numbers"))).alias("c")).select(*KEY, "c.*"))
    again = _again(taken.where("number < 0"))
    if pairs:
        again = cut(again)
        left = keep(taken.where("number >= 0").join(again.withColumnRenamed("number", "within"), [*KEY, "within"], "left_anti"))
        again = again.unionByName(_again(left))
    gone = cut(again.groupBy(*KEY).agg(F.collect_set("number").alias("gone")))

    def given(text: Column, n: Column) -> list[Column]:
        return [*[(text if c.lower() == "text" else F.col(f"_doc.`{c}`")).alias(c) for c in kept], n.cast("long").alias("n_removed")]

    text = F.col("_doc.text")
    left = _without(take)(F.when(F.col("gone").isNotNull(), text), F.col("gone"))
    changed = some.join(gone, KEY, "left").withColumn("_left", left)
    changed = changed.select(*given(F.when(F.col("gone").isNull(), text).otherwise(F.col("_left.text")), F.col("_left.n")))
    return changed.unionByName(held.where("numbers is null").select(*given(text, F.lit(0))))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and with ``n_removed`` chunks (a column of that name is replaced)."""
    return _dedup(docs, _chunks, _without_chunks, pairs=False)


def dedup_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks, and what they leave of repeated runs of lines, taken out of ``text``, and with ``n_removed`` lines (a column of that name is replaced)."""
    return _dedup(docs, _runs, _without_runs, pairs=True)
