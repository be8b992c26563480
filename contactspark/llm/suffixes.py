"""Suffix-array dedup: a radix sort of all suffixes that stops at the threshold; the groups it ends with are the repeated windows.

Of the order of suffixes only groups matter: suffixes that agree in their first
``length`` bytes. They are found by passes over digits, the most significant first.
After each pass a suffix that stands alone leaves, and so does what is already known
to be repeated; the rest goes on with the next digit. A group is named by the hash of
all digits read so far, so a pass is an aggregate by name: a group that holds a third
of all suffixes is summed before it is shuffled, and no task sorts it.

Which bytes make the first digit is free, as long as equal windows have equal digits.
It is the window's anchor: of its grams of ``GRAM`` bytes the one of least hash, the
first of equals. Neighbouring windows mostly share an anchor, so they go as one row, a
*block* (windows that begin ``lo`` to ``hi`` bytes before the anchor), where a digit
of leading bytes would make a row of each byte of the corpus. The digits are then

1. the anchor: a row for each block, some 170 bytes of text;
2. what all windows of a block of 32 share (``length`` - 31 bytes), for the blocks in question;
3. what those of a block of 4 share;
4. the whole window.

After a pass, a block whose bytes (all of its windows together) occur again is done: its
windows are all repeated. A block whose digit occurs nowhere else is done too. Others
are cut for the next pass; with them goes one of each kind of block that is done but
shares their digit, so that they can be found equal to its windows. So only the edges of
repeated passages reach the last digit.

Digits are named by 64-bit hashes, which only choose what is compared further; what
is called equal is equal in 128 bits of xxh3, beside its place around the anchor.

Defined cases: a null text is empty; texts of fewer than ``length`` bytes lose nothing;
strings are judged on the input, overlaps count, and all places of a string go, the first
one too; rows equal in all columns are as many documents; what is left is bytes, as a cut
may fall within a code point; an empty table gives an empty result; other columns are
kept, and columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from contactspark.llm.common import cut, keep
from contactspark.llm.shingles import scramble
from contactspark.session import ship

#: Bytes of a window and, at most, of a gram; windows of a block in the passes after the first.
LENGTH, GRAM, STEPS = 400, 64, (32, 4, 1)
#: A key of more rows than this, and than their ``MOST``-th part, is joined by broadcast: there are at most ``MOST`` of them.
HEAVY, MOST = 1000, 50_000
#: Bits for a place in the part of a text that is read at once.
_BITS = 20
_MASK = np.uint64((1 << _BITS) - 1)
_ROOTS = scramble(np.arange(256, dtype=np.uint64))
_STEP = 0x9E3779B97F4A7C15
_BLOCK = "at:int,lo:int,hi:int,core:bigint,u1:bigint,u2:bigint"


def gram_of(length: int) -> int:
    """Bytes of a gram: a power of two, a quarter of the window at most."""
    gram = 1
    while 2 * gram <= min(GRAM, length // 4):
        gram *= 2
    return gram


def _grams(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` bytes, made of those of its halves."""
    h, size = _ROOTS[raw], 1
    while size < gram:
        h = h[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + h[size:]
        size *= 2
    return scramble(h)


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of windows with one anchor: the anchor's place, its gram's hash, and the first and last window."""
    gram = gram_of(length)
    wide, most = length - gram + 1, (1 << _BITS) - length
    found: list[list[np.ndarray]] = [[np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]]
    for start in range(0, len(text) - length + 1, most):
        part = np.frombuffer(text, dtype=np.uint8, count=min(most + length - 1, len(text) - start), offset=start)
        hashes = _grams(part, gram)
        least, size = (hashes & ~_MASK) | np.arange(len(hashes), dtype=np.uint64), 1
        while 2 * size <= wide:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < wide:
            least = np.minimum(least[: size - wide], least[wide - size :])
        place = (least & _MASK).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        for own, new in zip(found, (place[first] + start, hashes[place[first]], first + start, last + start), strict=True):
            own.append(new)
    at, core, first, last = (np.concatenate(x) for x in found)
    return at, core, first, last


def _hashed(parts: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each part (bytes, seed) as two longs."""
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b, s) for b, s in parts), dtype="<i8")
    return raw[::2], raw[1::2]


def _lists(columns: list[tuple[str, pa.DataType, np.ndarray]], counts: list[int]) -> pa.Array:
    """An array of structs for each row, which has so many of them."""
    structs = pa.StructArray.from_arrays([pa.array(v, type=t) for _, t, v in columns], names=[n for n, _, _ in columns])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), type=pa.int32()), structs)


def _seed(lo: int, hi: int) -> int:
    return lo << 32 | hi


def _blocks(rows: list[tuple[np.ndarray, ...]]) -> pa.Array:
    """Blocks (at, lo, hi, core, u1, u2) of each row."""
    names = [("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("core", pa.int64()), ("u1", pa.int64()), ("u2", pa.int64())]
    whole = [np.concatenate([r[k] for r in rows]) if rows else np.empty(0, dtype=np.int64) for k in range(len(names))]
    return _lists([(n, t, v) for (n, t), v in zip(names, whole, strict=True)], [len(r[0]) for r in rows])


def first_blocks(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """The blocks of the first pass."""
    at, core, first, last = anchors(text, length)
    lo, hi = at - last, at - first
    u1, u2 = _hashed([(text[a : b + length], _seed(x, y)) for a, b, x, y in zip(first.tolist(), last.tolist(), lo.tolist(), hi.tolist(), strict=True)])
    return at, lo, hi, core.view(np.int64), u1, u2


def cut_blocks(piece: bytes, at: int, most: int, lo: int, hi: int, step: int, length: int) -> tuple[np.ndarray, ...]:
    """A block cut at multiples of ``step``; ``piece`` begins ``most`` bytes before the anchor."""
    edges = [(i, max(lo, i), min(hi, i + step - 1)) for i in range(lo // step * step, hi + 1, step)]
    core = np.array([xxhash.xxh3_64_intdigest(piece[most - i : most - i - step + 1 + length], i) - (1 << 63) for i, _, _ in edges], dtype=np.int64)
    u1, u2 = _hashed([(piece[most - b : most - a + length], _seed(a, b)) for _, a, b in edges])
    return np.full(len(edges), at), np.array([a for _, a, _ in edges]), np.array([b for _, _, b in edges]), core, u1, u2


def _read(length: int) -> Callable:
    """A text's bytes (compressed), how many, and its first blocks."""

    @arrow_udf(f"struct<packed:binary,n:bigint,blocks:array<struct<{_BLOCK}>>>")
    def read(text: pa.Array) -> pa.Array:
        raw = [t.as_py() or b"" for t in text.cast(pa.binary())]
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.StructArray.from_arrays([pa.array([pack(t) for t in raw], type=pa.binary()), pa.array([len(t) for t in raw], type=pa.int64()), _blocks([first_blocks(t, length) for t in raw])], names=["packed", "n", "blocks"])

    return read


def _unpack(packed: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed.as_py())


def _pieces(length: int) -> Callable:
    """The bytes of all windows of the blocks (at, lo, hi, known) that are asked for."""

    @arrow_udf("array<struct<at:int,lo:int,hi:int,known:boolean,piece:binary>>")
    def pieces(packed: pa.Array, asked: pa.Array) -> pa.Array:
        out = []
        for p, own in zip(packed, asked.to_pylist(), strict=True):
            text = _unpack(p)
            out.append([b | {"piece": text[b["at"] - b["hi"] : b["at"] - b["lo"] + length]} for b in own])
        return pa.array(out, type=pa.list_(pa.struct([("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("known", pa.bool_()), ("piece", pa.binary())])))

    return pieces


def _cut(step: int, length: int) -> Callable:
    @arrow_udf(f"array<struct<{_BLOCK}>>")
    def cut_(piece: pa.Array, at: pa.Array, most: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        rows = zip(piece.cast(pa.binary()), *(x.to_pylist() for x in (at, most, lo, hi)), strict=True)
        return _blocks([cut_blocks(p.as_py(), a, m, low, high, step, length) for p, a, m, low, high in rows])

    return cut_


_LEFT = "struct<kept:binary,n_removed:bigint,spans:array<struct<start:bigint,end:bigint>>>"


def _without(packed: pa.Array, found: pa.Array) -> pa.Array:
    kept, removed, spans = [], [], []
    for p, own in zip(packed, found.to_pylist(), strict=True):
        text, merged = _unpack(p), []
        for s in sorted((f["start"], f["end"]) for f in own or ()):
            if merged and s[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s[1])
            else:
                merged.append(list(s))
        ends = [0, *(x for s in merged for x in s), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
        removed.append(sum(b - a for a, b in merged))
        spans.append([{"start": a, "end": b} for a, b in merged])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.StructArray.from_arrays([pa.array(kept, type=pa.binary()), pa.array(removed, type=pa.int64()), pa.array(spans, type=kind)], names=["kept", "n_removed", "spans"])


def _among(rows: DataFrame, wanted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` whose ``keys`` are in ``wanted`` (keys and n, the rows that have them). Rows of common keys aren't dealt: those keys, at most ``MOST``, are broadcast."""
    bar = max(HEAVY, total // MOST)
    marked = rows.join(F.broadcast(wanted.where(F.col("n") > bar).select(*keys, F.lit(True).alias("_heavy"))), keys, "left")
    light = marked.where("_heavy is null").drop("_heavy").join(wanted.where(F.col("n") <= bar).select(*keys), keys)
    return marked.where("_heavy").drop("_heavy").select(*rows.columns).unionByName(light.select(*rows.columns))


def _repeated(blocks: DataFrame, kinds: DataFrame, total: int) -> DataFrame:
    """The blocks that weren't known to be repeated and whose kind (u1, u2) has others."""
    return _among(blocks.where("not known"), kinds.where("n > 1").select("u1", "u2", "n"), ["u1", "u2"], total).select("uid", "at", "lo", "hi")


def _pass(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a pass finds among ``blocks`` (uid, at, lo, hi, core, u1, u2, known): blocks that are repeated as a whole, and those to be cut for the next pass (known ones for comparison)."""
    total = blocks.count()
    kinds = blocks.groupBy("u1", "u2").agg(*[F.min(c).alias(c) for c in ("core", "lo", "hi", "uid")], F.min_by("at", "uid").alias("at"), F.count("*").alias("n"), F.max("known").alias("known"))
    kinds = cut(kinds.withColumn("known", F.col("known") | (F.col("n") > 1)))
    digits = kinds.groupBy("core").agg(F.count("*").alias("n"), F.min("known").alias("known")).where("n > 1 and not known").select("core", "n")
    asked = _among(kinds.drop("n"), cut(digits), ["core"], total).select("uid", "at", "lo", "hi", "known")
    return _repeated(blocks, kinds, total), asked


def _last_pass(windows: DataFrame) -> DataFrame:
    """The windows (uid, at, lo, hi, u1, u2, known) that are repeated and weren't known to be."""
    return _repeated(windows, cut(windows.groupBy("u1", "u2").agg(F.count("*").alias("n")).where("n > 1")), windows.count())


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without its column text, and with ``kept`` (the bytes of the text that no repeated string of ``length`` bytes covers), ``n_bytes`` of the text, ``n_removed`` of them and ``spans`` (start, end) of what is removed."""
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c.lower() not in ("text", "kept", "n_bytes", "n_removed", "spans")]
    doc = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_"))
    held = docs.select(doc.alias("_doc"), F.monotonically_increasing_id().alias("uid"), _read(length)("text").alias("r"))
    held = keep(held.select("_doc", "uid", "r.*"))

    blocks = held.select("uid", F.explode("blocks").alias("b")).select("uid", "b.*", F.lit(False).alias("known"))
    total = held.agg(F.coalesce(F.sum(F.size("blocks")), F.lit(0))).first()[0]
    again = cut(blocks.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"))
    found, asked = _pass(keep(_among(blocks, again, ["core"], total)))

    asked = asked.groupBy("uid").agg(F.collect_list(F.struct("at", "lo", "hi", "known")).alias("asked"))
    pieces = held.select("uid", "packed").join(cut(asked), "uid").select("uid", F.explode(_pieces(length)("packed", "asked")).alias("p"))
    pieces = keep(pieces.select("uid", "p.*"))
    found, own = [found], pieces.withColumn("to", F.col("hi"))
    for step in STEPS:
        smaller = own.select("uid", "known", F.explode(_cut(step, length)("piece", "at", "to", "lo", "hi")).alias("b"))
        if step == 1:
            found.append(_last_pass(keep(smaller.select("uid", "b.at", "b.lo", "b.hi", "b.u1", "b.u2", "known"))))
            break
        more, asked = _pass(keep(smaller.select("uid", "b.*", "known")))
        found.append(more)
        whole = pieces.select("uid", "at", F.col("lo").alias("from"), F.col("hi").alias("to"), "piece")
        own = cut(asked).join(whole, ["uid", "at"]).where("lo >= from and hi <= to")

    spans = reduce(DataFrame.unionByName, found).select("uid", (F.col("at") - F.col("hi")).cast("long").alias("start"), (F.col("at") - F.col("lo") + length).cast("long").alias("end"))
    spans = cut(spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("found")))
    done = held.select("_doc", "uid", "packed", "n").join(spans, "uid", "left").select("_doc", "n", arrow_udf(_without, _LEFT)("packed", "found").alias("w"))
    return done.select(*[F.col(f"_doc.`{c}`") for c in others], F.col("n").alias("n_bytes"), "w.n_removed", "w.spans", "w.kept")
