"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Documents are tokenized, closed by an end token and, where longer than a sequence,
cut into pieces. Only the number of pieces of each length (at most as many numbers
as a sequence has tokens) reaches the driver. There best-fit decreasing runs over
these counts: equal sequences with equal room are one group, and a step places as
many pieces of a length as such a group takes. The plan says which ranks within a
length go to which sequences. Pieces get their rank within their length (a common
length is ranked in salted parts that are then put end to end) and take their
slots by joining the plan on length and block of ranks.

Tokens of a text are those of its words one by one: the tokenizer splits at white
space before anything else, so each worker keeps the tokens of the words it met,
looks the different words of a run of texts up at once, and splits those that are
new and plain Latin itself, all together, where the tokenizer's file states the rules
for that which it knows. Words that hold one of the tokenizer's special strings go
through the whole tokenizer, which gives these their own ids; where such a string
could reach beyond a word, whole texts do.

Defined cases: a null or empty text is one piece of the end token alone; equal rows
are packed as often as they occur; an empty table gives an empty result; further
columns named in ``carry`` are kept, but one that is named like a column of the
result is replaced by that.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import re
import sys
from array import array
from collections import defaultdict
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from contactspark.llm.common import cut, literal_longs
from contactspark.session import ship

SEQUENCE, END = 2048, 0
#: Pieces of a length that are ranked in one part (or the root of their number, if that is more), and ranks in a block of the plan's join.
PART, RANKS = 4096, 4096
#: Rows up to which the plan (one for each segment and block of ranks) is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes that a worker keeps words and their tokens in, about, with what Python needs for each; at half of them, what wasn't met since the last time goes. Longer words aren't kept.
BYTES_KEPT, OVERHEAD, LONG = 96 << 20, 150, 64
#: Bytes of texts whose words are looked up together, so that each word is looked up once.
BYTES_AT_ONCE = 4 << 20
_PIECES = "array<struct<start:bigint,ids:binary>>"
_RESULT = {"piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"}
_encoders: dict[str, _Encoder] = {}

# What a tokenizer file says of its normalizer and splitter where words may be split here.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _CONTRACTIONS + "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: What words that may be split here don't have: all but printable ASCII and the letters of Latin-1, which NFC leaves alone; and the parts of such words in lower case, with the line ends between words.
_ODD = re.compile("[^\n\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]").search
_PARTS = re.compile(_CONTRACTIONS + "|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|\n|[^\na-z0-9\xdf-\xf6\xf8-\xff]+").findall
#: Byte-level characters: printable bytes stand for themselves, the others in order for those from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = dict(zip([b for b in range(256) if b not in set(_SHOWN)], range(256, 512), strict=False))
#: What stands between the ids of two words; no id has these bytes.
_MARK = b"\xff" * 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Encoder:
    """A tokenizer, its model where plain words may be split here, and the ids of the words, and of the parts of words, that this worker met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        told = json.loads(self.whole.to_str())
        known = told["normalizer"] == _NORMALIZER and told["pre_tokenizer"] == _SPLITTER
        self.model = self.whole.model if known else None
        special = told["added_tokens"]
        self.special = re.compile("|".join(re.escape(x["content"]) for x in special) or "(?!)", re.IGNORECASE).search
        self.wordwise = known and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or len(x["content"].split()) != 1 for x in special)
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.long: list[bytes] = []
        self.bytes = 0

    def keep(self, words: Collection[bytes], ids: list[bytes]) -> None:
        self.words.update(zip(words, ids, strict=True))
        self.bytes += sum(map(len, words)) + sum(map(len, ids)) + OVERHEAD * len(ids)
        if max(map(len, words), default=0) > LONG:
            self.long += [w for w in words if len(w) > LONG]

    def lost(self, words: Collection[bytes]) -> list[bytes]:
        """Those of ``words`` that aren't kept; what only the older ones hold is kept anew."""
        fresh = list(itertools.filterfalse(self.words.__contains__, words))
        met = list(filter(self.older.__contains__, fresh))
        self.keep(met, [self.older[w] for w in met])
        return list(itertools.filterfalse(self.older.__contains__, fresh))

    def learn(self, words: list[bytes]) -> None:
        """Keeps the ids of words: plain ones are split all at once, and the ids of their parts put together."""
        lines = b"\n".join(words).decode("utf-8", "replace")
        if _ODD(lines) or self.special(lines):
            odd = {w: t for w, t in zip(words, lines.split("\n"), strict=True) if _ODD(t) or self.special(t)}
            self.keep(odd, [_held(e.ids) for e in self.whole.encode_batch(list(odd.values()), add_special_tokens=False)])
            words = [w for w in words if w not in odd]
            lines = b"\n".join(words).decode()
        if words:
            parts = _PARTS(lines.lower())
            held = {p.encode(): p for p in set(parts) - {"\n"}}
            lost = self.lost(held)
            self.keep(lost, [_held([t.id for t in self.model.tokenize(p.decode() if p.isascii() else p.decode("latin-1").translate(_BYTES))]) for p in lost])
            ids = {text: self.words[p] for p, text in held.items()} | {"\n": _MARK}
            fresh = dict(zip(words, b"".join(map(ids.__getitem__, parts)).split(_MARK), strict=True))
            for p in lost:  # kept by now
                fresh.pop(p, None)
            self.keep(fresh, list(fresh.values()))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.wordwise:
            return [_held(e.ids) for e in self.whole.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        if self.bytes > BYTES_KEPT // 2:
            self.older, self.words, self.bytes = self.words, {}, 0
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string(), safe=False))
        coded = split.flatten().dictionary_encode()
        words = _slices(coded.dictionary, "i4")
        self.words[b""] = b""  # before and after outer white space
        self.learn(self.lost(words))
        ids = pa.array([self.words[w] for w in words], pa.large_binary()).take(coded.indices)
        out = _slices(ids, "i8", split.offsets.to_numpy())
        for w in self.long:
            self.bytes -= len(w) + len(self.words.pop(w)) + OVERHEAD
        self.long.clear()
        return out


def _slices(values: pa.Array, offset: str, bounds: np.ndarray | slice = slice(None)) -> list[bytes]:
    """The bytes between every two of the ``bounds`` (values' numbers; all as they are) of new binary values, of which none is null."""
    _, ends, data = values.buffers()
    data, ends = data.to_pybytes() if data else b"", np.frombuffer(ends, offset)[: len(values) + 1][bounds].tolist()
    return [data[i:j] for i, j in itertools.pairwise(ends)]


def _held(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def encode(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    A word of Latin letters, digits and signs is split the way the tokenizer does it,
    and its parts go to the model by themselves; words with other characters go through
    the whole tokenizer.
    """
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path].encode(texts)


def _batches(texts: list[bytes]) -> Iterator[list[bytes]]:
    """``texts`` in runs that reach ``BYTES_AT_ONCE`` with their last."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BYTES_AT_ONCE:
            yield texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


def _pieces(path: str, sequence: int, end: int):
    close = np.array([end], dtype="<u4").tobytes()

    @arrow_udf(_PIECES)
    def pieces(text: pa.Array) -> pa.Array:
        out, texts = [], [t.as_py() or b"" for t in text.cast(pa.binary())]
        for some in _batches(texts):
            for ids in encode(some, path):
                ids += close
                out.append([{"start": i // 4, "ids": ids[i : i + 4 * sequence]} for i in range(0, len(ids), 4 * sequence)])
        return pa.array(out, type=pa.list_(pa.struct([("start", pa.int64()), ("ids", pa.binary())])))

    return pieces


def tokenize(docs: DataFrame, carry: list[str], tokenizer: str | None = None, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """Columns in ``carry``, piece (from 0), start, length, and ids (little-endian unsigned 32-bit) for each piece."""
    ship(docs.sparkSession)
    kept = [c for c in dict.fromkeys(carry) if c.lower() not in _RESULT]
    own = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in kept])
    held = docs.select(own.alias("_own"), F.posexplode(_pieces(tokenizer or default_tokenizer(), sequence, end)("text")).alias("piece", "_p"))
    return held.select(*[F.col(f"_own.`{c}`") for c in kept], "piece", "_p.start", (F.octet_length("_p.ids") / 4).cast("long").alias("length"), "_p.ids")


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Segments (length, first rank, pieces, first sequence, pieces to a sequence, offset in it) of best-fit decreasing, and the number of sequences."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: groups of sequences (first, how many)
    segments, used = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = [r for r in room if r >= length and room[r]]
            if fits:
                free = min(fits)
                first, n = room[free].pop()
            else:
                free, first, n = sequence, used, -(-left // (sequence // length))
                used += n
            each = free // length
            take = min(n, left // each)
            if take:
                segments.append((length, rank, take * each, first, each, sequence - free))
                room[free - each * length].append((first, take))
                rank, left, first, n = rank + take * each, left - take * each, first + take, n - take
            if n and 0 < left < each:
                segments.append((length, rank, left, first, left, sequence - free))
                room[free - left * length].append((first, 1))
                left, first, n = 0, first + 1, n - 1
            if n:
                room[free].append((first, n))
    return segments, used


def place(pieces: DataFrame, length: str = "length", sequence: int = SEQUENCE) -> DataFrame:
    """``pieces`` with sequence_id and offset (gapless from 0 in each sequence); columns of these names are replaced."""
    spark = pieces.sparkSession
    own = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    kept = F.struct(*[F.col(f"`{c}`") for c in own])
    rows = cut(pieces.select(F.col(f"`{length}`").cast("long").alias("length"), kept.alias("own"), F.monotonically_increasing_id().alias("m")))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = [-(-n // max(PART, math.isqrt(n))) for n in (counts.get(i, 1) for i in range(sequence + 1))]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("m"), F.get(literal_longs(parts), F.col("length").cast("int"))))
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy("length", "part").orderBy("m"))).join(starts, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("turn") - 1).withColumn("block", F.floor(F.col("rank") / RANKS))
    segments, _ = plan(counts, sequence)
    n_rows = sum((first + n - 1) // RANKS - first // RANKS + 1 for _, first, n, *_ in segments)
    table = spark.createDataFrame(segments, "length long, first long, pieces long, sequence long, each long, at long")
    table = table.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / RANKS), F.floor((F.col("first") + F.col("pieces") - 1) / RANKS))))
    table = F.broadcast(table) if n_rows <= BROADCAST_ROWS else table.hint("merge")
    slot = F.col("rank") - F.col("first")
    met = ranked.join(table, ["length", "block"]).where((slot >= 0) & (slot < F.col("pieces")))
    sequence_id, offset = F.col("sequence") + F.floor(slot / F.col("each")), F.col("at") + slot % F.col("each") * F.col("length")
    return met.select(*[F.col(f"own.`{c}`") for c in own], sequence_id.alias("sequence_id"), offset.alias("offset"))


def pack(docs: DataFrame, carry: list[str], tokenizer: str | None = None, sequence: int = SEQUENCE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: ``carry``, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    pieces = tokenize(docs, carry, tokenizer, sequence, end).withColumn("ids_crc32", F.crc32("ids"))
    return place(pieces if keep_ids else pieces.drop("ids"), sequence=sequence)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each full sequence, from pieces packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def efficiency(total: Column, n: Column, sequence: int = SEQUENCE) -> Column:
    """Share of the sequences' tokens that documents fill."""
    return total / (n * sequence)
