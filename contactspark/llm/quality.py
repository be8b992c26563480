"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated from labelled rows.

One Arrow pass reads each whole text and counts words, symbols, repeated lines
and repeated five-word windows. The base rule rejects documents of under ten
words or with more than a fifth of their words in repeated windows. The forest
sees ratios of the counts; documents whose mean path over its random splits is
short score high, and those above the calibrated threshold are rejected too.

All labelled rows that pass the base rule make the model: each tree is grown on
``PSI`` of all good ones, drawn for it alone (an isolation forest is made of such
trees, which differ by what they are drawn), ranges are exact percentiles of all
rows, and the threshold is the best of all that part their scores. The driver
gets the drawn rows, a few of each kind of aggregate, and the sums of each
partition, never the labelled rows. Counts are made for every row and written, for
the model and the verdict; where texts are asked for, the verdict's pass makes them
again, as to write the texts beside them takes the disk that they take.

Defined cases: a null text has no words and fails the base rule; rows with
equal ids or texts are judged one by one; labels that are null, or of ids that
no document has, are ignored; of several labels of an id the largest holds; with
no labelled rows, or rows of one class only, the base rule decides alone; an
empty table gives an empty result; further columns of the input are kept, and a
computed column replaces an input column of its name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from contactspark.llm.common import literal_longs
from contactspark.session import keep, ship

#: Trees, and rows that each tree is grown on, drawn from all good labelled rows.
TREES, PSI = 100, 256
#: Share of labelled good rows that the threshold may reject at most.
FALSE_REJECTS = 0.002
#: How far splits may lie outside a node's rows, as a share of the feature's range over all labelled rows.
MARGIN = 0.8
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]
_SPACE = b" \t\n\x0b\x0c\r"
_SPACE_AND_TAILS = _SPACE + bytes(range(0x80, 0xC0))  # and all but the first byte of each code point
_SYMBOLS, _UPPER, _MARKS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window which the text holds twice or more."""
    ids: dict[bytes, int] = {}
    coded = [ids.setdefault(w, len(ids)) for w in words]
    n, v = len(coded), len(ids)
    if n <= WINDOW:
        return 0
    a = np.array(coded, dtype=np.uint64)
    parts = [a[k : n - WINDOW + 1 + k] for k in range(WINDOW)]
    radix = np.uint64(v)
    key = parts[0]
    for k, part in enumerate(parts[1:], 1):
        if v ** (k + 1) >= 1 << 63:  # keep the key exact: renumber what is there first
            break
        key = key * radix + part
    else:
        k = WINDOW
    for part in parts[k:]:
        key = np.unique(key, return_inverse=True)[1].astype(np.uint64) * radix + part
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    inside = np.zeros(n, dtype=bool)
    for k in range(WINDOW):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def count_rules(text: bytes | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for a UTF-8 text."""
    if not text:
        return (0,) * len(COUNTS)
    words, seen, repeated_lines = text.split(), set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            repeated_lines += line in seen
            seen.add(line)
    less = lambda chars: len(text) - len(text.translate(None, chars))
    return len(words), len(text.translate(None, _SPACE_AND_TAILS)), less(_SYMBOLS), repeated_lines, repeated_words(words), less(_UPPER), less(_MARKS)


def features(counts: np.ndarray) -> np.ndarray:
    """What the forest sees, from rows of ``COUNTS``: ratios, so that a long and a short text of one kind are alike."""
    words, chars, symbols, _, repeat, upper, marks = counts.T.astype(np.float64)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    wide = lambda x: np.log1p(100 * x)  # noqa: E731  ratios that differ by orders of magnitude
    return np.column_stack([chars / w, wide(symbols / w), repeat / w, wide(upper / c), wide(marks / w)])


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in leaves), cut, left child (the right one follows it), and path length at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    depth: int
    psi: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[t][node]
                inner = f >= 0
                node = np.where(inner, self.left[t][node] + (x[row, f] >= self.cut[t][node]), node)
            total += self.path[t][node]
        return 2.0 ** (-total / len(self.feature) / max(float(_mean_path(self.psi)), 1e-9))


def grow(drawn: list[np.ndarray], margin: np.ndarray, seed: int = 7) -> Forest:
    """A forest with a tree for each set of ``drawn`` rows. A node is split somewhere in the box of its rows grown by ``margin``, so that what lies outside all rows is parted from them early."""
    rng = np.random.default_rng(seed)
    trees, psi = len(drawn), len(drawn[0])
    depth = max(1, int(np.ceil(np.log2(max(psi, 2)))))
    size = 2 ** (depth + 1) + 1
    feature, cuts, left, path = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size), dtype=np.int64), np.zeros((trees, size))
    varied = np.flatnonzero(margin > 0)
    for t in range(trees):
        todo, used = [(0, drawn[t], 0)], 1
        while todo:
            node, own, at = todo.pop()
            if at == depth or len(own) < 2 or not len(varied):
                path[t, node] = at + _mean_path(len(own))
                continue
            f = rng.choice(varied)
            c = rng.uniform(own[:, f].min() - margin[f], own[:, f].max() + margin[f])
            feature[t, node], cuts[t, node], left[t, node] = f, c, used
            right = own[:, f] >= c
            todo += [(used, own[~right], at + 1), (used + 1, own[right], at + 1)]
            used += 2
    return Forest(feature, cuts, left, path, depth, psi)


def _rows(counts: pa.Array) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in counts.flatten()[: len(COUNTS)]])


def _counted(forest: Forest | None) -> Callable:
    @arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ",score:double>")
    def rules(text: pa.Array) -> pa.Array:
        counts = np.array([count_rules(t) for t in text.cast(pa.binary()).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
        score = forest.score(features(counts)) if forest else np.zeros(len(counts))
        return pa.StructArray.from_arrays([pa.array(c) for c in counts.T.copy()] + [pa.array(score)], names=[*COUNTS, "score"])

    return rules


def _features() -> Callable:
    @arrow_udf("array<double>")
    def seen(counts: pa.Array) -> pa.Array:
        x = features(_rows(counts))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    return seen


def _score(forest: Forest) -> Callable:
    @arrow_udf("double")
    def score(counts: pa.Array) -> pa.Array:
        return pa.array(forest.score(features(_rows(counts))))

    return score


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def _running(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """``rows``, no two alike in ``by``, with ``upto_`` sums over all rows up to each in that order: sums within ranges, and of the ranges before."""
    dealt = keep(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    parts = sorted(dealt.groupBy("_part").agg(F.min(F.struct(*by)).alias("least"), *[F.sum(c).alias(c) for c in sums]).collect(), key=lambda r: tuple(r.least))
    before = {c: [0] * (1 + max((r._part for r in parts), default=0)) for c in sums}
    for c in sums:
        total = 0
        for r in parts:
            before[c][r._part] = total
            total += r[c]
    within = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.select(*by, *sums, *[(F.sum(c).over(within) + F.element_at(literal_longs(before[c]), F.col("_part") + 1)).alias(f"upto_{c}") for c in sums])


def _percentiles(seen: DataFrame, total: int, shares: Sequence[float]) -> np.ndarray:
    """Exact percentiles of each feature over all rows, a row of them for each share, between neighbours as NumPy has them."""
    values = seen.select(F.posexplode("x").alias("f", "v"), "n").groupBy("f", "v").agg(F.sum("n").alias("n"))
    width = len(seen.select("x").head().x)
    places = [(total - 1) * p for p in shares]
    wanted = sorted({f * total + k for f in range(width) for at in places for k in (math.floor(at), math.ceil(at))})
    met = F.exists(literal_longs(wanted), lambda k: (k >= F.col("upto_n") - F.col("n")) & (k < F.col("upto_n")))
    hits = _running(values, ["f", "v"], ["n"]).where(met).collect()
    value = lambda f, k: next(r.v for r in hits if r.upto_n - r.n <= f * total + k < r.upto_n)
    return np.array([[np.interp(at, [math.floor(at), math.floor(at) + 1], [value(f, math.floor(at)), value(f, math.ceil(at))]) for f in range(width)] for at in places])


def _draw(good: DataFrame, total: int, trees: int = TREES, psi: int = PSI) -> list[np.ndarray]:
    """For each tree the ``psi`` of all ``total`` good rows (all, if fewer) that hash lowest with its number. Hashes far above what so many rows need don't leave the executors."""
    share = (psi + 8 * math.sqrt(psi)) / total
    each = good.select("x", *COUNTS, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    each = each.select("x", "tree", *COUNTS, "copy", F.xxhash64("tree", "copy", *COUNTS).alias("h"))
    order = Window.partitionBy("tree").orderBy("h", "copy", *COUNTS)
    while True:
        low = each if share >= 1 else each.where(F.col("h") < int(share * 2**64) - 2**63)
        rows = low.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= psi).select("tree", "rank", "x").collect()
        if len(rows) == trees * min(psi, total):
            break
        share *= 4  # so few were low that a tree lacks rows
    own: list[list] = [[] for _ in range(trees)]
    for r in sorted(rows, key=lambda r: (r.tree, r["rank"])):
        own[r.tree].append(r.x)
    return [np.array(x) for x in own]


def calibrate(scores: DataFrame, fine: int, poor: int, false_rejects: float = FALSE_REJECTS) -> float:
    """The threshold that rejects most bad rows for its good ones, of those that reject at most that share of good rows.

    ``scores`` holds each score once, with how many good (``fine``) and bad (``poor``) rows have it. A threshold lies between a score and the next.
    """
    wrong, caught = F.lit(fine) - F.col("upto_fine"), F.lit(poor) - F.col("upto_poor")
    gain = (caught * fine - 4 * wrong * poor).alias("gain")  # times both totals, to keep it a whole number
    cuts = _running(scores, ["score"], ["fine", "poor"]).where(wrong <= false_rejects * fine).select("score", gain)
    top = cuts.groupBy("gain").agg(F.count("*").alias("n")).orderBy(F.desc("gain")).first()
    below = cuts.where(F.col("gain") == top.gain).orderBy("score").offset(top.n // 2).first().score
    above = scores.where(F.col("score") > below).agg(F.min("score")).first()[0]
    return below + 1e-9 if above is None else (below + above) / 2


def fit(counted: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """Forest and threshold from all labelled rows of ``counted`` (``id`` and ``rules``) that pass the base rule; None if they show one class at most."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") > 0).alias("good"))
    judged = counted.select("id", "rules").where(~base_failed(F.col("rules.n_words"), F.col("rules.n_repeat_words")))
    alike = judged.join(known, "id").groupBy("rules", "good").agg(F.count("*").alias("n"))  # to the forest rows of equal counts are one
    seen = keep(alike.select("rules", "rules.*", _features()("rules").alias("x"), "good", "n"))
    totals = {r.good: r.n for r in seen.groupBy("good").agg(F.sum("n").alias("n")).collect()}
    if len(totals) < 2:
        return None
    low, high = _percentiles(seen, sum(totals.values()), (0.01, 0.99))
    forest = grow(_draw(seen.where("good"), totals[True]), MARGIN * (high - low))
    n = lambda good: F.sum(F.when(F.col("good") == good, F.col("n")).otherwise(0))
    scores = keep(seen.groupBy(_score(forest)("rules").alias("score")).agg(n(True).alias("fine"), n(False).alias("poor")))
    return forest, calibrate(scores, totals[True], totals[False])


def assess(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``docs``, or these columns of it, with the counts, ``base_failed``, ``anomaly`` (the forest's score) and ``kept``."""
    ship(docs.sparkSession)
    out = [*COUNTS, "base_failed", "anomaly", "kept"]
    own = [c for c in (docs.columns if columns is None else columns) if c.lower() not in out]
    asked = docs.select(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in own]).alias("doc"), F.col("doc_id").alias("id"), "text")
    with_text = "text" in [c.lower() for c in own]
    counted = keep(asked.select(*([] if with_text else ["doc"]), "id", _counted(None)("text").alias("rules")))
    forest, threshold = fit(counted, labels) or (None, float("inf"))
    if with_text:
        s = asked.select("doc", _counted(forest)("text").alias("rules")).select("doc", "rules", F.col("rules.score").alias("anomaly"))
    else:
        s = counted.select("doc", "rules", (_score(forest)("rules") if forest else F.lit(0.0)).alias("anomaly"))
    s = s.select(*[F.col(f"doc.`{c}`") for c in own], *[F.col(f"rules.{c}").alias(c) for c in COUNTS], "anomaly")
    s = s.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return s.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(threshold)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "text")
    return assess(tagged, labels).where("kept").select("_doc.*")
