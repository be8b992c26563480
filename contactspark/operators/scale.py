"""Balancing a symmetric matrix (SCALE).

An *attempt* iterates on one set of rows until their sums are 1 (balanced), until
the vector stands still though some sums are off (uneven), or until it no longer
gets better fast enough (stalled). A *search* decides which rows to try: at first
all that hold anything, and then those with at least ``low`` cells, where ``low``
rises after failures (up to a bound that the rows' counts give) and is bisected
back after a success. Before ``low`` rises, the few rows that stand out may be
masked, once.

All that a search needs of a matrix are products with it, which it asks for by
yielding vectors. So it is the same for a matrix that lies in a task's memory and for
one that is spread over executors, and many of the latter go on together: a round takes a
vector from each search that isn't done, and one Spark job gives all their products.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE, ROW_TOLERANCE, BETTER = 1e-4, 0.05, 0.05
CUTOFF_ITERATIONS, TOTAL_ITERATIONS = 1000, 2000
#: An attempt may stall after so many iterations, and is compared with as many before.
PATIENCE = 5
#: Rows whose contacts near the diagonal are below this share of their upper median are masked, where a width is given.
LEAST_NEAR = 0.01
#: Slow rows are masked where they are less than this share, and counts' percentile that bounds ``low``.
FEW_SLOW, PERCENTILE = 1e-4, 0.2

Multiply = Callable[[np.ndarray], np.ndarray]
#: What asks for products by yielding vectors, and what it returns in the end.
type Asking[T] = Generator[np.ndarray, np.ndarray, T]
#: A matrix: chromosome and bin size.
Key = tuple[int, int]


def local_multiply(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> Multiply:
    """Products with a symmetric matrix of which the upper triangle is given."""
    off = row != col

    def multiply(v: np.ndarray) -> np.ndarray:
        out = np.bincount(row, weights=value * v[col], minlength=n)
        return out + np.bincount(col[off], weights=(value * v[row])[off], minlength=n)

    return multiply


def answered[T](asking: Asking[T], multiply: Multiply) -> T:
    """What ``asking`` returns, its products given by ``multiply``."""
    try:
        wanted = next(asking)
        while True:
            wanted = asking.send(multiply(wanted))
    except StopIteration as done:
        return done.value


def answered_together[T](asking: dict[Key, Asking[T]], multiply: Callable[[dict[Key, np.ndarray]], dict[Key, np.ndarray]]) -> dict[Key, T]:
    """``answered`` for many, round by round: ``multiply`` gets the vectors of all that aren't done."""
    out: dict[Key, T] = {}
    products: dict[Key, np.ndarray | None] = dict.fromkeys(asking)
    while products:
        wanted = {}
        for key, product in products.items():
            try:
                wanted[key] = asking[key].send(product)
            except StopIteration as done:
                out[key] = done.value
        products = multiply(wanted) if wanted else {}
    return out


def distributed_multiply(cells: DataFrame, sizes: dict[Key, int]) -> tuple[Callable[[dict[Key, np.ndarray]], dict[Key, np.ndarray]], Callable[[], None]]:
    """Products with many matrices whose cells (chr, bin_size, bin1, bin2, count) are spread over executors, and what frees them.

    Chunks of one matrix each stay cached; the vectors (one number for each bin) are
    broadcast, a task adds up what its chunks give for each matrix, and these sums meet
    in a tree. Chunks of matrices that no vector is for are passed over.
    """
    sc = cells.sparkSession.sparkContext

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chr_, size, *rest = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            edges = np.flatnonzero(np.concatenate([[True], (chr_[1:] != chr_[:-1]) | (size[1:] != size[:-1])])) if len(chr_) else []
            for first, last in zip(edges, [*edges[1:], len(chr_)], strict=False):
                raw = [x[first:last].astype(t).tobytes() for x, t in zip(rest, ("<i4", "<i4", "<f8"), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([int(chr_[first])], type=pa.int32()), pa.array([int(size[first])], type=pa.int32()), *(pa.array([x], type=pa.binary()) for x in raw)], names=["chr", "size", "row", "col", "value"])

    def chunk(rows: Iterator) -> Iterator:
        held: dict[Key, list] = {}
        for r in rows:
            held.setdefault((r[0], r[1]), []).append((np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<i4"), np.frombuffer(r[4], "<f8")))
        for key, parts in held.items():
            yield key, tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def add(one: dict[Key, np.ndarray], two: dict[Key, np.ndarray]) -> dict[Key, np.ndarray]:
        for key, v in two.items():
            one[key] = one[key] + v if key in one else v
        return one

    own = cells.select(F.col("chr").cast("int"), F.col("bin_size").cast("int"), F.col("bin1").cast("int"), F.col("bin2").cast("int"), F.col("count").cast("double"))
    chunks = own.mapInArrow(pack, "chr int, size int, row binary, col binary, value binary").rdd.mapPartitions(chunk).persist(StorageLevel.MEMORY_AND_DISK)

    def multiply(wanted: dict[Key, np.ndarray]) -> dict[Key, np.ndarray]:
        sent = sc.broadcast(wanted)

        def products(part: Iterator) -> Iterator:
            done: dict[Key, np.ndarray] = {}
            for key, c in part:
                if key in sent.value:
                    add(done, {key: local_multiply(*c, sizes[key])(sent.value[key])})
            yield done

        out = chunks.mapPartitions(products).treeAggregate({}, add, add, 2)
        sent.destroy()
        return {key: out.get(key, np.zeros(sizes[key])) for key in wanted}

    return multiply, chunks.unpersist


def nonzero_bound(nonzeros: np.ndarray) -> int:
    """How far ``low`` may rise: the count a fifth of the way up, or a standard deviation below the mean, whichever is more."""
    counts = np.sort(nonzeros[nonzeros > 0])
    return max(int(counts[int(len(counts) * PERCENTILE)]), 1, int(np.ceil(counts.mean() - counts.std())))


@dataclass
class Attempt:
    """How an attempt ended: ``balanced``, ``uneven``, ``stalled`` or ``spent``; with the rows that stand out."""

    end: str
    factors: np.ndarray
    offenders: np.ndarray
    iterations: int


def attempt(keep: np.ndarray, start: np.ndarray, sums: np.ndarray, previous: np.ndarray, tol: float, budget: int) -> Asking[Attempt]:
    """Turns of fixing rows and columns on the rows in ``keep``, from factors ``start`` whose rows have these sums; the first change is from ``previous``."""
    left, right, now = start, start.copy(), previous
    errors: list[float] = []

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=keep & (b != 0))

    while len(errors) < min(CUTOFF_ITERATIONS, budget):
        left = over(left, sums)
        right = over(right, (yield left) * right)
        sums = (yield right) * left
        last, now = now, np.sqrt(left * right)
        change = np.where(keep, np.abs(now - last) / (now + last + 1e-300), 0.0)
        errors.append(float(change.max(initial=0.0)))
        if errors[-1] < tol:
            off = np.where(keep, np.abs((yield now) * now - 1.0), 0.0)
            end = "balanced" if off.max(initial=0.0) <= ROW_TOLERANCE else "uneven"
            return Attempt(end, now, off > ROW_TOLERANCE, len(errors))
        if len(errors) > PATIENCE and not errors[-1] * (1 + BETTER) < errors[-1 - PATIENCE]:
            return Attempt("stalled", now, change > tol, len(errors))
    return Attempt("spent", now, np.zeros_like(keep), len(errors))


def near_enough(near: np.ndarray) -> np.ndarray:
    """Rows whose sums near the diagonal reach a hundredth (whole numbers) of the upper median of those above 0."""
    held = np.sort(near[near > 0])
    return near >= int(held[len(held) // 2] * LEAST_NEAR) if len(held) else np.ones(len(near), dtype=bool)


def search(multiply: Multiply, nonzeros: np.ndarray, tol: float = TOLERANCE, total_iterations: int = TOTAL_ITERATIONS, allowed: np.ndarray | None = None) -> np.ndarray | None:
    """``searched``, for a matrix that is multiplied with by ``multiply``."""
    return answered(searched(nonzeros, tol, total_iterations, allowed), multiply)


def searched(nonzeros: np.ndarray, tol: float = TOLERANCE, total_iterations: int = TOTAL_ITERATIONS, allowed: np.ndarray | None = None) -> Asking[np.ndarray | None]:
    """Factors b that make all sums of b A b 1, NaN on masked rows; None where no attempt was accepted. Rows outside ``allowed`` start out masked."""
    held = int((nonzeros > 0).sum())
    if not held:
        return None
    bound, low, failed_at = nonzero_bound(nonzeros), 1, None
    best: tuple[np.ndarray, np.ndarray, int] | None = None  # factors, rows, low of the last balanced attempt
    holding = lambda low: (nonzeros >= low) & (True if allowed is None else allowed)
    keep = holding(low)
    may_rescue = may_drop_slow = True
    spent = 0
    sums = yield keep.astype(np.float64)
    start = np.where(keep, np.sqrt(sums), 0.0)
    sums, previous = sums * start, start
    while spent < total_iterations:
        got = yield from attempt(keep, start, sums, previous, tol, total_iterations - spent)
        spent, previous = spent + got.iterations, got.factors
        if got.end == "spent":
            return None
        if got.end == "balanced":
            best, may_drop_slow = (got.factors, keep, low), True
            if low <= 1 or (failed_at is not None and low - failed_at <= 1):
                break
            low = (low + (failed_at or 0)) // 2
            keep, may_rescue = holding(low), True
        elif got.end == "uneven" and may_rescue and got.offenders.any():
            keep, may_rescue = keep & ~got.offenders, False
        else:
            failed_at = low
            few = got.end == "stalled" and got.offenders.sum() / held < FEW_SLOW and may_drop_slow
            if best and best[2] - failed_at <= 1:
                break
            if few:
                keep, may_drop_slow = keep & ~got.offenders, False
            else:
                higher = (failed_at + best[2]) // 2 if best else min(2 * low, bound)
                if not best and higher <= low:
                    return None
                low, may_drop_slow = higher, True
                keep, may_rescue = holding(low), True
            if low > bound:
                return None
        start = keep.astype(np.float64)
        sums = (yield start) * start
    else:
        return None
    factors, rows, _ = best
    return np.where(rows, factors, np.nan)


def as_divisor(factors: np.ndarray) -> Asking[np.ndarray]:
    """The vector that cells are divided by, such that the sum over its bins stays; NaN where there is none."""
    good = ~np.isnan(factors) & (factors != 0)
    one, b = good.astype(np.float64), np.where(good, factors, 0.0)
    before, after = float((yield one) @ one), float((yield b) @ b)
    out = np.where(good, factors, np.nan)
    return out if before == 0 or after == 0 else np.sqrt(after / before) / out


def balanced(nonzeros: np.ndarray, near: np.ndarray | None, tol: float, total_iterations: int) -> Asking[np.ndarray | None]:
    """The SCALE vector, before its sum factor; None where the matrix can't be balanced. ``near``: sums near the diagonal, by which rows are masked."""
    found = yield from searched(nonzeros, tol, total_iterations, None if near is None else near_enough(near))
    if found is None:
        return None
    vector = yield from as_divisor(found)
    return vector if (np.isfinite(vector) & (vector > 0)).any() else None


def balance(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, tol: float = TOLERANCE, total_iterations: int = TOTAL_ITERATIONS, diagonal_width: int = -1) -> np.ndarray | None:
    """The SCALE vector of a matrix in memory (upper triangle), before its sum factor; None where it can't be balanced. ``diagonal_width`` above 0 masks rows with few contacts within so many bins."""
    nonzeros = np.bincount(row, minlength=n) + np.bincount(col[row != col], minlength=n)
    near = None
    if diagonal_width > 0:
        close = np.abs(row.astype(np.int64) - col) <= diagonal_width
        near = local_multiply(row[close], col[close], value[close], n)(np.ones(n))
    return answered(balanced(nonzeros, near, tol, total_iterations), local_multiply(row, col, value, n))


def balance_many(cells: DataFrame, sizes: dict[Key, int], tol: float = TOLERANCE, total_iterations: int = TOTAL_ITERATIONS, diagonal_width: int = -1) -> dict[Key, np.ndarray | None]:
    """``balance`` for the matrices (bins by chromosome and bin size) whose cells (chr, bin_size, bin1, bin2, count) no task should hold alone. As many jobs as the longest search has products, however many matrices there are."""
    multiply, done = distributed_multiply(cells, sizes)
    try:
        ends = F.when(F.col("bin1") == F.col("bin2"), F.array("bin1")).otherwise(F.array("bin1", "bin2"))
        nonzeros, near = ({key: np.zeros(n, dtype=t) for key, n in sizes.items()} for t in (np.int64, np.float64))
        close = F.when(F.abs(F.col("bin1") - F.col("bin2")) <= diagonal_width, F.col("count")).otherwise(0.0)
        sums = cells.select("chr", "bin_size", F.explode(ends).alias("bin"), close.alias("near")).groupBy("chr", "bin_size", "bin").agg(F.count("*").alias("n"), F.sum("near").alias("near"))
        for r in sums.toLocalIterator():  # a row for each bin, as in the vectors
            nonzeros[r.chr, r.bin_size][r.bin], near[r.chr, r.bin_size][r.bin] = r.n, r.near
        asking = {key: balanced(nonzeros[key], near[key] if diagonal_width > 0 else None, tol, total_iterations) for key in sizes}
        return answered_together(asking, multiply)
    finally:
        done()


def balance_distributed(cells: DataFrame, n: int, tol: float = TOLERANCE, total_iterations: int = TOTAL_ITERATIONS, diagonal_width: int = -1) -> np.ndarray | None:
    """``balance_many`` for the cells (bin1, bin2, count) of one matrix."""
    return balance_many(cells.withColumns({"chr": F.lit(1), "bin_size": F.lit(1)}), {(1, 1): n}, tol, total_iterations, diagonal_width)[1, 1]
