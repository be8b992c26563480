"""Word shingles of a text as hashed, weighted sets, and darts thrown at them; all in NumPy."""

from __future__ import annotations

import numpy as np

#: Words in a shingle.
WORDS = 5

_U = np.uint64
_BASE, _BASE_INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = np.array([mixed | 1 for mixed in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)], dtype=np.uint64)
#: How often a unit of area holds at most 0, 1, 2 ... darts (Poisson with mean 1).
_AT_MOST = np.cumsum(np.exp(-1) / np.concatenate([[1], np.cumprod(np.arange(1, 13))]))


def scramble(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits (the finaliser of SplitMix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 14)
        full = np.full(n, _BASE)
        full[0] = 1
        _powers = np.cumprod(full)
        full = np.full(n, _BASE_INVERSE)
        full[0] = 1
        _inverses = np.cumprod(full)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of a UTF-8 text: differences of a running polynomial over its bytes."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    _grow(len(raw) + 1)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + _U(1)) * _powers[: len(raw)])])
    return scramble((total[end] - total[start]) * _inverses[start] + (end - start).astype(np.uint64))


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct five-word shingles (hashed, in order) and how often each occurs. A shorter text with words is one shingle."""
    words = word_hashes(text)
    n = len(words) - WORDS + 1
    if not len(words):
        return words, np.empty(0, dtype=np.int64)
    if n < 1:
        return scramble((words * _PLACE[: len(words)]).sum(keepdims=True) + _U(len(words))), np.ones(1, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        total += words[k : k + n] * _PLACE[k]
    return np.unique(scramble(total), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard coefficient: the sum of the smaller weights over that of the larger ones."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash signature of a weighted set: k hashes, equal in a coordinate with the probability of the weighted Jaccard coefficient.

    Darts fall on the plane of weight and rank of each element, about one on a unit of
    area, at places that only the element's hash decides. Those within the element's
    weight and below a rank that lets about t = k ln k + 2k through are thrown; each
    hits one of k coordinates, and the dart of least rank there is kept. Is a
    coordinate missed, more ranks are thrown.
    """
    total = float(weights.sum())
    rank_limit = (k * np.log(k) + 2 * k) / total
    cells = np.ceil(weights).astype(np.int64)
    element = np.repeat(elements, cells)
    height = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    room = np.repeat(weights, cells) - height  # of the cell that lies within the weight
    column = scramble(element ^ scramble(height.astype(np.uint64) + _U(1)))
    while True:
        rows = int(np.ceil(rank_limit))
        cell = column if rows == 1 else np.repeat(column, rows)
        rank = np.zeros(len(cell)) if rows == 1 else np.tile(np.arange(rows, dtype=np.float64), len(column))
        cell = scramble(cell + rank.astype(np.uint64) * _U(0xD1342543DE82EF95))
        n = np.searchsorted(_AT_MOST, unit(cell), side="right")
        dart = np.repeat(cell, n)
        turn = np.arange(len(dart)) - np.repeat(np.cumsum(n) - n, n)
        dart = scramble(dart + (turn.astype(np.uint64) + _U(1)) * _U(0xA0761D6478BD642F))
        at = np.repeat(rank, n) + unit(dart)
        own = (at < rank_limit) & (unit(scramble(dart ^ _U(0xE7037ED1A0B428DB))) < np.repeat(room if rows == 1 else np.repeat(room, rows), n))
        dart, at = dart[own], at[own]
        late = np.argsort(-at, kind="stable")
        signature = np.zeros(k, dtype=np.uint64)
        hit = np.zeros(k, dtype=bool)
        place = (scramble(dart ^ _U(0x8EBC6AF09C88C6E3)) % _U(k)).astype(np.int64)[late]
        signature[place] = dart[late]  # the last that is written to a coordinate is its earliest dart
        hit[place] = True
        if hit.all():
            return signature
        rank_limit *= 2


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band of a signature, as signed longs; bands never share keys."""
    rows = len(signature) // bands
    parts = signature.reshape(bands, rows) * scramble(np.arange(rows, dtype=np.uint64))
    return scramble(parts.sum(axis=1) + scramble(np.arange(bands, dtype=np.uint64) + _U(77))).view(np.int64)
