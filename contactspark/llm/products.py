"""Exact inner products of vectors of whole numbers, however large."""

from __future__ import annotations

import numpy as np

#: Sums of whole numbers below this are exact in a double, those below the other in a long.
EXACT, LONG = 2.0**52, 2.0**62
ENDS = (-(2**63), 2**63 - 1)


def whole(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * x) of all components, a vector to a row."""
    return np.floor(np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64).reshape(len(vectors), -1) * scale)


def _limbs(x: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """Digits of ``bits`` bits with their places, such that the digits times 2 ** place add up to x."""
    out, rest = [], x
    for place in range(int(np.frexp(np.abs(x).max(initial=0))[1]) // bits * bits, -1, -bits):
        digit = np.trunc(np.ldexp(rest, -place))
        rest = rest - np.ldexp(digit, place)
        if digit.any():
            out.append((place, digit))
    return out


def _by_limbs(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """Products of digits that doubles hold exactly, added up as longs where all sums are ``small``, else as Python's integers that are held within a long."""
    bits = (52 - int(np.ceil(np.log2(max(2, a.shape[1]))))) // 2
    total = np.zeros((len(a), len(b)), dtype=np.int64 if small else object)
    for i, x in _limbs(a, bits):
        for j, y in _limbs(b, bits):
            part = (x @ y.T).astype(np.int64)
            total += part << (i + j) if small else part.astype(object) * (1 << (i + j))
    return total if small else np.clip(total, *ENDS).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of ``a`` with each of ``b``, as longs; beyond these, a long's end.

    Pairs whose sums a double holds are one product of matrices; for the others, in the
    rows and columns that have any, numbers are cut into digits.
    """
    with np.errstate(over="ignore"):
        bound = np.abs(a).sum(axis=1)[:, None] * np.abs(b).max(axis=1, initial=0)[None, :]
    large = bound >= EXACT
    if not large.any():
        return (a @ b.T).astype(np.int64)
    rows, columns = large.any(axis=1), large.any(axis=0)
    out = np.zeros(large.shape, dtype=np.int64)
    for some, others in ((~rows, slice(None)), (rows, ~columns)):
        out[np.ix_(some, np.arange(len(b))[others])] = (a[some] @ b[others].T).astype(np.int64)
    out[np.ix_(rows, columns)] = _by_limbs(a[rows], b[columns], bool(bound[np.ix_(rows, columns)].max() < LONG))
    return out
