"""Leading eigenpairs of a symmetric matrix of fixed size, in numpy.

The matrix is reduced to tridiagonal form by Householder reflections; leading
eigenvalues are found by bisection on Sturm counts, their vectors by inverse
iteration with reorthogonalisation within clusters of close values.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues closer than this share of the matrix' norm are one cluster.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal Q with Q' A Q tridiagonal."""
    a = np.array(matrix, dtype=float)
    size = len(a)
    q = np.eye(size)
    for k in range(size - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if norm == 0.0 or not np.any(x[1:]):
            continue
        v = x / norm
        v[0] += np.copysign(1.0, v[0])
        v /= np.linalg.norm(v)
        # A <- H A H on the trailing block, H = I - 2 v v'
        block = a[k + 1 :, k + 1 :]
        w = block @ v
        w -= (v @ w) * v
        block -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, x[0])
        a[k + 2 :, k] = a[k, k + 2 :] = 0.0
        q[:, k + 1 :] -= 2.0 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def count_above(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues lie above each value of ``at``."""
    least = np.finfo(float).tiny ** 0.5
    squares = np.concatenate([[0.0], off * off])
    pivot = np.ones_like(at)
    above = np.zeros(len(at), dtype=int)
    for d, square in zip(diagonal, squares, strict=True):
        pivot = d - at - square / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        above += pivot > 0
    return above


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues of a tridiagonal matrix, falling, by bisection."""
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low = np.full(count, (diagonal - reach).min())
    high = np.full(count, (diagonal + reach).max())
    slack = 4 * EPS * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - slack, high + slack
    wanted = np.arange(1, count + 1)
    while True:
        middle = 0.5 * (low + high)
        open_ = (high - low > slack) & (middle > low) & (middle < high)
        if not open_.any():
            return middle
        enough = count_above(diagonal, off, middle) >= wanted
        low, high = np.where(open_ & enough, middle, low), np.where(open_ & ~enough, middle, high)


def _factor(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """LU factors of T - shift I with row exchanges: rows of U (three bands), multipliers, exchanges."""
    size = len(diagonal)
    upper = np.zeros((size, 3))
    factors, swapped = np.zeros(size), np.zeros(size, dtype=bool)
    row = [diagonal[0] - shift, off[0] if size > 1 else 0.0, 0.0]
    for i in range(size - 1):
        below = [off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < size else 0.0]
        if abs(below[0]) > abs(row[0]):
            row, below, swapped[i] = below, row, True
        if abs(row[0]) < least:
            row[0] = least
        factors[i] = below[0] / row[0]
        upper[i] = row
        row = [below[1] - factors[i] * row[1], below[2] - factors[i] * row[2], 0.0]
    if abs(row[0]) < least:
        row[0] = least
    upper[-1] = row
    return upper, factors, swapped


def _solve(parts, b: np.ndarray) -> np.ndarray:
    upper, factors, swapped = parts
    size = len(b)
    y = b.copy()
    for i in range(size - 1):
        if swapped[i]:
            y[i], y[i + 1] = y[i + 1], y[i]
        y[i + 1] -= factors[i] * y[i]
    x = np.zeros(size + 2)
    for i in range(size - 1, -1, -1):
        x[i] = (y[i] - upper[i, 1] * x[i + 1] - upper[i, 2] * x[i + 2]) / upper[i, 0]
        if abs(x[i]) > 1e200:  # only the direction counts
            x /= 1e200
            y /= 1e200
    return x[:size]


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of a tridiagonal matrix for falling ``values``."""
    size = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    draw = np.random.default_rng(1)
    found = np.zeros((len(values), size))
    first, last_shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # equal values get slightly different shifts, as equal ones would solve for one vector
        shift = min(value, last_shift - 10 * EPS * norm) if j > first else value
        last_shift = shift
        parts = _factor(diagonal, off, shift, EPS * norm)
        x = draw.standard_normal(size)
        for _ in range(5):
            x = _solve(parts, x / np.linalg.norm(x))
            x /= np.linalg.norm(x)
            for _ in range(2):
                x -= found[first:j].T @ (found[first:j] @ x)
            x /= np.linalg.norm(x)
        found[j] = x
    return found


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as rows."""
    size = len(matrix)
    count = min(count, size)
    scale = np.abs(matrix).max(initial=0.0)
    if count == 0 or scale == 0.0:
        return np.zeros(count), np.eye(size)[:count]
    diagonal, off, q = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, count)
    vectors = vectors_of(diagonal, off, values) @ q.T
    # the vectors' own quotients are the values to second order
    values = np.einsum("ij,jk,ik->i", vectors, matrix / scale, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, vectors[order]
