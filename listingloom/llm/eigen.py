"""Leading eigenvalues and eigenvectors of a symmetric matrix: Householder, Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
#: Eigenvalues nearer than this share of the norm are one cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and the reflectors (first row, unit vector) that take a to that form."""
    a = np.array(a, np.float64)
    reflectors = []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        tail = np.linalg.norm(x[1:])
        if tail == 0.0:
            continue
        x[0] += np.copysign(np.hypot(x[0], tail), x[0])
        v = x / np.linalg.norm(x)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2.0 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        reflectors.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each value: the negative pivots of the shifted matrix (Sturm count)."""
    least = _EPS * max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = d - at - e * e / np.where(np.abs(pivot) < least, np.where(pivot < 0, -least, least), pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    span = max(float((diagonal + reach).max()), -float((diagonal - reach).min()), 1e-300)
    low, high = np.full(k, -span * (1 + 4 * _EPS)), np.full(k, span * (1 + 4 * _EPS))
    wanted = n - np.arange(k)  # fewer than this many eigenvalues lie below the one looked for
    for _ in range(128):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        under = below(diagonal, off, middle) >= wanted
        high, low = np.where(under, middle, high), np.where(under, low, middle)
    return low + (high - low) / 2


def _factors(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float) -> list[tuple]:
    """LU of the shifted tridiagonal matrix with row exchanges: (exchanged, multiplier, pivot, right, second right)."""
    n = len(diagonal)
    rows, d, e, f = [], diagonal[0] - shift, off[0] if n > 1 else 0.0, 0.0
    for i in range(n - 1):
        under, next_d, next_e = off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0
        if abs(under) > abs(d):
            m = d / under
            rows.append((True, m, under, next_d, next_e))
            d, e = e - m * next_d, f - m * next_e
        else:
            d = d if abs(d) >= least else (least if d >= 0 else -least)
            m = under / d
            rows.append((False, m, d, e, f))
            d, e = next_d - m * e, next_e - m * f
        f = 0.0
    rows.append((False, 0.0, d if abs(d) >= least else (least if d >= 0 else -least), 0.0, 0.0))
    return rows


def _solve(rows: list[tuple], b: np.ndarray) -> np.ndarray:
    x, n = b.copy(), len(rows)
    for i, (exchanged, m, *_) in enumerate(rows[:-1]):
        if exchanged:
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= m * x[i]
    for i in range(n - 1, -1, -1):
        _, _, pivot, right, second = rows[i]
        x[i] = (x[i] - right * (x[i + 1] if i + 1 < n else 0.0) - second * (x[i + 2] if i + 2 < n else 0.0)) / pivot
        if abs(x[i]) > 1e150:
            x /= abs(x[i])
    return x


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector of the tridiagonal matrix per value (columns), by inverse iteration, falling values.

    Those of one cluster are made orthogonal to each other at every step, so equal values get different vectors.
    """
    n, norm = len(diagonal), max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    random, out, first = np.random.default_rng(7), np.zeros((n, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        rows = _factors(diagonal, off, value - (j - first) * 2 * _EPS * norm, _EPS * norm)
        cluster = out[:, first:j]
        x = random.standard_normal(n)
        for _ in range(5):
            x = _solve(rows, x / np.linalg.norm(x))
            for _ in range(2):
                x -= cluster @ (cluster.T @ x)
            size = np.linalg.norm(x)
            if size == 0.0 or not np.isfinite(size):
                x = random.standard_normal(n)
        x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns."""
    a = np.asarray(a, np.float64)
    k = min(k, len(a))
    scale = np.abs(a).max(initial=0.0)
    if scale == 0.0:
        return np.zeros(k), np.eye(len(a), k)
    diagonal, off, reflectors = tridiagonal(a / scale)
    values = leading_values(diagonal, off, k)
    out = vectors(diagonal, off, values)
    for start, v in reversed(reflectors):
        out[start:] -= 2.0 * np.outer(v, v @ out[start:])
    return values * scale, out
