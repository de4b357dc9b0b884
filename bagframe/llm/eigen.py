"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, Sturm-count bisection, inverse iteration.

The matrix has one row per dimension of a vector, so it is small however many vectors there are. All steps work on the wanted
eigenvalues at once.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of Q' a Q; reflector k is the unit vector (or none) of step k, zero up to k."""
    a, n, reflectors = np.array(a, float), len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        scale = np.abs(x[1:]).max()
        if scale == 0:
            reflectors.append(None)
            continue
        x /= max(scale, abs(x[0]))                   # no squares of tiny or huge numbers
        x[0] += np.copysign(np.sqrt(x @ x), x[0])
        v = x / np.sqrt(x @ x)
        p = a[k + 1:, k + 1:] @ v
        p -= (v @ p) * v
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1:, k] -= 2 * (v @ a[k + 1:, k]) * v
        a[k, k + 1:] = a[k + 1:, k]
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are smaller than each x: negative pivots of its LDL' factors."""
    floor = max(_TINY, _EPS * _EPS * float(np.abs(np.concatenate([d, e])).max(initial=0)))
    count = np.zeros(len(x), np.int64)
    q = d[0] - x
    for i in range(len(d)):
        if i:
            q = d[i] - x - e[i - 1] ** 2 / q
        q = np.where(np.abs(q) < floor, -floor, q)
        count += q < 0
    return count


def largest(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each between two doubles that bisection cannot part."""
    n = len(d)
    reach = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    pad = 4 * _EPS * n * float(np.abs(d).max() + reach.max()) + _TINY
    low, high = np.full(k, (d - reach).min() - pad), np.full(k, (d + reach).max() + pad)
    order = n - 1 - np.arange(k)                     # the eigenvalue with this many below it
    while True:
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            return mid
        right = below(d, e, mid) <= order
        low, high = np.where(right, mid, low), np.where(right, high, mid)


def _solve(d: np.ndarray, e: np.ndarray, shift: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
    """Columns z of (T - shift) z = b, by elimination with row exchanges, for all shifts at once."""
    n, k = b.shape
    b, u0, u1, u2 = b.copy(), np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    p0, p1 = d[0] - shift, np.full(k, e[0] if n > 1 else 0.0)
    for i in range(n - 1):
        r0, r1, r2 = np.full(k, e[i]), d[i + 1] - shift, np.full(k, e[i + 1] if i + 2 < n else 0.0)
        swap = np.abs(r0) > np.abs(p0)
        u0[i], u1[i], u2[i] = np.where(swap, r0, p0), np.where(swap, r1, p1), np.where(swap, r2, 0.0)
        u0[i] = np.where(np.abs(u0[i]) < floor, np.copysign(floor, u0[i]), u0[i])
        f = np.where(swap, p0, r0) / u0[i]
        top = np.where(swap, b[i + 1], b[i])
        b[i + 1] = np.where(swap, b[i], b[i + 1]) - f * top
        b[i] = top
        p0, p1 = np.where(swap, p1, r1) - f * u1[i], np.where(swap, 0.0, r2) - f * u2[i]
    u0[n - 1] = np.where(np.abs(p0) < floor, np.copysign(floor, p0), p0)
    z = np.zeros((n, k))
    for i in range(n - 1, -1, -1):
        z[i] = b[i]
        if i + 1 < n:
            z[i] -= u1[i] * z[i + 1]
        if i + 2 < n:
            z[i] -= u2[i] * z[i + 2]
        z[i] /= u0[i]
        grown = np.abs(z[i]) > 1e100                 # only directions matter
        if grown.any():
            by = np.where(grown, np.abs(z[i]), 1.0)
            z, b = z / by, b / by
    return z


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors (columns) for falling eigenvalues. Those of a cluster, neighbours closer than a thousandth of the matrix's
    norm, are made orthogonal to each other after every solve."""
    n, k = len(d), len(values)
    norm = max(float((np.abs(d) + np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))).max()), _TINY)
    shift = values.copy()
    for j in range(1, k):                            # equal eigenvalues get shifts of their own
        shift[j] = min(shift[j], shift[j - 1] - 4 * _EPS * norm)
    start = np.concatenate([[True], values[:-1] - values[1:] > 1e-3 * norm])
    first = np.maximum.accumulate(np.where(start, np.arange(k), 0))
    golden = (np.arange(1, n + 1)[:, None] * 0.6180339887498949 + np.arange(1, k + 1) * 0.7548776662466927) % 1
    z = golden - 0.5 + 0.05 * np.sign(golden - 0.5)
    for _ in range(rounds):
        z = z / np.abs(z).max(axis=0)
        z = _solve(d, e, shift, z, _EPS * norm)
        z = z / np.abs(z).max(axis=0)
        for j in range(k):
            for _ in range(2):                       # the second pass takes what rounding left
                mates = z[:, first[j]: j]
                z[:, j] -= mates @ (mates.T @ z[:, j])
            z[:, j] /= np.sqrt(z[:, j] @ z[:, j])
    return z


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k largest eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix."""
    n = len(a)
    k = min(k, n)
    if k == 0:
        return np.zeros(0), np.zeros((n, 0))
    d, e, reflectors = tridiagonal(a)
    values = largest(d, e, k)
    z = inverse_iteration(d, e, values)
    for j in range(len(reflectors) - 1, -1, -1):
        v = reflectors[j]
        if v is not None:
            z[j + 1:] -= 2 * np.outer(v, v @ z[j + 1:])
    return values, z
