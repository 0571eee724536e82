"""Leading eigenpairs of a symmetric matrix: Householder, Sturm counts, inverse iteration.

The matrix has as many rows as a vector has dimensions, whatever the number of
vectors.
"""

from __future__ import annotations

import numpy as np

CLUSTER = 1e-3  # eigenvalues closer than this share of the norm are one cluster
STEPS = 4  # of inverse iteration
EPS = float(np.finfo(float).eps)


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """``(diagonal, off, reflectors)`` of the tridiagonal matrix similar to ``v``."""
    a = np.array(v, float)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        rest = np.abs(x[1:]).max(initial=0.0)
        if rest == 0.0:
            reflectors.append((x, 0.0))
            continue
        scale = max(rest, abs(x[0]))
        x /= scale
        norm = float(np.sqrt(x @ x))
        alpha = -norm if x[0] >= 0 else norm
        x[0] -= alpha
        beta = 2.0 / float(x @ x)
        p = beta * (a[k + 1 :, k + 1 :] @ x)
        w = p - (beta / 2 * float(p @ x)) * x
        a[k + 1 :, k + 1 :] -= np.outer(x, w) + np.outer(w, x)
        a[k + 1, k] = a[k, k + 1] = alpha * scale
        reflectors.append((x, beta))
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def back(reflectors: list[tuple[np.ndarray, float]], z: np.ndarray) -> np.ndarray:
    """Columns of ``z`` from the tridiagonal matrix's space into the first one's."""
    z = z.copy()
    for k in reversed(range(len(reflectors))):
        x, beta = reflectors[k]
        if beta:
            z[k + 1 :] -= np.outer(x, beta * (x @ z[k + 1 :]))
    return z


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each value of ``at``."""
    tiny = EPS * max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), 1e-300)
    count = np.zeros(len(at), np.int64)
    q = np.ones(len(at))
    for i in range(len(diagonal)):
        q = diagonal[i] - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection."""
    n = len(diagonal)
    radius = np.zeros(n)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    low, high = float((diagonal - radius).min()), float((diagonal + radius).max())
    slack = 4 * EPS * max(abs(low), abs(high), 1e-300)
    lo, hi = np.full(k, low - slack), np.full(k, high + slack)
    rank = n - 1 - np.arange(k)  # number of smaller eigenvalues
    for _ in range(2000):
        mid = lo + (hi - lo) / 2
        if not ((mid > lo) & (mid < hi)).any():
            break
        below = sturm_counts(diagonal, off, mid) <= rank
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return lo


def solver(diagonal: np.ndarray, off: np.ndarray, shift: float):
    """Solves (T - shift) x = b by elimination with row exchanges; a zero pivot becomes a tiny one."""
    n = len(diagonal)
    tiny = EPS * max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), 1e-300)
    d = (diagonal - shift).tolist()
    u1, u2, low, swap = off.tolist() + [0.0], [0.0] * n, [0.0] * n, [False] * n
    sub = off.tolist()
    for i in range(n - 1):
        if abs(d[i]) >= abs(sub[i]):
            pivot = d[i] if d[i] else tiny
            d[i] = pivot
            low[i] = sub[i] / pivot
            d[i + 1] -= low[i] * u1[i]
        else:
            swap[i] = True
            low[i] = d[i] / sub[i]
            d[i], old_next = sub[i], d[i + 1]
            d[i + 1] = u1[i] - low[i] * old_next
            u1[i], u2[i] = old_next, u1[i + 1]
            u1[i + 1] = -low[i] * u2[i]
    d = [x if abs(x) > tiny else (tiny if x >= 0 else -tiny) for x in d]

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i in range(n - 1):
            if swap[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= low[i] * x[i]
        for i in reversed(range(n)):
            x[i] -= (u1[i] * x[i + 1] if i + 1 < n else 0.0) + (u2[i] * x[i + 2] if i + 2 < n else 0.0)
            x[i] /= d[i]
            if abs(x[i]) > 1e250:  # only the direction counts
                x = [y * 1e-200 for y in x]
        return np.array(x)

    return solve


def leading_eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns; each one's largest entry is positive."""
    n = len(v)
    k = min(k, n)
    scale = np.abs(v).max(initial=0.0)
    if not k or scale == 0.0:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, reflectors = tridiagonal(v / scale)
    values = leading_values(diagonal, off, k)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    z = np.zeros((n, k))
    draw = np.random.default_rng(12)
    first, shift = 0, 0.0
    for i in range(k):
        if i and values[i - 1] - values[i] > CLUSTER * norm:
            first = i
        # equal values get slightly different shifts, so that their solves differ
        shift = min(values[i], shift - 10 * EPS * norm) if i > first else values[i]
        solve = solver(diagonal, off, shift)
        x = draw.uniform(-1, 1, n)
        for _ in range(STEPS):
            x = solve(x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):
                x -= z[:, first:i] @ (z[:, first:i].T @ x)
            x /= np.sqrt(x @ x)
        z[:, i] = x
    u = back(reflectors, z)
    sign = np.where(u[np.abs(u).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return values * scale, u * sign
