"""Singular values and right singular vectors of a small square matrix by way of its bidiagonal
form: Householder reflections, dqds for the values, twisted factorisations for the vectors."""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
#: Values closer than this part of the larger one share a space that is made orthogonal.
_CLUSTER = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with R = U B V' for an upper bidiagonal B."""
    a = np.array(r, float)
    n = len(a)
    v = np.eye(n)

    def reflector(x):
        u = x.copy()
        length = np.linalg.norm(u)
        u[0] += length if u[0] >= 0 else -length
        size = np.linalg.norm(u)
        return u / size if size > 0 else None

    for k in range(n):
        u = reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 1 < n:
            u = reflector(a[k, k + 1:])
            if u is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ u, u)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _sweep(q, e, shift):
    """One dqds transform; (new q, new e, sum of 1 / d), or None where the shift is too large."""
    n = len(q)
    out_q, out_e, inverse = [0.0] * n, [0.0] * (n - 1), 0.0
    d = q[0] - shift
    for k in range(n - 1):
        if d < 0:
            return None
        inverse += 1 / d if d > 0 else np.inf
        out_q[k] = d + e[k]
        t = q[k + 1] / out_q[k] if out_q[k] > 0 else 0.0
        out_e[k] = e[k] * t
        d = d * t - shift if out_q[k] > 0 else q[k + 1] - shift
    if d < 0:
        return None
    inverse += 1 / d if d > 0 else np.inf
    out_q[-1] = d
    return out_q, out_e, inverse


def singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """All singular values of the bidiagonal matrix, falling. dqds: each sweep is a Cholesky
    step of B'B less a shift; the squares come out at the bottom with high relative accuracy.
    A shift is tried near the last diagonal entry; the bound 1 / trace of the inverse is safe."""
    q = [float(x) for x in np.square(diagonal)]
    e = [float(x) for x in np.square(upper)]
    found, open_ = [], [(q, e, 0.0)]
    while open_:
        q, e, base = open_.pop()
        safe = 0.0
        while len(q) > 1:
            for k in range(len(e)):
                # an entry this small changes no square by more than rounding does
                if e[k] <= _EPS * _EPS * (base + min(q[k], q[k + 1])):
                    open_.append((q[:k + 1], e[:k], base))
                    q, e, safe = q[k + 1:], e[k + 1:], 0.0
                    break
            else:
                guess = q[-1] * (1 - np.sqrt(e[-1] / (q[-1] + e[-1])))
                for shift in (max(guess, safe), safe, 0.0):
                    if (done := _sweep(q, e, shift)) is not None:
                        break
                q, e, inverse = done
                base += shift
                # what is left is at least 1 / trace of the inverse, seen before the shift
                safe = (1 - 1e-10) / inverse if inverse < np.inf else 0.0
        found.append(base + q[0])
    return np.sqrt(np.sort(np.maximum(found, 0))[::-1])


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """The right singular vector of a singular value: B'B less its square is factorised from
    the top and from the bottom, the two meet where the residue is least."""
    n = len(diagonal)
    size = max(np.abs(diagonal).max(), np.abs(upper).max(initial=0.0))
    tiny = _EPS * _EPS * size * size
    a = np.where(np.abs(diagonal) > _EPS * _EPS * size, diagonal, _EPS * _EPS * size)
    d, low, square = a * a, upper / a[:-1], value * value
    s, p = np.empty(n), np.empty(n)
    plus, minus = np.empty(n - 1), np.empty(n - 1)
    s[0] = -square
    for i in range(n - 1):
        top = s[i] + d[i]
        top = top if abs(top) > tiny else tiny
        plus[i] = d[i] * low[i] / top
        s[i + 1] = plus[i] * low[i] * s[i] - square
    p[-1] = d[-1] - square
    for i in range(n - 2, -1, -1):
        bottom = d[i] * low[i] * low[i] + p[i + 1]
        bottom = bottom if abs(bottom) > tiny else tiny
        t = d[i] / bottom
        minus[i] = low[i] * t
        p[i] = p[i + 1] * t - square
    k = int(np.argmin(np.abs(s + p + square)))
    z = np.zeros(n)
    z[k] = 1
    for i in range(k - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -minus[i] * z[i]
    return z / np.linalg.norm(z)


def _parts(diagonal, upper):
    """First and last place of the parts that negligible superdiagonal entries separate."""
    size = np.abs(diagonal)
    cut = np.flatnonzero(np.abs(upper) <= _EPS * np.sqrt(size[:-1] * size[1:])) + 1
    edges = [0, *cut.tolist(), len(diagonal)]
    return list(zip(edges[:-1], edges[1:]))


def right_vectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of R, falling, and their right singular vectors as columns.
    Vectors of nearly equal values are made orthogonal and turned to the axes of R in the space
    they share."""
    diagonal, upper, v = bidiagonalise(r)
    n, pairs = len(diagonal), []
    for first, last in _parts(diagonal, upper):
        d, u = diagonal[first:last], upper[first:last - 1]
        pairs += [(value, first, last) for value in singular_values(d, u)]
    pairs.sort(key=lambda x: (-x[0], x[1]))
    # a space that the k-th value shares with later ones is taken whole
    m = min(k, n)
    while m < n and pairs[m][0] > pairs[m - 1][0] * (1 - _CLUSTER):
        m += 1
    values, y = np.array([x[0] for x in pairs[:m]]), np.zeros((n, m))
    for j, (value, first, last) in enumerate(pairs[:m]):
        y[first:last, j] = twisted_vector(diagonal[first:last], upper[first:last - 1], value) \
            if last - first > 1 else 1.0
    out = v @ y
    start = 0
    for j in range(1, m + 1):
        if j == m or values[j] <= values[j - 1] * (1 - _CLUSTER):
            if j - start > 1 and values[start] > 0:
                out[:, start:j], values[start:j] = _settle(r, out[:, start:j], values[start])
            start = j
    return values[:k], out[:, :k]


def _settle(r, vectors, value):
    """An orthonormal basis of the vectors' space, turned so that R maps it to orthogonal ones.
    Twisted vectors of nearly equal values may fall together: inverse iteration with a shift
    beside them brings the whole space back."""
    basis, _ = np.linalg.qr(vectors)
    shifted = r.T @ r - value * value * (1 + 1e-9) * np.eye(len(r))
    for _ in range(4):
        basis, _ = np.linalg.qr(np.linalg.solve(shifted, basis))
    _, values, turn = np.linalg.svd(r @ basis, full_matrices=False)
    return basis @ turn.T, values
