"""Eigenvalues and eigenvectors of a diagonal matrix plus a rank-one term, by its secular equation."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
STEPS = 40     # each step at least halves a root's bracket where interpolation fails


def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (d - x)), one behind each pole, as (nearer pole, distance from it).

    All roots at once: every step fits the poles left and right of a root by one simple pole each, and
    falls back to the middle of the bracket.  The distance keeps its relative precision near a pole.
    """
    n, weight = len(d), rho * z2
    todo = np.arange(n)
    last = todo == n - 1
    gap = np.append(np.diff(d), weight.sum())            # the last root's bracket ends here
    near_left = last | (1 + weight @ (1 / (d[:, None] - (d + gap / 2))) >= 0)
    origin = np.where(near_left, todo, np.minimum(todo + 1, n - 1))
    lo = np.where(near_left, 0.0, -gap / 2)
    hi = np.where(near_left, np.where(last, gap * (1 + 4 * EPS), gap / 2), 0.0)
    x = (lo + hi) / 2
    found = x.copy()
    shift = d[:, None] - d[origin]                       # poles as seen from each root's origin
    left_weight = np.where(todo[:, None] <= todo, weight[:, None], 0.0)
    left_pole = np.where(near_left, 0.0, -gap)
    right_pole = np.where(near_left, gap, 0.0)
    for _ in range(STEPS):
        with np.errstate(all="ignore"):
            inverse = 1 / (shift - x)
            square = inverse * inverse
            psi, dpsi = (np.einsum("ij,ij->j", left_weight, m) for m in (inverse, square))
            total, dtotal = weight @ inverse, weight @ square
            f = 1 + total
            lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)   # f rises between its poles
            done = np.abs(f) <= 16 * EPS * n * (1 + total - 2 * psi)
            done |= (hi - lo) <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi))
            a, b = left_pole - x, right_pole - x
            c = f - a * dpsi - np.where(last, 0.0, b * (dtotal - dpsi))
            p, q = (a + b) * f - a * b * dtotal, a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            # the last root has a pole on its left only: f ~ c + s / (pole - x)
            to = x + np.where(last, a + a * a * dpsi / c, step)
        found[todo] = x
        more = ~done
        if not more.any():
            break
        x = np.where((to > lo) & (to < hi), to, (lo + hi) / 2)[more]
        todo, last, lo, hi, left_pole, right_pole = (v[more] for v in (todo, last, lo, hi, left_pole, right_pole))
        shift, left_weight = shift[:, more], left_weight[:, more]
    return origin, found


def rank_one(d: np.ndarray, z: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Eigenvalues of diag(d) + rho z z', rho > 0, d rising: ``values, vectors, changed``.

    Deflation: entries of z too small to matter keep their pair; of two equal values a rotation empties
    one entry.  ``vectors`` holds a column for each index in ``changed`` over the rows ``changed``; other
    pairs stay.  Vectors come from the weights that make the computed roots exact, so they are orthogonal
    however close the roots are.
    """
    n, z, scale = len(d), z.copy(), rho * float(z @ z)
    if scale <= 0:
        return d, None, np.zeros(0, int)
    tol = 8 * EPS * max(abs(d[0]), abs(d[-1]), scale)
    live = np.flatnonzero(rho * np.abs(z) * np.sqrt(scale / rho) > tol)
    turns = []
    keep = []
    for i in live:
        if keep and d[i] - d[keep[-1]] <= tol:
            j = keep.pop()
            r = np.hypot(z[i], z[j])
            turns.append((j, i, z[i] / r, z[j] / r))
            z[i], z[j] = r, 0.0
        keep.append(i)
    at = np.array(keep, int)
    if not len(at):
        return d, None, at
    pole, weight = d[at], z[at]
    origin, x = _roots(pole, weight * weight, rho)
    less = (pole[:, None] - pole[origin]) - x               # pole i minus root j
    less[less == 0] = -EPS * tol
    values = d.copy()
    values[at] = pole[origin] + x
    # weights whose roots are exactly those found
    over = pole[:, None] - pole
    np.fill_diagonal(over, -1.0)
    ratio = less / over
    weight = np.copysign(np.sqrt(np.abs(ratio.prod(1))), weight)
    vectors = weight[:, None] / less
    vectors /= np.sqrt((vectors * vectors).sum(0))
    if not turns:
        return values, vectors, at
    # rows of the rotated pairs join the changed block
    used = np.union1d(at, np.array([k for t in turns for k in t[:2]], int))
    full = np.eye(len(used))
    place = {k: i for i, k in enumerate(used)}
    own = [place[k] for k in at]
    full[np.ix_(own, own)] = vectors
    for j, i, c, s in reversed(turns):
        a, b = full[place[i]].copy(), full[place[j]].copy()
        full[place[i]], full[place[j]] = c * a - s * b, s * a + c * b
    return values, full, used


class Spectrum:
    """Count, mean, and eigenvalues (rising) and vectors (columns) of the centred scatter of vectors."""

    def __init__(self, size: int):
        self.n, self.mean = 0, np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def _rank_one(self, v: np.ndarray, rho: float) -> None:
        values, turn, at = rank_one(self.values, self.vectors.T @ v, rho)
        if turn is None:
            return
        if len(at) == len(values):
            vectors = self.vectors @ turn
        else:
            vectors = self.vectors.copy()
            vectors[:, at] = self.vectors[:, at] @ turn
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def add(self, x: np.ndarray) -> None:
        """Take one vector in: a rank-one update along its distance from the mean."""
        away = x - self.mean
        if self.n:
            self._rank_one(away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """Take another spectrum in: a rank-one update for each of its pairs and one for the means."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._rank_one(vector, value)
        away = other.mean - self.mean
        total = self.n + other.n
        self._rank_one(away, self.n * other.n / total)
        self.mean = self.mean + away * (other.n / total)
        self.n = total
