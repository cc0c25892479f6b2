"""Penalised weighted least squares for the spatially varying kernel: normal equations, smoothing by GCV or group CV."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .spline import Spline


@dataclass
class Normal:
    """Sums over pixels that add up: M = X'WX, rhs = X'Wt, t'Wt and the number of pixels."""

    m: np.ndarray
    rhs: np.ndarray
    energy: float = 0.0
    n: int = 0

    @classmethod
    def of(cls, design, bn, target, weights, chunk: int = 8192) -> Normal:
        """The columns of X are bn_c * design for each component, then design for the background."""
        k, nc = design.shape[1], bn.shape[1]
        out = cls(np.zeros(((nc + 1) * k,) * 2), np.zeros((nc + 1) * k))
        full = np.column_stack([bn, np.ones(len(bn))])
        for s in range(0, len(target), chunk):
            cut = slice(s, s + chunk)
            x = (full[cut, :, None] * design[cut, None, :]).reshape(-1, (nc + 1) * k)
            wx = x * weights[cut, None]
            out.m += x.T @ wx
            out.rhs += wx.T @ target[cut]
            out.energy += float((weights[cut] * target[cut] ** 2).sum())
        out.n = len(target)
        return out

    @classmethod
    def of_stamp(cls, d, bn, target, weights) -> Normal:
        """As of(), with one row d of the design for all pixels: moments of the stamp times the products of d."""
        full = np.column_stack([bn, np.ones(len(bn))])
        w = full * weights[:, None]
        return cls(np.kron(w.T @ full, np.outer(d, d)), np.kron(w.T @ target, d), float((weights * target**2).sum()), len(target))

    def __add__(self, other: Normal) -> Normal:
        return Normal(self.m + other.m, self.rhs + other.rhs, self.energy + other.energy, self.n + other.n)

    def __sub__(self, other: Normal) -> Normal:
        return Normal(self.m - other.m, self.rhs - other.rhs, self.energy - other.energy, self.n - other.n)

    def misfit(self, theta) -> float:
        """Weighted sum of squared residuals of theta, not below 0."""
        return max(float(self.energy - 2 * theta @ self.rhs + theta @ self.m @ theta), 0.0)


@dataclass
class Fit:
    theta: np.ndarray
    lam: float
    rss: float
    effective_dof: float
    gcv: float
    curve: list[float] = field(default_factory=list)


def penalty_half(penalty: np.ndarray) -> np.ndarray:
    """F with F F' = penalty, without the directions that it leaves alone."""
    w, v = np.linalg.eigh(penalty)
    keep = w > np.abs(w).max(initial=0.0) * len(w) * np.finfo(float).eps
    return v[:, keep] * np.sqrt(w[keep])


def solve_at(normal: Normal, spline: Spline, lam: float) -> Fit:
    """The minimum of misfit + lam * bending energy of every field."""
    p, k = len(normal.rhs), len(spline)
    a = normal.m + lam * np.kron(np.eye(p // k), spline.penalty)
    try:
        np.linalg.cholesky(a)
        half = np.kron(np.eye(p // k), penalty_half(spline.penalty))
        out = np.linalg.solve(a, np.column_stack([normal.rhs, half]))
        theta = out[:, 0]
        dof = p - lam * float((half * out[:, 1:]).sum())
    except np.linalg.LinAlgError:  # not positive definite to working precision
        theta = np.linalg.lstsq(a, normal.rhs, rcond=None)[0]
        dof = float(np.trace(np.linalg.lstsq(a, normal.m, rcond=None)[0]))
    rss = normal.misfit(theta)
    free = normal.n - dof
    return Fit(theta, float(lam), rss, dof, normal.n * rss / free**2 if free > 0 else float("inf"))


def _first_least(curve) -> int:
    curve = np.asarray(curve, float)
    return int(np.argmin(np.where(np.isnan(curve), np.inf, curve)))


def solve_gcv(normal: Normal, spline: Spline, grid) -> Fit:
    """The smoothing of the grid with the least generalised cross-validation score; the first if several."""
    if not len(grid):
        raise ValueError("the grid of lambdas is empty")
    fits = [solve_at(normal, spline, lam) for lam in grid]
    best = fits[_first_least([f.gcv for f in fits])]
    best.curve = [f.gcv for f in fits]
    return best


def least_on_grid(error, n: int, start: int | None = None) -> tuple[int, list[float]]:
    """(place, curve): where error(i), of one valley over 0 to n - 1, is least; the first place if several. Infinity in the
    curve where nothing had to be computed.

    The points looked at close in on the best one: without a start every fourth of the grid is looked at first; then its
    neighbours two steps and one step away, as long as one of them is better.
    """
    known: dict[int, float] = {}

    def look(places) -> int:
        for i in places:
            if 0 <= i < n and i not in known:
                e = float(error(i))
                known[i] = float("inf") if np.isnan(e) else e
        return min(sorted(known), key=known.__getitem__)

    best = look([*range(0, n, 4), n - 1] if start is None else [min(max(start, 0), n - 1)])
    for step in (2, 1) if start is None else (1,):
        while (now := look([best - step, best + step])) != best:
            best = now
    return best, [known.get(i, float("inf")) for i in range(n)]


def solve_cv(folds: list[Normal], spline: Spline, grid, start: int | None = None) -> Fit:
    """The smoothing with the least error on folds left out in turn. Fewer than two folds: GCV.

    The error has one valley over the grid; start is where to look first, as after a fit of nearly the same pixels.
    """
    if not len(grid):
        raise ValueError("the grid of lambdas is empty")
    total = sum(folds[1:], folds[0])
    if len(folds) < 2:
        return solve_gcv(total, spline, grid)
    held = [f for f in folds if f.n]
    rest = [total - f for f in held]
    bend = np.kron(np.eye(len(total.rhs) // len(spline)), spline.penalty)

    def left_out(i: int) -> float:
        error = 0.0
        for r, h in zip(rest, held, strict=True):
            a = r.m + grid[i] * bend
            try:
                theta = np.linalg.solve(a, r.rhs)
            except np.linalg.LinAlgError:
                theta = np.linalg.lstsq(a, r.rhs, rcond=None)[0]
            error += h.misfit(theta)
        return error / max(total.n, 1)

    place, curve = least_on_grid(left_out, len(grid), start)
    best = solve_at(total, spline, grid[place])
    best.curve = curve
    return best


def solve_gls(knots, points, target, weights, bn, lam: float) -> Fit:
    spline = Spline(knots)
    return solve_at(Normal.of(spline.design(points), np.asarray(bn, float), np.asarray(target, float), np.asarray(weights, float)), spline, lam)


def solve_gls_gcv(knots, points, target, weights, bn, grid) -> Fit:
    spline = Spline(knots)
    return solve_gcv(Normal.of(spline.design(points), np.asarray(bn, float), np.asarray(target, float), np.asarray(weights, float)), spline, grid)


def solve_gls_cv(knots, points, target, weights, bn, grid, group, n_groups: int) -> Fit:
    """group: the fold of each row, 0 to n_groups - 1."""
    spline, group = Spline(knots), np.asarray(group)
    if len(group) != len(target):
        raise ValueError("a fold for each row is needed")
    d, bn, t, w = spline.design(points), np.asarray(bn, float), np.asarray(target, float), np.asarray(weights, float)
    if n_groups < 2:
        return solve_gcv(Normal.of(d, bn, t, w), spline, grid)
    return solve_cv([Normal.of(d[g], bn[g], t[g], w[g]) for g in (group == f for f in range(n_groups))], spline, grid)
