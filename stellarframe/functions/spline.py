"""Thin-plate splines over knots: how a coefficient varies over a frame."""

from __future__ import annotations

from functools import cached_property

import numpy as np


def green(r2: np.ndarray) -> np.ndarray:
    """r^2 ln(r) as 0.5 r2 ln(r2); 0 at 0."""
    r2 = np.asarray(r2, np.float64)
    return 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1.0))


def grid_knots(x0: float, y0: float, x1: float, y1: float, nx: int, ny: int) -> np.ndarray:
    """(ny * nx, 2) knots on a regular grid, rows first; a single one lies in the middle."""
    axis = lambda a, b, n: np.linspace(a, b, n) if n > 1 else np.array([0.5 * (a + b)])
    y, x = np.meshgrid(axis(y0, y1, ny), axis(x0, x1, nx), indexing="ij")
    return np.column_stack([x.ravel(), y.ravel()])


class Spline:
    """Basis of k functions for k knots: k - 3 bending ones and 1, u, v, in coordinates scaled by the knots' largest distance
    from their mean along an axis."""

    def __init__(self, knots):
        self.knots = np.asarray(knots, np.float64).reshape(-1, 2)
        if len(self.knots) < 3:
            raise ValueError("a spline needs at least 3 knots")
        self.centre = self.knots.mean(axis=0)
        extent = np.abs(self.knots - self.centre).max()
        self.scale = extent if extent > 0 else 1.0
        self._u = (self.knots - self.centre) / self.scale

    def __len__(self) -> int:
        return len(self.knots)

    @cached_property
    def null_space(self) -> np.ndarray:
        """(k, k - 3): weights of the knots that leave planes alone."""
        affine = np.column_stack([np.ones(len(self._u)), self._u])
        return np.linalg.qr(affine, mode="complete")[0][:, 3:]

    @cached_property
    def penalty(self) -> np.ndarray:
        """(k, k) bending energy, zero for planes."""
        k, z = len(self), self.null_space
        e = green(((self._u[:, None] - self._u[None]) ** 2).sum(axis=2))
        out = np.zeros((k, k))
        inner = z.T @ e @ z
        out[: k - 3, : k - 3] = 0.5 * (inner + inner.T)
        return out

    def design(self, points) -> np.ndarray:
        """(n, k) values of the basis at (x, y) points."""
        p = (np.asarray(points, np.float64).reshape(-1, 2) - self.centre) / self.scale
        e = green(((p[:, None] - self._u[None]) ** 2).sum(axis=2))
        return np.column_stack([e @ self.null_space, np.ones(len(p)), p])

    def min_spacing(self) -> float:
        """The least distance of two knots, in the units of the frame; 0 for none."""
        d = np.sqrt(((self.knots[:, None] - self.knots[None]) ** 2).sum(axis=2))
        off = d[~np.eye(len(d), dtype=bool)]
        return float(off.min()) if len(off) else 0.0

    def fit(self, points, values, lam: float) -> np.ndarray:
        """Penalised least squares without weights."""
        d = self.design(points)
        return np.linalg.solve(d.T @ d + lam * self.penalty, d.T @ np.asarray(values, np.float64))


def evaluate(knots, points, coefficients) -> np.ndarray:
    return Spline(knots).design(points) @ np.asarray(coefficients, np.float64)


def fields(theta, n_components: int) -> np.ndarray:
    """(k, n_components + 1): a column for each component's spline and the last for the background."""
    return np.asarray(theta, np.float64).reshape(n_components + 1, -1).T


def photometric_scale_at(knots, theta, component_sums, points) -> np.ndarray:
    """Sum of the matching kernel at the points."""
    sums = np.asarray(component_sums, np.float64)
    return Spline(knots).design(points) @ fields(theta, len(sums))[:, : len(sums)] @ sums


def local_kernel(knots, theta, basis, x: float, y: float) -> np.ndarray:
    """The matching kernel at one point, (size, size)."""
    a = (Spline(knots).design([(x, y)]) @ fields(theta, len(basis)))[0, : len(basis)]
    return np.tensordot(a, basis.kernels, axes=1)
