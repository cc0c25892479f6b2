"""Gauss-Hermite kernels: the functions that a matching kernel is a sum of."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np


def default_radius(beta: float, n_max: int) -> int:
    """Half width that holds the widest component: 3 beta sqrt(n_max + 1), rounded up, at least 3."""
    return max(math.ceil(3.0 * beta * math.sqrt(n_max + 1)), 3)


@dataclass(frozen=True)
class Basis:
    """Separable components phi(nx, ny) of scale beta up to total order n_max; radius 0 means default_radius."""

    beta: float
    n_max: int
    radius: int = 0

    def __post_init__(self):
        if not self.beta > 0 or self.n_max < 0 or self.radius < 0:
            raise ValueError("beta must be positive, n_max and radius not negative")
        if not self.radius:
            object.__setattr__(self, "radius", default_radius(self.beta, self.n_max))

    @property
    def size(self) -> int:
        return 2 * self.radius + 1

    @cached_property
    def orders(self) -> list[tuple[int, int]]:
        """(nx, ny) of each component: by total order, then by ny."""
        return [(total - ny, ny) for total in range(self.n_max + 1) for ny in range(total + 1)]

    def __len__(self) -> int:
        return len(self.orders)

    @cached_property
    def rows(self) -> np.ndarray:
        """The 1-D functions, (n_max + 1, size), normalised on the line: H_n(t) exp(-t^2/2) / sqrt(2^n n! sqrt(pi) beta)."""
        t = np.arange(-self.radius, self.radius + 1) / self.beta
        hermite = [np.ones_like(t), 2 * t]
        for n in range(1, self.n_max):
            hermite.append(2 * t * hermite[n] - 2 * n * hermite[n - 1])
        scale = [math.exp(-0.5 * (n * math.log(2) + math.lgamma(n + 1) + 0.5 * math.log(math.pi) + math.log(self.beta))) for n in range(self.n_max + 1)]
        return np.stack([s * h * np.exp(-0.5 * t * t) for s, h in zip(scale, hermite, strict=False)])

    @cached_property
    def kernels(self) -> np.ndarray:
        """(components, size, size); rows are y."""
        return np.stack([np.outer(self.rows[ny], self.rows[nx]) for nx, ny in self.orders])

    @cached_property
    def sums(self) -> np.ndarray:
        """The sum of each component, from the 1-D sums."""
        s = self.rows.sum(axis=1)
        return np.array([s[nx] * s[ny] for nx, ny in self.orders])


def convolve_axis(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """True convolution along an axis, zero beyond the edges, same size."""
    image = np.moveaxis(np.asarray(image, np.float64), axis, -1)
    r, n = len(kernel) // 2, image.shape[-1]
    padded = np.pad(image, [(0, 0)] * (image.ndim - 1) + [(r, r)])
    out = np.zeros_like(image)
    for j, k in enumerate(kernel):
        out += k * padded[..., 2 * r - j : 2 * r - j + n]
    return np.moveaxis(out, -1, axis)


def convolve_separable(image: np.ndarray, kernel_x: np.ndarray, kernel_y: np.ndarray) -> np.ndarray:
    return convolve_axis(convolve_axis(image, kernel_x, 1), kernel_y, 0)


def basis_stack(image: np.ndarray, basis: Basis) -> np.ndarray:
    """(components, H, W): the image convolved with each component; passes along x are shared."""
    along_x = [convolve_axis(image, row, 1) for row in basis.rows]
    return np.stack([convolve_axis(along_x[nx], basis.rows[ny], 0) for nx, ny in basis.orders])


def correlate2d(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sum of kernel[dy, dx] * image[y + dy, x + dx] for the part of image that has a full window around it."""
    kh, kw = kernel.shape
    h, w = image.shape[0] - kh + 1, image.shape[1] - kw + 1
    out = np.zeros((h, w))
    for y, x in np.argwhere(kernel != 0):
        out += kernel[y, x] * image[y : y + h, x : x + w]
    return out
