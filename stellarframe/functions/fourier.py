"""Noise whitening in blocks: the filter that evens out what a convolved reference does to the noise."""

from __future__ import annotations

import numpy as np


def hann(n: int) -> np.ndarray:
    return 0.5 * (1 - np.cos(2 * np.pi * (np.arange(n) + 0.5) / n))


def kernel_power(kernel: np.ndarray, n: int) -> np.ndarray:
    """|K|^2 on the half plane of an n x n transform."""
    full = np.zeros((n, n))
    rows, columns = (np.arange(k) - k // 2 for k in kernel.shape)
    np.add.at(full, (rows[:, None] % n, columns % n), kernel)
    return np.abs(np.fft.rfft2(full)) ** 2


def whitening_filter(kernel: np.ndarray, var_science: float, var_reference: float, n: int) -> np.ndarray:
    """sqrt(vs + vr sum K^2) / sqrt(vs + vr |K|^2), 0 where nothing is left to divide by."""
    return filter_from_power(kernel_power(kernel, n), float((kernel**2).sum()), var_science, var_reference)


def filter_from_power(power: np.ndarray, sum_k2: float, var_science: float, var_reference: float) -> np.ndarray:
    below = var_science + var_reference * power
    top = np.sqrt(max(var_science + var_reference * sum_k2, 0.0))
    return np.where(below > 0, top / np.sqrt(np.where(below > 0, below, 1.0)), 0.0)


def apply_filter(block: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """Circular filtering of a square block."""
    return np.fft.irfft2(np.fft.rfft2(block) * filter_, s=block.shape)


def decorrelate_block(image: np.ndarray, kernel: np.ndarray, var_science: float, var_reference: float) -> np.ndarray:
    if image.shape[0] != image.shape[1]:
        raise ValueError("a square block is needed")
    return apply_filter(image, whitening_filter(kernel, var_science, var_reference, len(image)))


def whitening_kernel(kernel: np.ndarray, var_science: float, var_reference: float, n: int) -> np.ndarray:
    """The filter in pixels, its centre at n // 2."""
    return np.fft.fftshift(np.fft.irfft2(whitening_filter(kernel, var_science, var_reference, n), s=(n, n)))


def whiten_psf(psf: np.ndarray, kernel: np.ndarray, var_science: float, var_reference: float, block: int) -> np.ndarray:
    """The point source after whitening, cut to its size, with unit sum."""
    size = len(psf)
    if block < size:
        raise ValueError("the block must be at least as wide as the point source")
    full = np.zeros((block, block))
    at = block // 2 - size // 2
    full[at : at + size, at : at + size] = psf
    out = decorrelate_block(full, kernel, var_science, var_reference)[at : at + size, at : at + size]
    total = out.sum()
    return out / total if total != 0 else out


def block_origins(extent: int, block: int) -> list[int]:
    """Where blocks begin along an axis: every half block, the last flush with the end."""
    if block < 8 or block & (block - 1):
        raise ValueError("the block must be a power of two of at least 8")
    if extent <= block:
        return [0]
    out = list(range(0, extent - block + 1, block // 2))
    return out if out[-1] + block == extent else [*out, extent - block]


def upper_median(values: np.ndarray, empty: float = float("nan")) -> float:
    """The value in the middle, the upper one of two."""
    values = np.asarray(values)
    return float(np.partition(values, len(values) // 2)[len(values) // 2]) if len(values) else empty
