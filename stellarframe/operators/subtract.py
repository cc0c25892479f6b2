"""Difference frames: science minus convolved reference minus background, with variance and mask."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Basis, basis_stack, correlate2d
from ..functions.spline import Spline, fields
from . import pixels, tiles
from .fit import PAIR
from .schema import MASK_BITS

#: Side of the squares within which the kernel counts as constant for the variance.
FREEZE = 64
MODEL = ["knots", "theta", "beta", "n_max", "radius"]


def dilate_array(mask: np.ndarray, radius: int) -> np.ndarray:
    out = mask
    for axis in (0, 1):
        pad = np.pad(out, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)])
        n = out.shape[axis]
        out = np.bitwise_or.reduce([np.take(pad, range(s, s + n), axis) for s in range(2 * radius + 1)])
    return out


def coefficient_fields(frame_tiles: DataFrame, size: int = tiles.SIZE) -> DataFrame:
    """Tiles with `coefficients`, the fields of every component and the background, exactly at each pixel. Tiles have MODEL."""

    def run(v: tiles.View) -> pd.DataFrame:
        basis = Basis(float(v.extra["beta"]), int(v.extra["n_max"]), int(v.extra["radius"]))
        values = Spline(v.extra["knots"]).design(v.points()) @ fields(v.extra["theta"], len(basis))
        return tiles.tile_row(v, 0, {"coefficients": values.T})

    return tiles.gather(tiles.halo_windows(frame_tiles, 0, size), ["value"], run, f"{tiles.TILE}, coefficients array<double>", MODEL)


def photometric_scale(frame_tiles: DataFrame, size: int = tiles.SIZE) -> DataFrame:
    """Tiles with `scale`, the sum of the kernel at each pixel. Tiles have MODEL."""

    def run(v: tiles.View) -> pd.DataFrame:
        basis = Basis(float(v.extra["beta"]), int(v.extra["n_max"]), int(v.extra["radius"]))
        values = Spline(v.extra["knots"]).design(v.points()) @ fields(v.extra["theta"], len(basis))[:, : len(basis)] @ basis.sums
        return tiles.tile_row(v, 0, {"scale": values})

    return tiles.gather(tiles.halo_windows(frame_tiles, 0, size), ["value"], run, f"{tiles.TILE}, scale array<float>", MODEL)


def _variance(v: tiles.View, basis: Basis, spline: Spline, c: np.ndarray, r: int) -> np.ndarray | None:
    """Var(T) + K^2 (x) Var(C), the kernel taken at the middle of each square of FREEZE pixels of the frame."""
    vt, vc = v["t_variance"], v["c_variance"]
    if vt is None and vc is None:
        return None
    h, w = v.inside.shape[0] - 2 * r, v.inside.shape[1] - 2 * r
    out = np.zeros((h, w)) if vt is None else vt[r : r + h, r : r + w].copy()
    if vc is None:
        return out
    noise = np.where(v.inside & np.isfinite(vc), vc, 0.0)
    y0, x0, nc = v.y0 + r, v.x0 + r, len(basis)
    for by in range(y0 - y0 % FREEZE, y0 + h, FREEZE):
        for bx in range(x0 - x0 % FREEZE, x0 + w, FREEZE):
            bh, bw = min(FREEZE, v.height - by), min(FREEZE, v.width - bx)
            centre = (min(bx + bw // 2, v.width - 1), min(by + bh // 2, v.height - 1))
            kernel = np.tensordot((spline.design([centre]) @ c)[0, :nc], basis.kernels, axes=1)
            ya, yb, xa, xb = max(by, y0) - y0, min(by + bh, y0 + h) - y0, max(bx, x0) - x0, min(bx + bw, x0 + w) - x0
            out[ya:yb, xa:xb] += correlate2d(noise[ya : yb + 2 * r, xa : xb + 2 * r], (kernel**2)[::-1, ::-1])
    return out


def difference(pair: DataFrame, solutions: DataFrame, fill: DataFrame, saturation: float = 0.0, size: int = tiles.SIZE) -> DataFrame:
    """M7: tiles (value, variance, mask) of target minus model; variance and mask null if the pair has none.

    Only pixels that are bad themselves get the median of the good difference (R1) and variance 0; grown and edge pixels are
    flagged.
    """
    return resolve(differences(pair, solutions, fill, saturation, size))


def differences(pair: DataFrame, solutions: DataFrame, fill: DataFrame, saturation: float = 0.0, size: int = tiles.SIZE) -> DataFrame:
    """M7 before bad pixels are filled: tiles (value, variance, mask) and exact_mask, which says what resolve() fills.

    pair: tiles with PAIR layers. fill: (frame_id, fill), what stands for bad pixels of the convolved frame (A4).
    """
    sat, edge, nonfinite = MASK_BITS["saturated"], MASK_BITS["edge"], MASK_BITS["nonfinite"]

    def run(v: tiles.View) -> pd.DataFrame:
        basis = Basis(float(v.extra["beta"]), int(v.extra["n_max"]), int(v.extra["radius"]))
        spline, r, nc = Spline(v.extra["knots"]), basis.radius, len(basis)
        c = fields(v.extra["theta"], nc)
        mid = slice(r, -r)
        conv, target = v["c_value"], v["t_value"][mid, mid]
        fine = v.inside & np.isfinite(conv)
        if v["c_mask"] is not None:
            fine &= v["c_mask"] == 0
        filled = np.where(fine, conv, np.where(v.inside, float(v.extra["fill"]), 0.0))
        along = spline.design(v.points(r)) @ c
        model = along[:, nc].reshape(target.shape).copy()
        for n, plane in enumerate(basis_stack(filled, basis)):
            model += along[:, n].reshape(target.shape) * plane[mid, mid]
        value = target - model
        variance = _variance(v, basis, spline, c, r)
        mask = exact = None
        if v["t_mask"] is not None or v["c_mask"] is not None or saturation > 0:
            mask = np.zeros(target.shape, np.int64) if v["t_mask"] is None else v["t_mask"][mid, mid].copy()
            grow = np.zeros(v.inside.shape, np.int64) if v["c_mask"] is None else v["c_mask"].copy()
            if saturation > 0:
                grow[v.inside & (conv >= saturation)] |= sat
                mask[target >= saturation] |= sat
            exact = (mask != 0) | (grow[mid, mid] != 0) | ~np.isfinite(value)
            mask |= dilate_array(grow, r)[mid, mid]
            gx, gy = v.points(r).T.reshape(2, *target.shape)
            mask[(gx < r) | (gx >= v.width - r) | (gy < r) | (gy >= v.height - r)] |= edge
            mask[~np.isfinite(value)] |= nonfinite
        return tiles.tile_row(v, r, {"value": value, "variance": variance, "mask": mask, "exact_mask": None if exact is None else exact.astype(int)})

    windows = tiles.halo_windows(pair.join(solutions.select("frame_id", "direction", *MODEL), "frame_id").join(fill, "frame_id"), "radius", size)
    schema = f"{tiles.TILE}, value array<float>, variance array<float>, mask array<smallint>, exact_mask array<smallint>"
    return tiles.gather(windows, PAIR, run, schema, [*MODEL, "fill"])


def resolve(raw: DataFrame, step: int = 7) -> DataFrame:
    """Pixels of exact_mask take the upper median of good pixels at every 7th place, and variance 0."""
    fill = tiles.median_at(raw.where("mask is not null"), step, "_fill")
    out = raw.join(fill, "frame_id", "left").withColumn("_fill", F.coalesce(F.col("_fill").cast("float"), F.lit(0.0).cast("float")))
    put = lambda c, x: F.when(F.col("exact_mask").isNull() | F.col(c).isNull(), F.col(c)).otherwise(F.zip_with(c, "exact_mask", lambda v, e: F.when(e != 0, x).otherwise(v)))
    return out.withColumns({"value": put("value", F.col("_fill")), "variance": put("variance", F.lit(0.0).cast("float"))}).drop("_fill", "exact_mask")
