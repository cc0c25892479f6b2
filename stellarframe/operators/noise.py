"""Whitening in overlapping blocks, point sources, and the score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fourier
from ..functions.basis import Basis
from ..functions.spline import local_kernel
from . import tiles
from .fit import stamp_windows
from .schema import FWHM_PER_SIGMA
from .subtract import MODEL


def block_variance(var: np.ndarray, inside: np.ndarray) -> float:
    """The upper median of positive variances, every block/64-th in both directions; 0 if none."""
    step = max(1, len(var) // 64)
    v = var[::step, ::step]
    return fourier.upper_median(v[inside[::step, ::step] & np.isfinite(v) & (v > 0)], 0.0)


def _basis(extra: dict) -> Basis:
    return Basis(float(extra["beta"]), int(extra["n_max"]), int(extra["radius"]))


def _count(extent: str, block: int):
    """Blocks along an axis."""
    return F.when(F.col(extent) <= block, 1).otherwise(F.ceil((F.col(extent) - block) / (block // 2)).cast("int") + 1)


def block_windows(frame_tiles: DataFrame, block: int) -> DataFrame:
    """The blocks that each tile has a part of; the last along an axis is flush with the frame."""
    out = frame_tiles
    for key, at, extent, start, length in (("k1", "wy0", "height", "y0", "h"), ("k2", "wx0", "width", "x0", "w")):
        origin = F.greatest(F.lit(0), F.least(F.col(key) * (block // 2), F.col(extent) - block))
        out = out.withColumn(key, F.explode(F.sequence(F.lit(0), _count(extent, block) - 1))).withColumn(at, origin)
        out = out.where((F.col(at) < F.col(start) + F.col(length)) & (F.col(at) + block > F.col(start)))
    return out.withColumns({"wh": F.lit(block), "ww": F.lit(block)})


def _mirror(v: tiles.View, a: np.ndarray) -> np.ndarray:
    """A block that reaches beyond a frame smaller than it, continued by reflection."""
    def places(n: int, start: int, extent: int) -> np.ndarray:
        g = np.arange(start, start + n)
        return np.clip(np.where(g >= extent, 2 * extent - g - 1, g), 0, extent - 1) - start

    return a[np.ix_(places(a.shape[0], v.y0, v.height), places(a.shape[1], v.x0, v.width))]


def decorrelate(frame_tiles: DataFrame, block: int = 256, size: int = tiles.SIZE) -> DataFrame:
    """Tiles (value, variance) of the whitened difference.

    frame_tiles: value (the difference), t_variance, c_variance and MODEL. Blocks of half overlap are filtered with the
    kernel at their middle and added under Hann windows; their parts meet again by tile.
    """
    fourier.block_origins(block, block)  # checks the size

    def run(v: tiles.View) -> pd.DataFrame:
        kernel = local_kernel(v.extra["knots"], v.extra["theta"], _basis(v.extra), min(max(v.x0 + block / 2, 0), v.width - 1), min(max(v.y0 + block / 2, 0), v.height - 1))
        vs, vr = (block_variance(v[c], v.inside) for c in ("t_variance", "c_variance"))
        filter_ = fourier.whitening_filter(kernel, vs, vr, block)
        white = fourier.apply_filter(_mirror(v, v["value"]), filter_)
        weight = np.outer(fourier.hann(block), fourier.hann(block))
        noise, rows = vs + vr * float((kernel**2).sum()), []
        for ty in range(v.y0 // size, (min(v.y0 + block, v.height) - 1) // size + 1):
            for tx in range(v.x0 // size, (min(v.x0 + block, v.width) - 1) // size + 1):
                ya, yb = max(ty * size, v.y0), min((ty + 1) * size, v.y0 + block, v.height)
                xa, xb = max(tx * size, v.x0), min((tx + 1) * size, v.x0 + block, v.width)
                cut = np.s_[ya - v.y0 : yb - v.y0, xa - v.x0 : xb - v.x0]
                rows.append((ty, tx, ya, xa, yb - ya, xb - xa, v.width, v.height, (weight * white)[cut].ravel(), v.y0, v.x0, noise))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in parts.split(", ")])

    parts = f"{tiles.TILE}, part array<float>, by int, bx int, noise double"

    def add(df: pd.DataFrame) -> pd.DataFrame:
        r = df.iloc[0]
        y0, x0 = int(r.ty) * size, int(r.tx) * size
        h, w = min(size, int(r.height) - y0), min(size, int(r.width) - x0)
        value, var, weight = np.zeros((3, h, w))
        for p in df.itertuples(index=False):
            at = np.s_[p.y0 - y0 : p.y0 - y0 + p.h, p.x0 - x0 : p.x0 - x0 + p.w]
            one = np.outer(fourier.hann(block)[p.y0 - p.by :][: p.h], fourier.hann(block)[p.x0 - p.bx :][: p.w])
            value[at] += np.asarray(p.part).reshape(p.h, p.w)
            var[at] += one * p.noise
            weight[at] += one
        over = np.where(weight > 0, weight, 1.0)
        head = {"frame_id": r.frame_id, "ty": int(r.ty), "tx": int(r.tx), "y0": y0, "x0": x0, "h": h, "w": w, "width": int(r.width), "height": int(r.height)}
        return pd.DataFrame([head | {"value": np.where(weight > 0, value / over, 0).ravel().astype(np.float32), "variance": np.where(weight > 0, var / over, 0).ravel().astype(np.float32)}])

    filtered = tiles.gather(block_windows(frame_tiles, block), ["value", "t_variance", "c_variance"], run, parts, MODEL)
    return filtered.groupBy("frame_id", "ty", "tx").applyInPandas(add, f"frame_id string, {tiles.TILE}, value array<float>, variance array<float>")


def estimate_psf(frame_tiles: DataFrame, stamps: DataFrame, radius: int, layer: str = "t_value", size: int = tiles.SIZE) -> DataFrame:
    """(frame_id, psf): the pixelwise median of stamps, each less its median and of unit sum; negative parts cut, unit sum.

    Stamps that reach beyond the frame or have no positive sum don't count. A frame without any has no row.
    """

    def run(v: tiles.View) -> pd.DataFrame:
        cut = v[layer] - np.median(v[layer]) if v.inside.all() else np.zeros(1)
        total = cut.sum()
        one = [(v.key[0], (cut / total).ravel().tolist())] if total > 0 else []
        return pd.DataFrame({"stamp": pd.Series([k for k, _ in one], dtype="int32"), "cut": pd.Series([c for _, c in one], dtype=object)})

    def middle(df: pd.DataFrame) -> pd.DataFrame:
        psf = np.clip(np.median(np.stack([np.asarray(c) for c in df.cut]), axis=0), 0, None)
        return pd.DataFrame({"frame_id": [df.frame_id.iloc[0]], "psf": [(psf / psf.sum()).tolist()]})

    windows = stamp_windows(frame_tiles, stamps.withColumn("_margin", F.lit(radius)), "_margin", size)
    return tiles.gather(windows, [layer], run, "stamp int, cut array<double>").groupBy("frame_id").applyInPandas(middle, "frame_id string, psf array<double>")


def whiten_score_psf(frame_tiles: DataFrame, block: int = 256, size: int = tiles.SIZE) -> DataFrame:
    """(frame_id, psf): the point source after the whitening at the middle of its frame. Tiles have t_variance, c_variance, MODEL, psf."""

    def run(v: tiles.View) -> pd.DataFrame:
        kernel = local_kernel(v.extra["knots"], v.extra["theta"], _basis(v.extra), 0.5 * (v.width - 1), 0.5 * (v.height - 1))
        psf = np.asarray(v.extra["psf"], float)
        side = int(round(np.sqrt(len(psf))))
        vs, vr = (block_variance(v[c], v.inside) for c in ("t_variance", "c_variance"))
        return pd.DataFrame({"psf": [fourier.whiten_psf(psf.reshape(side, side), kernel, vs, vr, block).ravel().tolist()]})

    start = lambda c: F.greatest(F.lit(0), F.floor(F.col(c) / 2).cast("int") - block // 2)
    at = frame_tiles.withColumns({"k1": F.lit(0), "k2": F.lit(0), "wy0": start("height"), "wx0": start("width"), "wh": F.lit(block), "ww": F.lit(block)})
    at = at.where((F.col("wy0") < F.col("y0") + F.col("h")) & (F.col("wy0") + block > F.col("y0")) & (F.col("wx0") < F.col("x0") + F.col("w")) & (F.col("wx0") + block > F.col("x0")))
    return tiles.gather(at, ["t_variance", "c_variance"], run, "psf array<double>", [*MODEL, "psf"])


def widths(psf: DataFrame) -> DataFrame:
    """A6 by frame: (frame_id, expected_fwhm) of (frame_id, psf); frames whose point source has no width are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"frame_id": df.frame_id, "expected_fwhm": [psf_fwhm(p) for p in df.psf]})

    return psf.select("frame_id", "psf").mapInPandas(run, "frame_id string, expected_fwhm double").where("expected_fwhm > 0 and not isnan(expected_fwhm)")


def psf_fwhm(psf: np.ndarray) -> float:
    """The width of a point source by second moments of its positive part; NaN where there is none."""
    psf = np.asarray(psf, float)
    side = int(round(np.sqrt(psf.size)))
    w = np.clip(psf.reshape(side, side), 0, None)
    y, x = np.mgrid[:side, :side]
    total = w.sum()
    if not total > 0:
        return float("nan")
    my, mx = (w * y).sum() / total, (w * x).sum() / total
    var = 0.5 * ((w * (y - my) ** 2).sum() + (w * (x - mx) ** 2).sum()) / total
    return FWHM_PER_SIGMA * float(np.sqrt(var))
