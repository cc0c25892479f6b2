"""Stamps: bright, clean, isolated stars of a frame, and those that two frames share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels, tiles
from .schema import FWHM_PER_SIGMA, STAMPS


def fwhm_at(image: np.ndarray, inside: np.ndarray, y: int, x: int, radius: int, level: float) -> float:
    """A5 on an array; NaN where nothing lies above the level."""
    ya, yb, xa, xb = max(0, y - radius), y + radius + 1, max(0, x - radius), x + radius + 1
    cut = np.where(inside[ya:yb, xa:xb], image[ya:yb, xa:xb] - level, 0.0)
    w = np.where(cut > 0, cut, 0.0)
    total = w.sum()
    if not total > 0:
        return float("nan")
    gy, gx = np.mgrid[ya : ya + w.shape[0], xa : xa + w.shape[1]]
    my, mx = (w * gy).sum() / total, (w * gx).sum() / total
    var = 0.5 * ((w * (gx - mx) ** 2).sum() + (w * (gy - my) ** 2).sum()) / total
    return FWHM_PER_SIGMA * float(np.sqrt(var)) if var > 0 else float("nan")


def candidates(frame_tiles: DataFrame, background: DataFrame, stamp_radius: int = 15, threshold_sigma: float = 5.0, saturation: float = 0.0, border: int = 0, fwhm_radius: int = 0, size: int = tiles.SIZE) -> DataFrame:
    """Peaks above the threshold with a clean footprint, and their width (STAMPS). background: (frame_id, median, sigma)."""
    edge = border or stamp_radius
    wide = fwhm_radius or max(5, stamp_radius // 2)
    r = max(stamp_radius, wide, 1)

    def run(v: tiles.View) -> pd.DataFrame:
        med, sigma = float(v.extra["median"]), float(v.extra["sigma"])
        image, h, w = v["value"], *v.inside.shape
        ok = v.inside & np.isfinite(image)
        if v["mask"] is not None:
            ok &= v["mask"] == 0
        if saturation > 0:
            ok &= ~(image >= saturation)
        bad = np.pad(np.cumsum(np.cumsum(~ok, axis=0), axis=1), ((1, 0), (1, 0)))
        s = 2 * stamp_radius + 1
        y, x = np.mgrid[r : h - r, r : w - r]
        boxed = bad[y - stamp_radius + s, x - stamp_radius + s] - bad[y - stamp_radius, x - stamp_radius + s] - bad[y - stamp_radius + s, x - stamp_radius] + bad[y - stamp_radius, x - stamp_radius]
        here = image[r : h - r, r : w - r]
        flat = np.where(np.isfinite(image), image, -np.inf)
        top = np.max([flat[r + dy : h - r + dy, r + dx : w - r + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        gy, gx = y + v.y0, x + v.x0
        peak = (here > med + threshold_sigma * (sigma if sigma > 0 else 1.0)) & (here >= top) & (boxed == 0)
        peak &= (gx >= edge) & (gx < v.width - edge) & (gy >= edge) & (gy < v.height - edge)
        rows = [(int(gx[i]), int(gy[i]), float(here[i]) - med, fwhm_at(image, v.inside, int(y[i]), int(x[i]), wide, med)) for i in map(tuple, np.argwhere(peak))]
        out = pd.DataFrame(rows, columns=["x", "y", "flux", "fwhm"])
        out.insert(3, "snr", out.flux / sigma if sigma > 0 else out.flux)
        return out

    windows = tiles.halo_windows(frame_tiles, r, size).join(background, "frame_id")
    return tiles.gather(windows, ["value", "mask"], run, STAMPS.removeprefix("frame_id string, "), ["median", "sigma"])


def isolated(stamps: DataFrame, isolation_radius: int, max_stamps: int) -> DataFrame:
    """By flux, then y and x, a stamp stays if none that stays lies nearer; max_stamps at most for each frame.

    The order makes this sequential within a frame; frames run apart, and only peaks get here.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["flux", "y", "x"], ascending=[False, True, True], kind="stable")
        xy, kept = df[["x", "y"]].to_numpy(np.int64), []
        for i in range(len(df)):
            if len(kept) >= max_stamps:
                break
            if not kept or ((xy[kept] - xy[i]) ** 2).sum(axis=1).min() >= isolation_radius**2:
                kept.append(i)
        return df.iloc[kept]

    return stamps.groupBy("frame_id").applyInPandas(run, STAMPS)


def detect_stamps(frame_tiles: DataFrame, background: DataFrame | None = None, stamp_radius: int = 15, threshold_sigma: float = 5.0, max_stamps: int = 200, saturation: float = 0.0, isolation_radius: int = 0, border: int = 0, fwhm_radius: int = 0, size: int = tiles.SIZE) -> DataFrame:
    """D1. Zeros mean the defaults: border stamp_radius, isolation 2 stamp_radius, width measured within max(5, half of it)."""
    level = tiles.background(frame_tiles) if background is None else background
    found = candidates(frame_tiles, level, stamp_radius, threshold_sigma, saturation, border, fwhm_radius, size)
    return isolated(found, isolation_radius or 2 * stamp_radius, max_stamps)


def choose_direction(fwhm_science: float, fwhm_reference: float) -> str:
    """Which image is convolved: the reference unless it is the wider one or a width is unknown."""
    return "reference" if fwhm_reference <= fwhm_science else "science"


def summary(selected: DataFrame) -> DataFrame:
    """(frame_id, median_fwhm_science, median_fwhm_reference, direction), upper medians of known widths."""
    known = lambda c: F.expr(f"percentile_disc(0.5) within group (order by nanvl({c}, null) desc)").alias(f"median_{c}")
    out = selected.groupBy("frame_id").agg(known("fwhm_science"), known("fwhm_reference"))
    worse = F.coalesce(F.col("median_fwhm_reference") <= F.col("median_fwhm_science"), F.lit(False))
    return out.withColumn("direction", F.when(worse, "reference").otherwise("science"))


def select_stamps(science: DataFrame, reference: DataFrame, match_radius: int = 2) -> DataFrame:
    """Stamps of the reference with the width of the nearest science stamp within match_radius, in the reference's order.

    Two detections on one science star are both kept; a reference stamp without a match goes.
    """
    point = lambda df: df.select("frame_id", F.struct("y", "x").alias("point"), F.col("x").alias("px"), F.col("y").alias("py"), "flux")
    met = pixels.cross_match(point(reference), point(science), match_radius)
    s = science.select("frame_id", F.struct("y", "x").alias("s_point"), F.col("fwhm").alias("fwhm_science"))
    r = reference.select("frame_id", F.struct("y", "x").alias("point"), "flux", F.col("fwhm").alias("fwhm_reference"))
    both = met.join(s, ["frame_id", "s_point"]).join(r, ["frame_id", "point"])
    order = pixels.Window.partitionBy("frame_id").orderBy(F.desc("flux"), "py", "px")
    return both.select("frame_id", (F.row_number().over(order) - 1).alias("stamp"), F.col("px").alias("x"), F.col("py").alias("y"), "fwhm_science", "fwhm_reference")


def select_from_catalog(positions: DataFrame, science: DataFrame, reference: DataFrame, stamp_radius: int = 15, saturation: float = 0.0, fwhm_radius: int = 0) -> DataFrame:
    """Given positions (frame_id, stamp, x, y) with a clean footprint in both frames, and their widths there."""
    wide = fwhm_radius or max(5, stamp_radius // 2)
    points = positions.select("frame_id", F.col("stamp").alias("point"), F.col("x").alias("px"), F.col("y").alias("py"))
    out = points
    for name, px in (("science", science), ("reference", reference)):
        fine = pixels.footprint_ok(px, stamp_radius, saturation).where("footprint_ok").select("frame_id", F.col("x").alias("px"), F.col("y").alias("py"))
        out = out.join(fine, ["frame_id", "px", "py"], "left_semi")
    for name, px in (("science", science), ("reference", reference)):
        level = pixels.background(px).select("frame_id", F.col("median").alias("_level"))
        shifted = px.join(level, "frame_id").withColumn("value", F.col("value") - F.col("_level"))
        out = out.join(pixels.fwhm(out, shifted, wide).withColumnRenamed("fwhm", f"fwhm_{name}"), ["frame_id", "point"], "left")
    return out.select("frame_id", F.col("point").alias("stamp"), F.col("px").alias("x"), F.col("py").alias("y"), "fwhm_science", "fwhm_reference")
