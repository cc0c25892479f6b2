"""Synthetic star fields, injection and completeness."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels


def sample_starfield(shape: tuple[int, int], n: int, rng: np.random.Generator, flux_range=(500.0, 50000.0), slope: float = 2.0, border: int = 20, min_separation: float = 0.0) -> np.ndarray:
    """(n, 3) of x, y, flux: fluxes by a power law, places uniform and min_separation apart."""
    h, w = shape
    lo, hi, u = *flux_range, rng.random(n)
    flux = lo * (hi / lo) ** u if slope == 1 else (lo ** (1 - slope) + u * (hi ** (1 - slope) - lo ** (1 - slope))) ** (1 / (1 - slope))
    kept: list[np.ndarray] = []
    for _ in range(1000 * n):
        if len(kept) == n:
            break
        p = rng.uniform([border, border], [w - border, h - border])
        if not kept or min_separation <= 0 or ((np.array(kept) - p) ** 2).sum(axis=1).min() >= min_separation**2:
            kept.append(p)
    if len(kept) < n:
        raise ValueError("no room for so many stars at this separation")
    return np.column_stack([np.array(kept).reshape(-1, 2), flux])


def gaussian_psf(sigma: float, radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    psf = np.exp(-0.5 * (x * x + y * y) / sigma**2)
    return psf / psf.sum()


def render(stars: np.ndarray, shape: tuple[int, int], sigma: float) -> np.ndarray:
    """Gaussian stars of total flux, drawn within five sigma."""
    out = np.zeros(shape)
    r = int(np.ceil(5 * sigma))
    for x, y, flux in stars:
        cx, cy = int(round(x)), int(round(y))
        xs, ys = np.arange(max(0, cx - r), min(shape[1], cx + r + 1)), np.arange(max(0, cy - r), min(shape[0], cy + r + 1))
        if len(xs) and len(ys):
            out[np.ix_(ys, xs)] += flux / (2 * np.pi * sigma**2) * np.exp(-0.5 * ((ys[:, None] - y) ** 2 + (xs - x) ** 2) / sigma**2)
    return out


def render_stars(stars: DataFrame, sigma: float, width: int, height: int) -> DataFrame:
    """S12 as a table: (frame_id, y, x, value) of stars (frame_id, x, y, flux); each star spreads over its box, boxes add up."""
    r = int(np.ceil(5 * sigma))
    span = F.sequence(F.lit(-r), F.lit(r))
    at = stars.withColumnsRenamed({"x": "sx", "y": "sy"}).withColumn("_dy", F.explode(span)).withColumn("_dx", F.explode(span))
    at = at.withColumns({"y": (F.round("sy") + F.col("_dy")).cast("int"), "x": (F.round("sx") + F.col("_dx")).cast("int")})
    at = at.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    v = F.col("flux") / (2 * np.pi * sigma**2) * F.exp(-0.5 * ((F.col("y") - F.col("sy")) ** 2 + (F.col("x") - F.col("sx")) ** 2) / sigma**2)
    return at.groupBy("frame_id", "y", "x").agg(F.sum(v).alias("value"))


def inject(px: DataFrame, stars: DataFrame, sigma: float, width: int, height: int) -> DataFrame:
    """Px with the stars added."""
    more = render_stars(stars, sigma, width, height).withColumnRenamed("value", "_more")
    return px.join(more, ["frame_id", "y", "x"], "left").withColumn("value", (F.col("value") + F.coalesce("_more", F.lit(0.0))).cast("float")).drop("_more")


def peak_near(points: DataFrame, scores: DataFrame, radius: int = 3) -> DataFrame:
    """(frame_id, point, peak, peak_y, peak_x): the largest score (column value) within radius of each point and where it
    is, the first by rows if several."""
    v = F.col("value").cast("double")
    best = F.min_by(F.struct(v.alias("peak"), F.col("y").alias("peak_y"), F.col("x").alias("peak_x")), F.struct(-v, "y", "x"))
    found = pixels.boxed(points, scores, radius).where(pixels.finite(v)).groupBy("frame_id", "point").agg(best.alias("_best"))
    return found.select("frame_id", "point", "_best.*")


def completeness(points: DataFrame, scores: DataFrame, threshold: float = 5.0, radius: int = 3) -> DataFrame:
    """Points with `peak` and `recovered`: whether the score reaches the threshold near them."""
    near = peak_near(points, scores, radius).drop("peak_y", "peak_x")
    return points.join(near, ["frame_id", "point"], "left").withColumn("recovered", F.coalesce(F.col("peak") >= threshold, F.lit(False)))


def field_stats(values: DataFrame) -> DataFrame:
    """Deviation and mean magnitude of a field at points (frame_id, value)."""
    return values.groupBy("frame_id").agg(F.stddev_pop("value").alias("rms"), F.avg(F.abs("value")).alias("mean_abs"))


def make_pair(shape: tuple[int, int], seed: int = 0, n_stars: int = 50, sigmas=(1.6, 2.4), sky: float = 120.0, noise: float = 3.0, transients=(), flux_range=(2000.0, 30000.0), separation: float = 12.0):
    """(science, reference, stars): one field seen with two widths, and transients (x, y, flux) in science alone."""
    rng = np.random.default_rng(seed)
    stars = sample_starfield(shape, n_stars, rng, flux_range, border=20, min_separation=separation)
    reference = render(stars, shape, sigmas[0]) + sky + rng.normal(0, noise, shape)
    science = render(stars, shape, sigmas[1]) + sky + rng.normal(0, noise, shape)
    if len(transients):
        science += render(np.array(transients, float), shape, sigmas[1])
    return science, reference, stars


