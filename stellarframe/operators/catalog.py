"""Source catalogs: connected groups of significant pixels, summed up, flagged and compared with the point source."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pixels
from .schema import FWHM_PER_SIGMA, QUALITY_BITS

TILE = 256


@dataclass(frozen=True)
class Settings:
    """threshold and dipole_threshold in sigma; aperture_radius 0: three sigma of the expected width; bright_radius 0: three widths."""

    expected_fwhm: float = 3.0
    threshold: float = 5.0
    dipole_threshold: float = 3.0
    fwhm_lo: float = 0.3
    fwhm_hi: float = 3.0
    aperture_radius: int = 0
    exclude_bad: bool = True
    shape_tolerance: float = 3.0
    bright_radius: float = 0.0
    max_shape_fit: int = 5000

    def __post_init__(self):
        if not (self.expected_fwhm > 0 and self.threshold > 0 and self.dipole_threshold > 0):
            raise ValueError("the expected width and the thresholds must be positive")
        if self.fwhm_lo > self.fwhm_hi or self.aperture_radius < 0 or self.max_shape_fit < 0:
            raise ValueError("tolerances out of order or negative limits")

    @property
    def sigma(self) -> float:
        return self.expected_fwhm / FWHM_PER_SIGMA

    def width(self, df: DataFrame) -> Column:
        """The expected width: the frame's own where df has it as a column."""
        return F.col("expected_fwhm") if "expected_fwhm" in df.columns else F.lit(float(self.expected_fwhm))

    def aperture(self, df: DataFrame) -> Column:
        return F.lit(self.aperture_radius) if self.aperture_radius else F.greatest(F.lit(1), F.floor(3 * self.width(df) / FWHM_PER_SIGMA + 0.5).cast("int"))


class Union:
    """Sets of integers, each named by its smallest member."""

    def __init__(self):
        self._up: dict[int, int] = {}

    def root(self, a: int) -> int:
        path = []
        while (b := self._up.setdefault(a, a)) != a:
            path.append(a)
            a = b
        for p in path:
            self._up[p] = a
        return a

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self._up[b] = a

    def __iter__(self):
        return iter(list(self._up))


def label(seeds: DataFrame, size: int = TILE) -> DataFrame:
    """G1: seeds (frame_id, y, x, ...) with `label`, the smallest place (y, x) of their 8-connected group in its frame.

    Groups are found within tiles widened by a pixel; a pixel in several tiles ties their groups together. Only such ties,
    as many as seeds along tile borders, meet in one task for each frame.
    """
    place = F.col("y").cast("long") * (1 << 31) + F.col("x")
    near = lambda c: F.array_distinct(F.array(*(F.greatest(F.lit(0), F.floor((F.col(c) + d) / size).cast("int")) for d in (-1, 0, 1))))
    spread = seeds.select("frame_id", "y", "x", place.alias("place")).withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x")))

    def local(df: pd.DataFrame) -> pd.DataFrame:
        places = df.place.to_numpy()
        known, sets = set(places.tolist()), Union()
        for p in places.tolist():
            sets.root(p)
            for step in (1, (1 << 31) - 1, 1 << 31, (1 << 31) + 1):
                if p + step in known:
                    sets.join(p, p + step)
        return pd.DataFrame({"frame_id": df.frame_id, "place": places, "node": [sets.root(p) for p in places.tolist()]})

    nodes = spread.groupBy("frame_id", "ty", "tx").applyInPandas(local, "frame_id string, place long, node long")
    per = nodes.groupBy("frame_id", "place").agg(F.min("node").alias("node"), F.collect_set("node").alias("nodes"))

    def tie(df: pd.DataFrame) -> pd.DataFrame:
        sets = Union()
        for ns in df.nodes:
            for n in ns:
                sets.join(int(ns[0]), int(n))
        return pd.DataFrame([(df.frame_id.iloc[0], n, sets.root(n)) for n in sets], columns=["frame_id", "node", "root"])

    roots = per.where(F.size("nodes") > 1).select("frame_id", "nodes").distinct().groupBy("frame_id").applyInPandas(tie, "frame_id string, node long, root long")
    labelled = per.join(roots, ["frame_id", "node"], "left").select("frame_id", "place", F.coalesce("root", "node").alias("label"))
    return seeds.withColumn("place", place).join(labelled, ["frame_id", "place"]).drop("place")


def touching(labelled: DataFrame, opposite: DataFrame) -> DataFrame:
    """(frame_id, label) of groups with a seed of the other sign among a pixel's nine places."""
    step = F.sequence(F.lit(-1), F.lit(1))
    around = opposite.select("frame_id", "y", "x").withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step))
    around = around.select("frame_id", (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x"))
    return labelled.join(around, ["frame_id", "y", "x"], "left_semi").select("frame_id", "label").distinct()


def summarise(labelled: DataFrame, px: DataFrame, settings: Settings, polarity: int = 1, widths: DataFrame | None = None) -> DataFrame:
    """A row for each group. px: (frame_id, y, x, value, variance, mask) with the difference as value.

    widths: (frame_id, expected_fwhm), in place of the settings' width for the frames that it has.
    """
    s = F.col("score").cast("double")
    w = F.abs(s)
    peak = F.min_by(F.struct(F.col("x").alias("peak_x"), F.col("y").alias("peak_y"), s.alias("peak_snr")), F.struct(-w, F.col("y"), F.col("x")))
    first = lambda c: F.min_by(F.col(c).cast("double"), F.struct("y", "x"))
    groups = labelled.groupBy("frame_id", "label").agg(F.count(F.lit(1)).cast("int").alias("n_pix"), F.sum(w).alias("_s"), F.sum(w * F.col("x")).alias("_sx"), F.sum(w * F.col("y")).alias("_sy"), first("x").alias("_fx"), first("y").alias("_fy"), peak.alias("_peak"))
    centre = lambda c: F.coalesce(F.try_divide(F.col(f"_s{c}"), F.when(F.col("_s") > 0, F.col("_s"))), F.col(f"_f{c}"))
    groups = groups.withColumns({"x": centre("x"), "y": centre("y")}).select("frame_id", "label", "x", "y", "_peak.*", "n_pix")
    if widths is not None:
        groups = groups.join(widths, "frame_id", "left").withColumn("expected_fwhm", F.coalesce("expected_fwhm", F.lit(float(settings.expected_fwhm))))
    # bits of the group and its neighbours
    step = F.sequence(F.lit(-1), F.lit(1))
    ring = labelled.select("frame_id", "label", "y", "x").withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step))
    ring = ring.select("frame_id", "label", (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x")).distinct()
    bits = ring.join(px.where(F.col("mask") != 0).select("frame_id", "y", "x", "mask"), ["frame_id", "y", "x"]).groupBy("frame_id", "label").agg(F.bit_or("mask").alias("mask_flags"))
    points = groups.select("frame_id", F.col("label").alias("point"), F.round("x").cast("int").alias("px"), F.round("y").cast("int").alias("py"), settings.aperture(groups).alias("_aperture"))
    flux = pixels.aperture_flux(points, px, "_aperture").withColumnRenamed("point", "label")
    out = groups.join(bits, ["frame_id", "label"], "left").join(flux, ["frame_id", "label"], "left")
    return flagged(out.withColumns({"mask_flags": F.coalesce("mask_flags", F.lit(0)).cast("smallint"), "flux": F.coalesce("flux", F.lit(0.0))}), settings, polarity)


def flagged(groups: DataFrame, settings: Settings, polarity: int = 1) -> DataFrame:
    """How many pixels a point source with this peak would have above the threshold, and whether the group has about as many."""
    threshold = settings.threshold if polarity > 0 else settings.dipole_threshold
    ratio = F.abs("peak_snr") / threshold
    expected = math.pi * (settings.width(groups) / FWHM_PER_SIGMA) ** 2 * F.greatest(F.lit(0.0), F.when(ratio > 0, F.log(ratio * ratio)).otherwise(0.0))
    out = groups.withColumn("expected_n_pix", expected)
    out = out.withColumn("fwhm_ratio", F.when(F.col("expected_n_pix") > 0, F.try_divide(F.col("n_pix"), F.col("expected_n_pix"))).otherwise(F.lit(float("inf"))))
    return out.withColumn("fwhm_consistent", F.col("fwhm_ratio").between(settings.fwhm_lo, settings.fwhm_hi))


def psf_fit(points: DataFrame, px: DataFrame, psf: DataFrame | np.ndarray) -> DataFrame:
    """(frame_id, point, psf_amplitude, psf_amplitude_err, psf_chi2, psf_chi2_dof): the best multiple of the point source.

    psf: (frame_id, psf) or one array for all. Pixels that are masked, not finite or without positive variance don't count;
    with fewer than three there is no fit and no row.
    """
    if isinstance(psf, DataFrame):
        table = psf.select("frame_id", F.posexplode("psf").alias("_i", "p"), F.sqrt(F.size("psf")).cast("int").alias("_side"))
    else:
        side = int(round(math.sqrt(np.size(psf))))
        taps = F.array(*(F.lit(float(p)) for p in np.ravel(psf)))
        table = points.select("frame_id").distinct().select("frame_id", F.posexplode(taps).alias("_i", "p"), F.lit(side).alias("_side"))
    taps = table.select("frame_id", "p", (F.floor(F.col("_i") / F.col("_side")) - F.floor(F.col("_side") / 2)).cast("int").alias("dy"), (F.pmod("_i", "_side") - F.floor(F.col("_side") / 2)).cast("int").alias("dx"))
    at = points.join(taps, "frame_id").withColumns({"y": F.col("py") + F.col("dy"), "x": F.col("px") + F.col("dx")})
    d, v = F.col("value").cast("double"), F.col("variance").cast("double")
    met = at.join(px.select("frame_id", "y", "x", "value", "variance", "mask"), ["frame_id", "y", "x"]).where(pixels.good(F.col("value"), F.col("mask")) & pixels.positive_variance(F.col("variance")))
    sums = met.groupBy("frame_id", "point").agg(F.sum(d * F.col("p") / v).alias("dp"), F.sum(F.col("p") * F.col("p") / v).alias("pp"), F.sum(d * d / v).alias("dd"), F.count(F.lit(1)).cast("int").alias("n"))
    fit = sums.where((F.col("n") >= 3) & (F.col("pp") > 0))
    amplitude = F.col("dp") / F.col("pp")
    chi2 = met.join(fit.select("frame_id", "point", amplitude.alias("a")), ["frame_id", "point"]).groupBy("frame_id", "point").agg(F.sum((d - F.col("a") * F.col("p")) ** 2 / v).alias("psf_chi2"))
    return fit.join(chi2, ["frame_id", "point"]).select("frame_id", "point", amplitude.alias("psf_amplitude"), F.sqrt(1 / F.col("pp")).alias("psf_amplitude_err"), "psf_chi2", (F.col("n") - 1).alias("psf_chi2_dof"))


def enrich(entries: DataFrame, px: DataFrame, settings: Settings, psf=None, bright: DataFrame | None = None) -> DataFrame:
    """Shape and bright-star columns; frames with over max_shape_fit entries keep the defaults."""
    count = entries.groupBy("frame_id").agg((F.count(F.lit(1)) <= settings.max_shape_fit).alias("_few"))
    out = entries.join(count, "frame_id")
    points = out.where("_few").select("frame_id", F.col("label").alias("point"), F.round("x").cast("int").alias("px"), F.round("y").cast("int").alias("py"), "x", "y")
    nan = F.lit(float("nan"))
    if psf is not None:
        out = out.join(psf_fit(points.select("frame_id", "point", "px", "py"), px, psf).withColumnRenamed("point", "label"), ["frame_id", "label"], "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("psf_amplitude", "psf_amplitude_err", "psf_chi2", "psf_chi2_dof")})
    good_shape = F.coalesce(F.when(F.col("psf_chi2_dof") > 0, F.try_divide(F.col("psf_chi2"), F.col("psf_chi2_dof")) <= settings.shape_tolerance), F.lit(True))
    out = out.withColumn("shape_consistent", good_shape)
    out = out.withColumns({c: F.coalesce(c, nan) for c in ("psf_amplitude", "psf_amplitude_err", "psf_chi2")} | {"psf_chi2_dof": F.coalesce("psf_chi2_dof", F.lit(0)).cast("int")})
    if bright is not None:
        exact = points.select("frame_id", "point", F.col("x").alias("px"), F.col("y").alias("py"))
        dist = pixels.nearest_bright(exact, bright).select("frame_id", F.col("point").alias("label"), "bright_star_dist")
        out = out.join(dist, ["frame_id", "label"], "left")
    else:
        out = out.withColumn("bright_star_dist", F.lit(float("inf")))
    out = out.withColumn("bright_star_dist", F.coalesce("bright_star_dist", F.lit(float("inf"))))
    return out.withColumn("near_bright_star", F.col("bright_star_dist") <= (settings.bright_radius or 3 * settings.width(out))).drop("_few", "expected_fwhm")


def with_quality(entries: DataFrame) -> DataFrame:
    """P19."""
    flags = {"fwhm": ~F.col("fwhm_consistent"), "dipole": F.col("is_dipole"), "masked": F.col("mask_flags") != 0, "shape": ~F.col("shape_consistent"), "near_bright": F.col("near_bright_star")}
    bits = None
    for name, on in flags.items():
        bit = F.when(on, QUALITY_BITS[name]).otherwise(0)
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return entries.withColumn("quality", bits.cast("smallint"))


def build(scores: DataFrame, settings: Settings = Settings(), polarity: str = "positive", psf=None, bright: DataFrame | None = None, widths: DataFrame | None = None) -> DataFrame:
    """The catalog of all frames. scores: (frame_id, y, x, value, variance, mask, score), value being the difference.

    polarity: positive, negative or both; both adds `sign`. Negative groups are seeded at the dipole threshold and
    dipoles are groups that touch a seed of the other sign. psf turns on the shape fit, bright (frame_id, px, py) the
    distance to bright stars, widths (frame_id, expected_fwhm) each frame its own expected width.
    """
    if polarity not in ("positive", "negative", "both"):
        raise ValueError("polarity must be positive, negative or both")
    px = scores.select("frame_id", "y", "x", "value", "variance", "mask")
    seed = {p: pixels.cut(pixels.seeds(scores, settings.threshold if p > 0 else settings.dipole_threshold, p, settings.exclude_bad)) for p in (1, -1)}  # few, and read often

    def one(sign: int) -> DataFrame:
        labelled = pixels.cut(label(seed[sign]))
        entries = summarise(labelled, px, settings, sign, widths)
        dipoles = touching(labelled, seed[-sign]).withColumn("is_dipole", F.lit(True))
        entries = pixels.cut(entries.join(dipoles, ["frame_id", "label"], "left").withColumn("is_dipole", F.coalesce("is_dipole", F.lit(False))))
        out = with_quality(enrich(entries, px, settings, psf, bright))
        return out.select(
            "frame_id", "x", "y", "peak_x", "peak_y", "peak_snr", "n_pix", "flux", "expected_n_pix", "fwhm_ratio", "fwhm_consistent", "mask_flags", "is_dipole", "psf_chi2", "psf_chi2_dof",
            "psf_amplitude", "psf_amplitude_err", "shape_consistent", "bright_star_dist", "near_bright_star", "quality",
        )

    if polarity != "both":
        return one(1 if polarity == "positive" else -1)
    return one(1).withColumn("sign", F.lit(1).cast("tinyint")).unionByName(one(-1).withColumn("sign", F.lit(-1).cast("tinyint")))
