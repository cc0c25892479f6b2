"""The difference engine: fit on pairs of frames, subtract, whiten, score and catalog, for one pair or very many at once."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, detect, fit, noise, pixels, subtract, tiles
from ..operators.pixels import cut
from ..operators.schema import FWHM_PER_SIGMA
from ..sources import fits
from . import provenance

log = logging.getLogger("stellarframe")

LAYERS = [f"{p}_{c}" for p in ("s", "r") for c in ("value", "variance", "mask")]


def configure_logging(verbosity: int = 1) -> None:
    """0 warnings, 1 stages, 2 details."""
    logging.basicConfig()
    log.setLevel({0: logging.WARNING, 1: logging.INFO}.get(verbosity, logging.DEBUG))


@contextmanager
def timed(stage: str, into: dict | None = None):
    """The seconds of a stage, to the log and to `into`."""
    began = time.perf_counter()
    yield
    took = time.perf_counter() - began
    log.info("%s: %.2f s", stage, took)
    if into is not None:
        into[stage] = into.get(stage, 0.0) + took


def default_beta(fwhm_a, fwhm_b):
    """P20 as a column: 0.8 of the width that broadens one star to the other, at least half a pixel; 2 if no width is known."""
    a, b = (F.when(pixels.finite(F.col(c)) & (F.col(c) > 0), F.col(c)) for c in (fwhm_a, fwhm_b))
    wide, narrow = F.greatest(a, b) / FWHM_PER_SIGMA, F.least(a, b) / FWHM_PER_SIGMA
    return F.when(wide.isNull(), 2.0).otherwise(F.greatest(0.8 * F.sqrt(F.greatest(wide * wide - narrow * narrow, F.lit(0.0))), F.lit(0.5)))


@dataclass
class Result:
    """Lazy tables of all pairs: difference tiles (value, variance, mask), score tiles, solutions, psf, catalog and scales."""

    difference: DataFrame
    solutions: DataFrame
    score: DataFrame | None = None
    psf: DataFrame | None = None
    source_catalog: DataFrame | None = None
    variance_scale: DataFrame | None = None
    config: dict = field(default_factory=dict)
    elapsed: dict = field(default_factory=dict)

    def scored_pixels(self) -> DataFrame:
        if self.score is None:
            raise ValueError("no score: make the engine with score=True")
        """(frame_id, y, x, value, variance, mask, score): tiles meet first, then they are spread."""
        both = self.difference.join(self.score.select("frame_id", "ty", "tx", "score"), ["frame_id", "ty", "tx"])
        return tiles.to_pixels(both, ["value", "variance", "mask", "score"])

    def build_catalog(self, settings: catalog.Settings | None = None, polarity: str = "positive", fit_psf_shape: bool = False, bright: DataFrame | None = None) -> DataFrame:
        """The catalog anew with other settings; bright stars are the fit's stamps unless given. Without settings each frame
        expects the width of its own point source."""
        if self.psf is None:
            raise ValueError("no point source: make the engine with score=True")
        widths = noise.widths(self.psf) if settings is None else None
        settings = settings or catalog.Settings()
        if bright is None:
            bright = self.solutions.select("frame_id", F.explode(F.arrays_zip("stamp_x", "stamp_y")).alias("s")).select("frame_id", F.col("s.stamp_x").alias("px"), F.col("s.stamp_y").alias("py"))
        return catalog.build(self.scored_pixels(), settings, polarity, self.psf if fit_psf_shape else None, bright, widths)

    def cards(self) -> dict[str, str]:
        """Configuration and environment as header cards."""
        return {f"CFG_{k.upper()}": str(v) for k, v in self.config.items()} | provenance.environment()

    def fit_cards(self) -> DataFrame:
        """(frame_id, cards): each pair's fit as header cards."""
        told = {"DIRECT": "direction", "BETA": "beta", "NMAX": "n_max", "KRADIUS": "radius", "NCOMP": "n_components", "NKNOTS": "n_spatial", "LAMBDA": "lam", "DOF": "effective_dof", "CHI2": "reduced_chi2", "NSTAMPS": "n_stamps_used", "NREJECT": "n_stamps_rejected", "NPIXELS": "n_pixels"}
        return self.solutions.select("frame_id", F.create_map(*(x for k, c in told.items() for x in (F.lit(k), F.col(c).cast("string")))).alias("cards"))

    def table(self, frame_id: str | None = None, arrow: bool = False):
        """The catalog, of one frame or of all, as a pandas or an Arrow table on the driver."""
        if self.source_catalog is None:
            raise ValueError("no catalog: make the engine with score=True and source_catalog=True")
        rows = self.source_catalog if frame_id is None else self.source_catalog.where(F.col("frame_id") == frame_id)
        return rows.toArrow() if arrow else rows.toPandas()

    def to_fits(self, extra_cards: dict | None = None) -> DataFrame:
        """(frame_id, content): a FITS file of each pair: the difference, its VARIANCE and MASK, SCORE and CATALOG, and the cards."""
        layers = self.difference.select(*tiles.HEAD, "value", "variance", "mask")
        if self.score is not None:
            layers = layers.join(self.score.select("frame_id", "ty", "tx", "score"), ["frame_id", "ty", "tx"], "left")
        more = F.create_map(*(F.lit(x) for kv in (provenance.environment() | (extra_cards or {})).items() for x in map(str, kv)))
        return fits.encoded(layers, self.fit_cards().select("frame_id", F.map_concat("cards", more).alias("cards")), self.source_catalog)

    def write(self, path: str, mode: str = "errorifexists", extra_cards: dict | None = None) -> None:
        """A Parquet table for each layer and a table of cards."""
        spark = self.difference.sparkSession
        for name in ("difference", "solutions", "score", "psf", "source_catalog"):
            if (df := getattr(self, name)) is not None:
                df.write.mode(mode).parquet(f"{path}/{name}")
        spark.createDataFrame([(self.cards() | (extra_cards or {}),)], "cards map<string,string>").write.mode(mode).parquet(f"{path}/cards")


@dataclass
class Subtractor:
    """O1: settings of the engine; zeros and None mean defaults, as the operators say."""

    n_max: int = 6
    beta: float | None = None
    n_knots: int = 5
    radius: int = 0
    stamp_radius: int = 15
    threshold_sigma: float = 5.0
    max_stamps: int = 200
    saturation: float = 0.0
    match_radius: int = 2
    fwhm_radius: int = 0
    bright_mask: float = 0.0
    lambda_grid: tuple = tuple(np.logspace(-6, 6, 25))
    clip_sigma: float = 4.0
    clip_iterations: int = 5
    min_stamps: int = 5
    cv_folds: int = 5
    spatial_scale: float | None = None
    decorrelate: bool = False
    score: bool = False
    source_catalog: bool = True
    block: int = 256
    rescale_variance: bool = False
    tile: int = tiles.SIZE

    # ---- the parts ----

    def _side(self, pair: DataFrame, p: str) -> DataFrame:
        return pair.select(*tiles.HEAD, *(F.col(f"{p}_{c}").alias(c) for c in ("value", "variance", "mask")))

    def select(self, pair: DataFrame, positions: DataFrame | None = None) -> DataFrame:
        """Stamps that both frames share, or of given positions (frame_id, stamp, x, y)."""
        sides = [self._side(pair, p) for p in ("s", "r")]
        if positions is not None:
            s, r = (tiles.to_pixels(side, ["value", "variance", "mask"]) for side in sides)
            return detect.select_from_catalog(positions, s, r, self.stamp_radius, self.saturation, self.fwhm_radius)
        found = [detect.detect_stamps(side, None, self.stamp_radius, self.threshold_sigma, self.max_stamps, self.saturation, 0, 0, self.fwhm_radius, self.tile) for side in sides]
        return detect.select_stamps(found[0], found[1], self.match_radius)

    def oriented(self, pair: DataFrame, direction: DataFrame) -> DataFrame:
        """Target and convolved layers of each pair by its direction (frame_id, direction)."""
        out = pair.join(direction.select("frame_id", "direction"), "frame_id")
        flip = F.col("direction") == "science"
        for c in ("value", "variance", "mask"):
            out = out.withColumns({f"t_{c}": F.when(flip, F.col(f"r_{c}")).otherwise(F.col(f"s_{c}")), f"c_{c}": F.when(flip, F.col(f"s_{c}")).otherwise(F.col(f"r_{c}"))})
        return out.drop("direction", *LAYERS)

    @staticmethod
    def fill(oriented: DataFrame) -> DataFrame:
        """A4: (frame_id, fill)."""
        return tiles.median_at(oriented.select(*tiles.HEAD, F.col("c_value").alias("value"), F.col("c_mask").alias("mask")))

    # ---- O2 ----

    def fit(self, pair: DataFrame, positions: DataFrame | None = None, direction: str | None = None) -> DataFrame:
        """The solutions of all pairs. pair: tiles with LAYERS (s_ science, r_ reference)."""
        if direction not in (None, "science", "reference"):
            raise ValueError("direction must be science, reference or None")
        stamps = cut(self.select(pair, positions))  # bounded by max_stamps for each frame
        told = detect.summary(stamps)
        if direction:
            told = told.withColumn("direction", F.lit(direction))
        told = told.withColumn("beta", F.lit(float(self.beta)) if self.beta else default_beta("median_fwhm_science", "median_fwhm_reference"))
        auto = F.greatest(F.ceil(3 * F.col("beta") * float(np.sqrt(self.n_max + 1))).cast("int"), F.lit(3))
        told = told.withColumn("radius", F.lit(self.radius) if self.radius else auto).select("frame_id", "beta", "radius", "direction")
        frames = pair.select("frame_id", "width", "height").distinct().join(told, "frame_id")
        oriented = self.oriented(pair, told)
        with_fill = stamps.join(told.select("frame_id", "beta", "radius"), "frame_id").join(self.fill(oriented), "frame_id")
        rows = fit.stamp_pixels(oriented, with_fill.select("frame_id", "stamp", "x", "y", "beta", "radius", "fill"), self.stamp_radius, self.n_max, self.tile)
        clip = {"clip_sigma": self.clip_sigma, "clip_iterations": self.clip_iterations, "min_stamps": self.min_stamps, "cv_folds": self.cv_folds}
        return fit.fit_kernels(rows, frames, self.n_max, list(self.lambda_grid), self.stamp_radius, self.n_knots, self.spatial_scale, **clip)

    def apply(self, solutions: DataFrame, pair: DataFrame) -> Result:
        """Frozen solutions on pairs of the same frame_id; a pair without a solution of its shape has no result."""
        fitting = pair.join(solutions.select("frame_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "frame_id").where((F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h"))).drop("_w", "_h")
        oriented = cut(self.oriented(fitting, solutions))  # read by every step below
        levels = [v for v in (self.saturation, self.bright_mask) if v and v > 0]  # P23
        # the median that fills bad pixels needs the whole frame first: cut there rather than make the tiles twice
        raw = cut(subtract.differences(oriented, solutions, self.fill(oriented), min(levels, default=0.0), self.tile))
        diff = subtract.resolve(raw)
        sign = F.when(F.col("direction") == "science", -1.0).otherwise(1.0).cast("float")  # P21
        diff = diff.join(solutions.select("frame_id", "direction"), "frame_id").withColumn("_sign", sign)
        diff = diff.withColumn("value", F.transform("value", lambda v: v * F.col("_sign"))).drop("_sign", "direction")
        scale = None
        if self.rescale_variance:
            scale = pixels.variance_rescale(tiles.to_pixels(diff.where("variance is not null"), ["value", "variance", "mask"]))
            diff = diff.join(scale, "frame_id", "left").withColumn("_k", F.coalesce("scale", F.lit(1.0)).cast("float")).withColumn("variance", F.transform("variance", lambda v: v * F.col("_k"))).drop("_k", "scale")
        model = solutions.select("frame_id", *subtract.MODEL)
        noisy = oriented.select("frame_id", "ty", "tx", "t_variance", "c_variance")
        both = diff.select(*tiles.HEAD, "value").join(noisy, ["frame_id", "ty", "tx"]).where("t_variance is not null and c_variance is not null").join(model, "frame_id")
        if self.decorrelate:
            white = cut(noise.decorrelate(both, self.block, self.tile)).select("frame_id", "ty", "tx", F.col("value").alias("_v"), F.col("variance").alias("_var"))
            if scale is not None:
                white = white.join(scale, "frame_id", "left").withColumn("_k", F.coalesce("scale", F.lit(1.0)).cast("float")).withColumn("_var", F.transform("_var", lambda v: v * F.col("_k"))).drop("_k", "scale")
            diff = diff.join(white, ["frame_id", "ty", "tx"], "left").withColumns({"value": F.coalesce("_v", "value"), "variance": F.coalesce("_var", "variance")}).drop("_v", "_var")
        diff = cut(diff)  # score and catalog read it again
        result = Result(diff, solutions, variance_scale=scale, config={f.name: getattr(self, f.name) for f in fields(self)})
        if not self.score:
            return result
        radius = min(self.stamp_radius, 8)
        stamps = solutions.select("frame_id", F.posexplode(F.arrays_zip("stamp_x", "stamp_y")).alias("stamp", "s")).select("frame_id", "stamp", F.col("s.stamp_x").alias("x"), F.col("s.stamp_y").alias("y"))
        psf = noise.estimate_psf(oriented, stamps, radius, "t_value", self.tile)
        if self.decorrelate:
            white = noise.whiten_score_psf(both.join(psf, "frame_id"), self.block, self.tile).withColumnRenamed("psf", "_white")
            psf = psf.join(white, "frame_id", "left").select("frame_id", F.coalesce("_white", "psf").alias("psf"))
        spread = tiles.to_pixels(diff.where("variance is null"), ["value"]).groupBy("frame_id").agg(F.var_pop("value").cast("float").alias("_spread"))
        known = diff.join(spread, "frame_id", "left").withColumn("variance", F.coalesce("variance", F.transform("value", lambda v: F.col("_spread")))).drop("_spread")
        psf = cut(psf)
        score = cut(tiles.matched_filter(known.join(psf, "frame_id"), "psf", self.tile, radius))
        result = replace(result, score=score, psf=psf)
        return replace(result, source_catalog=result.build_catalog()) if self.source_catalog else result

    def subtract(self, pair: DataFrame, positions: DataFrame | None = None, direction: str | None = None) -> Result:
        """Fit, then apply."""
        took: dict = {}
        with timed("fit", took):
            solutions = cut(self.fit(pair, positions, direction))
        out = self.apply(solutions, pair)
        out.elapsed = took
        return out


_KEYS = {f.name for f in fields(Subtractor)}


def _split(kw: dict) -> tuple[Subtractor, dict]:
    return Subtractor(**{k: v for k, v in kw.items() if k in _KEYS}), {k: v for k, v in kw.items() if k not in _KEYS}


def subtract_pairs(pair: DataFrame, **kw) -> Result:
    """O3: one call; keywords go to Subtractor or to its subtract()."""
    engine, rest = _split(kw)
    return engine.subtract(pair, **rest)


def apply_solutions(solutions: DataFrame, pair: DataFrame, **kw) -> Result:
    engine, rest = _split(kw)
    return engine.apply(solutions, pair, **rest)


def load_solutions(spark, path: str) -> DataFrame:
    """S6."""
    return spark.read.parquet(path)


def save_solutions(solutions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S5."""
    solutions.write.mode(mode).parquet(path)
