"""Registered queries of the library and their SQL forms.

The driver's tables hold no images, so `embeddings` stands for one: y is vec_id, x the place in the vector. Masks, variances
and a second frame follow from that by the rules below, in Spark and in SQL alike.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basis import Basis
from ..functions.solve import Normal, solve_at
from ..functions.spline import Spline, evaluate, grid_knots
from ..operators import catalog, detect, noise, pixels, subtract, synth, tiles
from ..operators.schema import FWHM_PER_SIGMA, MAD_TO_SIGMA, MEDIAN_CHI2_1

WIDTH = 64
#: A smoothing kernel for the queries: a sampled Gauss-Hermite function of order 0, rounded so that SQL has the same numbers.
TAPS = [round(float(t), 6) for t in Basis(1.2, 0, 3).rows[0]]
PSF = [[round(float(v), 6) for v in row] for row in synth.gaussian_psf(1.3, 2)]
SETTINGS = catalog.Settings(expected_fwhm=2.0, threshold=3.0, dipole_threshold=2.5, aperture_radius=2)


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image of the embeddings: value v, mask, variance 0.5 + v^2."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit("e").alias("frame_id"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    at = F.col("y") * WIDTH + F.col("x")
    v = F.col("v").cast("double")
    mask = F.when(F.pmod(at, F.lit(97)) == 0, 1).when(F.pmod(at, F.lit(211)) == 0, 4).otherwise(0).cast("smallint")
    return e.select("frame_id", "y", "x", v.alias("value"), (0.5 + v * v).alias("variance"), mask.alias("mask"))


def second(px: DataFrame) -> DataFrame:
    """Another frame of the same sky: 0.9 v + 0.1 of the pixel before."""
    before = F.coalesce(F.lag("value").over(pixels.along_row()), F.lit(0.0))
    return px.withColumn("value", 0.9 * F.col("value") + 0.1 * before)


def scored(px: DataFrame) -> DataFrame:
    """Scores: the value over a fixed deviation, in single precision."""
    return px.withColumn("score", (F.col("value") / 0.06).cast("float"))


FRAME = f"""e AS (SELECT CAST(vec_id AS INT) AS y, embedding, unnest(generate_series(1, {WIDTH})) AS i FROM embeddings),
px AS (SELECT y, CAST(i - 1 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v,
  CASE WHEN (y * {WIDTH} + i - 1) % 97 = 0 THEN 1 WHEN (y * {WIDTH} + i - 1) % 211 = 0 THEN 4 ELSE 0 END AS mask,
  0.5 + CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE) AS variance FROM e),
dims AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM px)"""
SECOND = "px2 AS (SELECT y, x, 0.9 * v + 0.1 * coalesce(lag(v) OVER (PARTITION BY y ORDER BY x), 0) AS v, mask, variance FROM px)"
SCORED = "sc AS (SELECT *, CAST(v / 0.06 AS FLOAT) AS score FROM px)"

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _register(sql: str | None):
    """Make a function of (frame, spark, sf_dir) a query; sql goes after the frame's common table expressions."""

    def put(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(frame(spark, sf_dir), spark, sf_dir)

        query.__name__, query.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = query
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {FRAME}{sql}" if sql.startswith(",") else f"WITH RECURSIVE {FRAME} {sql}"
        return f

    return put


def _round(df: DataFrame, digits: int = 6, keep: tuple = ()) -> DataFrame:
    """Doubles to so many digits: sums depend on the order of rows in their last ones."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def _upper(v: str) -> str:
    return f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {v} DESC)"


def _conv(v: str, over: str) -> str:
    half = len(TAPS) // 2
    return " + ".join(f"{k!r} * coalesce({v if half == j else (f'lead({v}, {half - j})' if half > j else f'lag({v}, {j - half})') + f' OVER ({over})'}, 0)" for j, k in enumerate(TAPS))


ROW, COL = "PARTITION BY y ORDER BY x", "PARTITION BY x ORDER BY y"
SMOOTH = f", cx AS (SELECT *, {_conv('v', ROW)} AS a FROM px), sm AS (SELECT y, x, v, mask, variance, {_conv('a', COL)} AS s FROM cx)"


@_register("SELECT round(sum(v / variance) / sum(1 / variance), 6) AS mean FROM px WHERE mask = 0")
def weighted_mean(px, spark, sf_dir):
    return _round(pixels.weighted_mean(px).select("mean"))


BACKGROUND = f""", step AS (SELECT greatest(1, w * h // 262144) AS k, w FROM dims), used AS (SELECT v FROM px, step WHERE mask = 0 AND (CAST(y AS BIGINT) * w + x) % k = 0),
med AS (SELECT {_upper('v')} AS m FROM used), bg AS (SELECT m, {MAD_TO_SIGMA} * {_upper('abs(v - m)')} AS s FROM used, med GROUP BY m)"""


@_register(f"{BACKGROUND} SELECT round(m, 6) AS median, round(s, 6) AS sigma FROM bg")
def background(px, spark, sf_dir):
    return _round(pixels.background(px).select("median", "sigma"))


@_register(f"SELECT round({_upper('v')}, 6) AS fill FROM px, dims WHERE mask = 0 AND (CAST(y AS BIGINT) * w + x) % 7 = 0")
def fill_value(px, spark, sf_dir):
    return _round(pixels.fill_value(px).select("fill"))


@_register("SELECT y, x, round(greatest(v, 0) / 1.5 + 0.25, 6) AS variance FROM px")
def synth_variance(px, spark, sf_dir):
    return _round(pixels.synth_variance(px, 1.5, 0.5).select("y", "x", "variance"))


@_register("SELECT y, x, v AS value FROM px WHERE mask = 0")
def good_pixels(px, spark, sf_dir):
    return pixels.good_pixels(px).select("y", "x", "value")


@_register(f"SELECT y, x, round({_conv('v', ROW)}, 6) AS value FROM px")
def conv_x(px, spark, sf_dir):
    return _round(pixels.convolve_x(px, TAPS).select("y", "x", "value"))


@_register(f"SELECT y, x, round({_conv('v', COL)}, 6) AS value FROM px")
def conv_y(px, spark, sf_dir):
    return _round(pixels.convolve_y(px, TAPS).select("y", "x", "value"))


@_register(f"{SMOOTH} SELECT y, x, round(s, 6) AS value FROM sm")
def conv_separable(px, spark, sf_dir):
    return _round(pixels.convolve_separable(px, TAPS, TAPS).select("y", "x", "value"))


@_register(", a AS (SELECT y, x, bit_or(mask) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS b FROM px) SELECT y, x, CAST(bit_or(b) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS SMALLINT) AS mask FROM a")
def dilate_mask(px, spark, sf_dir):
    return pixels.dilate(px, 2).select("y", "x", "mask")


def _footprint(r: int, bad: str = "mask <> 0") -> str:
    return f""", f1 AS (SELECT y, x, max(CASE WHEN {bad} THEN 1 ELSE 0 END) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS b FROM px),
fp AS (SELECT y, x, max(b) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) = 0 AND x >= {r} AND x < w - {r} AND y >= {r} AND y < h - {r} AS ok FROM f1, dims)"""


@_register(f"{_footprint(2, 'mask <> 0 OR v >= 0.3')} SELECT y, x, ok AS footprint_ok FROM fp")
def footprint_ok(px, spark, sf_dir):
    return pixels.footprint_ok(px, 2, 0.3).select("y", "x", "footprint_ok")


def _peaks(table: str, v: str) -> str:
    return f""", p1 AS (SELECT y, x, {v} AS v, max({v}) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t FROM {table}),
pk AS (SELECT y, x, v, v >= max(t) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM p1)"""


@_register(f"{_peaks('px', 'v')} SELECT y, x, v AS value FROM pk WHERE top AND v > 0.1")
def local_maxima(px, spark, sf_dir):
    return pixels.local_maxima(px, 0.1).where("is_peak").select("y", "x", "value")


@_register("SELECT y, x, v AS value FROM px, dims WHERE x >= 5 AND x < w - 5 AND y >= 5 AND y < h - 5")
def border_exclusion(px, spark, sf_dir):
    return pixels.inside(px, 5).select("y", "x", "value")


@_register(f"{SMOOTH}{BACKGROUND}{_footprint(1)}{_peaks('sm', 's')} SELECT pk.y, pk.x, round(pk.v - m, 6) AS flux FROM pk JOIN fp USING (y, x), bg WHERE top AND ok AND pk.v > m + 2 * s ORDER BY pk.v DESC, y, x LIMIT 100")
def detect_topk(px, spark, sf_dir):
    """The brightest hundred local maxima of the smoothed frame, away from bad pixels."""
    level = pixels.background(px)
    wide = pixels.footprint_ok(pixels.convolve_separable(px, TAPS, TAPS, out="smooth"), 1).join(F.broadcast(level), "frame_id")
    peaks = pixels.local_maxima(wide, F.col("median") + 2 * F.col("sigma"), "smooth").where("is_peak and footprint_ok")
    return _round(peaks.orderBy(F.desc("smooth"), "y", "x").limit(100).select("y", "x", (F.col("smooth") - F.col("median")).alias("flux")))


def _points(px: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Bright local maxima as points."""
    return pixels.local_maxima(px, threshold).where("is_peak").select("frame_id", F.struct("y", "x").alias("point"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("value").alias("flux"))


POINTS = f"{_peaks('px', 'v')}, pt AS (SELECT y, x, v FROM pk WHERE top AND v > 0.25)"


@_register(f""", {SECOND}{POINTS}, q1 AS (SELECT y, x, v, max(v) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t FROM px2),
q AS (SELECT y, x, v, v >= max(t) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM q1),
m AS (SELECT pt.y, pt.x, q.y AS sy, q.x AS sx, (pt.x - q.x) * (pt.x - q.x) + (pt.y - q.y) * (pt.y - q.y) AS d2, q.v FROM pt JOIN q ON q.top AND q.v > 0.2 AND abs(pt.x - q.x) <= 2 AND abs(pt.y - q.y) <= 2)
SELECT y, x, sy, sx, CAST(d2 AS BIGINT) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY d2, v DESC, sy, sx) AS n FROM m WHERE d2 <= 4) WHERE n = 1""")
def cross_match(px, spark, sf_dir):
    met = pixels.cross_match(_points(px), _points(second(px), 0.2), 2)
    return met.select(F.col("py").alias("y"), F.col("px").alias("x"), F.col("s_point.y").alias("sy"), F.col("s_point.x").alias("sx"), "d2")


def _box(r: int, disc: bool = False) -> str:
    inside = f" AND (p.x - pt.x) * (p.x - pt.x) + (p.y - pt.y) * (p.y - pt.y) <= {r * r}" if disc else ""
    return f"pt JOIN px p ON p.y BETWEEN pt.y - {r} AND pt.y + {r} AND p.x BETWEEN pt.x - {r} AND pt.x + {r}{inside}"


@_register(f"""{POINTS}, b AS (SELECT pt.y, pt.x, greatest(p.v + 0.05, 0) AS w, p.x - pt.x AS dx, p.y - pt.y AS dy FROM {_box(3)}),
s AS (SELECT y, x, sum(w) AS s, sum(w * dx) AS sx, sum(w * dy) AS sy, sum(w * dx * dx) AS sxx, sum(w * dy * dy) AS syy FROM b GROUP BY y, x)
SELECT y, x, round({FWHM_PER_SIGMA} * sqrt(0.5 * ((sxx / s - (sx / s) * (sx / s)) + (syy / s - (sy / s) * (sy / s)))), 6) AS fwhm FROM s""")
def fwhm_moments(px, spark, sf_dir):
    return _round(pixels.fwhm(_points(px), px, 3, -0.05).select("point.y", "point.x", "fwhm"))


@_register(f"{POINTS} SELECT pt.y, pt.x, round(sum(p.v), 6) AS flux FROM {_box(3, True)} GROUP BY pt.y, pt.x")
def aperture_flux(px, spark, sf_dir):
    return _round(pixels.aperture_flux(_points(px), px, 3).select("point.y", "point.x", "flux"))


@_register(f"{POINTS} SELECT pt.y, pt.x, p.y AS at_y, p.x AS at_x, p.v AS value FROM {_box(2)}")
def stamp_gather(px, spark, sf_dir):
    return pixels.boxed(_points(px), px, 2).select("point.y", "point.x", F.col("y").alias("at_y"), F.col("x").alias("at_x"), "value").toDF("y", "x", "at_y", "at_x", "value")


def _tap_rows(kernel: list[list[float]], power: int = 1) -> str:
    r = len(kernel) // 2
    return "taps AS (SELECT * FROM (VALUES " + ", ".join(f"({y - r}, {x - r}, CAST({v ** power!r} AS DOUBLE))" for y, row in enumerate(kernel) for x, v in enumerate(row)) + ") t(dy, dx, k))"


def _tiled(px: DataFrame) -> DataFrame:
    return tiles.to_tiles(px, size=WIDTH)


def _spread(df: DataFrame, *layers: str) -> DataFrame:
    return tiles.to_pixels(df, list(layers)).drop("frame_id")


@_register(f""", {_tap_rows(PSF)}, c AS (SELECT p.y - dy AS y, p.x - dx AS x, sum(k * p.v) AS s FROM px p, taps GROUP BY p.y - dy, p.x - dx)
SELECT y, x, CAST(s / sqrt(variance * (SELECT sum(k * k) FROM taps)) AS FLOAT) AS score FROM c JOIN px USING (y, x)""")
def matched_filter(px, spark, sf_dir):
    """W9 on tiles."""
    psf = F.array(*(F.lit(v) for row in PSF for v in row))
    return _spread(tiles.matched_filter(_tiled(px).withColumn("psf", psf), "psf", WIDTH, 2), "score")


# A model that varies over the frame: each component's coefficient, and the background, is a plane.
_KNOTS = grid_knots(0, 0, 63, 99, 3, 3)
_SPLINE = Spline(_KNOTS)
_BASIS = Basis(0.9, 1, 2)
_PLANES = [(0.8, 0.1, -0.05), (0.07, -0.02, 0.03), (-0.04, 0.01, 0.02), (0.01, 0.003, -0.002)]
_THETA = [c for plane in _PLANES for c in (*[0.0] * 6, *plane)]


def _u(x: str = "x") -> str:
    return f"(({x} - {float(_SPLINE.centre[0])!r}) / {float(_SPLINE.scale)!r})"


def _v(y: str = "y") -> str:
    return f"(({y} - {float(_SPLINE.centre[1])!r}) / {float(_SPLINE.scale)!r})"


def _plane(n: int, x: str = "x", y: str = "y") -> str:
    a, b, c = _PLANES[n]
    return f"({a!r} + {b!r} * {_u(x)} + {c!r} * {_v(y)})"


def _modelled(df: DataFrame) -> DataFrame:
    numbers = lambda v: F.array(*(F.lit(float(x)) for x in v))
    return df.withColumns({"knots": numbers(_KNOTS.ravel()), "theta": numbers(_THETA), "beta": F.lit(_BASIS.beta), "n_max": F.lit(_BASIS.n_max), "radius": F.lit(_BASIS.radius)})


_MIDDLE = {c: f"least({c} - {c} % 64 + least(64, {n} - ({c} - {c} % 64)) // 2, {n} - 1)" for c, n in (("x", "w"), ("y", "h"))}
_COMPONENTS = "taps AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([str(y - 2), str(x - 2), *(f"CAST({float(k[y, x])!r} AS DOUBLE)" for k in _BASIS.kernels)]) + ")" for y in range(5) for x in range(5)) + ") t(dy, dx, k0, k1, k2))"
_MODEL_SQL = f""", {SECOND}, {_COMPONENTS},
c AS (SELECT p.y + dy AS y, p.x + dx AS x, sum(k0 * p.v) AS c0, sum(k1 * p.v) AS c1, sum(k2 * p.v) AS c2, {", ".join(f"sum(k{i} * k{j} * p.variance) AS n{i}{j}" for i in range(3) for j in range(i, 3))} FROM px2 p, taps GROUP BY p.y + dy, p.x + dx),
raw AS (SELECT y, x, CAST(v - ({_plane(0)} * c0 + {_plane(1)} * c1 + {_plane(2)} * c2 + {_plane(3)}) AS FLOAT) AS d,
  CAST(px.variance + {" + ".join(f"{1 if i == j else 2} * {_plane(i, _MIDDLE['x'], _MIDDLE['y'])} * {_plane(j, _MIDDLE['x'], _MIDDLE['y'])} * n{i}{j}" for i in range(3) for j in range(i, 3))} AS FLOAT) AS s2,
  mask AS own, mask | CASE WHEN x < 2 OR x >= w - 2 OR y < 2 OR y >= h - 2 THEN 16 ELSE 0 END AS mask, w FROM c JOIN px USING (y, x), dims),
fill AS (SELECT {_upper('d')} AS f FROM raw WHERE mask = 0 AND (CAST(y AS BIGINT) * w + x) % 7 = 0)"""


@_register(f"{_MODEL_SQL} SELECT y, x, CASE WHEN own <> 0 THEN f ELSE d END AS value, CAST(mask AS SMALLINT) AS mask FROM raw, fill")
def difference_model(px, spark, sf_dir):
    """The difference under a model that varies over the frame, its bad pixels filled."""
    return _difference(px).select("y", "x", "value", "mask")


@_register(f"{_MODEL_SQL} SELECT y, x, CASE WHEN own <> 0 THEN CAST(0 AS FLOAT) ELSE s2 END AS variance FROM raw")
def variance_propagation(px, spark, sf_dir):
    """The variance of that difference, the kernel taken at the middle of squares of 64 pixels."""
    return _difference(px).select("y", "x", "variance")


def _difference(px: DataFrame) -> DataFrame:
    ours, theirs = _tiled(px), _tiled(second(px)).select("frame_id", "ty", "tx", F.col("value").alias("c_value"), F.col("variance").alias("c_variance"))
    pair = ours.withColumnsRenamed({"value": "t_value", "variance": "t_variance", "mask": "t_mask"}).join(theirs, ["frame_id", "ty", "tx"])
    pair = pair.withColumn("c_mask", F.lit(None).cast("array<smallint>"))
    frames = px.select("frame_id").distinct()
    solutions = _modelled(frames.withColumn("direction", F.lit("reference")))
    return _spread(subtract.difference(pair, solutions, frames.withColumn("fill", F.lit(0.0)), 0.0, WIDTH), "value", "variance", "mask")


@_register(f"SELECT y, x, CAST({' + '.join(f'{float(s)!r} * {_plane(n)}' for n, s in enumerate(_BASIS.sums))} AS FLOAT) AS scale FROM px")
def photometric_scale(px, spark, sf_dir):
    """The sum of the kernel at each pixel."""
    return _spread(subtract.photometric_scale(_modelled(_tiled(px)), WIDTH), "scale")


@_register(" UNION ALL ".join(f"SELECT y, x, {n} AS n, round({_plane(n)}, 6) AS coefficient FROM px" for n in range(4)).join(["SELECT * FROM (", ")"]))
def coefficient_fields(px, spark, sf_dir):
    """The fields of all components and the background."""
    out = subtract.coefficient_fields(_modelled(_tiled(px)), WIDTH)
    return _round(_components(out, "coefficients", "coefficient"))


def _components(df: DataFrame, layer: str, name: str) -> DataFrame:
    """Pixel rows (y, x, n, name) of an array that holds one plane after the other."""
    one = df.select("y0", "x0", "w", (F.col("h") * F.col("w")).alias("_size"), F.posexplode(layer).alias("_i", name))
    at = F.pmod("_i", "_size")
    return one.select((F.col("y0") + F.floor(at / F.col("w"))).cast("int").alias("y"), (F.col("x0") + F.pmod(at, F.col("w"))).cast("int").alias("x"), F.floor(F.col("_i") / F.col("_size")).cast("int").alias("n"), name)


def _hermite(beta: float, radius: int) -> str:
    """The one-dimensional functions of order 0 to 2 from their formula."""
    forms = {0: "1", 1: "2 * t", 2: "4 * t * t - 2"}
    one = " UNION ALL ".join(f"SELECT {n} AS n, d, ({f}) * exp(-0.5 * t * t) / sqrt({2**n * math.factorial(n)} * sqrt(pi()) * {beta}) AS k FROM line" for n, f in forms.items())
    return f"line AS (SELECT d, d / {beta} AS t FROM (SELECT unnest(generate_series(-{radius}, {radius})) AS d)), rows1 AS ({one})"


@_register(f""", {_hermite(1.1, 3)}, ax AS (SELECT p.y, p.x + d AS x, n, sum(k * p.v) AS a FROM px p, rows1 GROUP BY p.y, p.x + d, n),
b AS (SELECT ax.y + r.d AS y, ax.x, ax.n AS nx, r.n AS ny, sum(r.k * a) AS b FROM ax JOIN rows1 r ON ax.n + r.n <= 2 GROUP BY ax.y + r.d, ax.x, ax.n, r.n)
SELECT px.y, px.x, CAST((nx + ny) * (nx + ny + 1) // 2 + ny AS INT) AS n, round(b, 6) AS value FROM b JOIN px ON b.y = px.y AND b.x = px.x""")
def basis_convolution(px, spark, sf_dir):
    """The frame convolved with each Gauss-Hermite component."""
    return _round(_components(tiles.convolve_basis(_tiled(px), Basis(1.1, 2, 3), WIDTH), "stack", "value"))


@_register(f"{BACKGROUND} SELECT round(m, 6) AS median, round(s, 6) AS sigma FROM bg")
def tile_background(px, spark, sf_dir):
    """A2 as the engine takes it, on tiles."""
    return _round(tiles.background(_tiled(px)).select("median", "sigma"))


@_register(f"SELECT {_upper('v')} AS fill FROM px, dims WHERE mask = 0 AND (CAST(y AS BIGINT) * w + x) % 7 = 0")
def tile_median(px, spark, sf_dir):
    """A3, A4 as the engine takes them, on tiles."""
    return tiles.median_at(_tiled(px)).select("fill")


@_register(f"""{BACKGROUND}{_footprint(2)}{_peaks('px', 'v')}, cd AS (SELECT pk.y, pk.x, pk.v FROM pk JOIN fp USING (y, x), bg, dims WHERE top AND ok AND pk.v > m + 2 * s AND pk.x >= 3 AND pk.x < w - 3 AND pk.y >= 3 AND pk.y < h - 3),
b AS (SELECT cd.y, cd.x, greatest(p.v - m, 0) AS w, p.x AS gx, p.y AS gy FROM cd JOIN px p ON p.y BETWEEN cd.y - 3 AND cd.y + 3 AND p.x BETWEEN cd.x - 3 AND cd.x + 3, bg),
q AS (SELECT y, x, sum(w * gx) / sum(w) AS mx, sum(w * gy) / sum(w) AS my FROM b GROUP BY y, x),
f AS (SELECT y, x, {FWHM_PER_SIGMA} * sqrt(0.5 * sum(w * ((gx - mx) * (gx - mx) + (gy - my) * (gy - my))) / sum(w)) AS fwhm FROM b JOIN q USING (y, x) GROUP BY y, x)
SELECT y, x, round(v - m, 6) AS flux, round((v - m) / s, 6) AS snr, round(fwhm, 6) AS fwhm FROM cd JOIN f USING (y, x), bg""")
def stamp_candidates(px, spark, sf_dir):
    """D1 before thinning, F4, F5, A5 on tiles."""
    t = _tiled(px)
    return _round(detect.candidates(t, tiles.background(t), 2, 2.0, 0.0, 3, 3, WIDTH).select("y", "x", "flux", "snr", "fwhm"))


def _candidates(table: str, p: str) -> str:
    """Table {p}cd (y, x, flux, fwhm, rn): clean peaks of a frame by brightness, with their widths."""
    near = "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"
    return f""", {p}med AS (SELECT {_upper('v')} AS m FROM {table} WHERE mask = 0), {p}bg AS (SELECT m, {MAD_TO_SIGMA} * {_upper('abs(v - m)')} AS s FROM {table}, {p}med WHERE mask = 0 GROUP BY m),
{p}t AS (SELECT y, x, v, max(v) OVER (PARTITION BY y ORDER BY x {near}) AS t, max(mask) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS b FROM {table}),
{p}k AS (SELECT y, x, v, v >= max(t) OVER (PARTITION BY x ORDER BY y {near}) AS top, max(b) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 0 AS ok FROM {p}t),
{p}c AS (SELECT y, x, v - m AS flux FROM {p}k, {p}bg, dims WHERE top AND ok AND v > m + 2 * s AND x >= 3 AND x < w - 3 AND y >= 3 AND y < h - 3),
{p}b AS (SELECT c.y, c.x, greatest(p.v - m, 0) AS w, p.x AS gx, p.y AS gy FROM {p}c c JOIN {table} p ON p.y BETWEEN c.y - 3 AND c.y + 3 AND p.x BETWEEN c.x - 3 AND c.x + 3, {p}bg),
{p}q AS (SELECT y, x, sum(w * gx) / sum(w) AS mx, sum(w * gy) / sum(w) AS my FROM {p}b GROUP BY y, x),
{p}f AS (SELECT y, x, {FWHM_PER_SIGMA} * sqrt(0.5 * sum(w * ((gx - mx) * (gx - mx) + (gy - my) * (gy - my))) / sum(w)) AS fwhm FROM {p}b JOIN {p}q USING (y, x) GROUP BY y, x),
{p}cd AS (SELECT y, x, flux, fwhm, row_number() OVER (ORDER BY flux DESC, y, x) AS rn FROM {p}c JOIN {p}f USING (y, x))"""


def _thinned(p: str, radius: int, most: int) -> str:
    """Table {p}st: candidates in turn, each kept if none that was kept lies nearer."""
    far = f"len(list_filter(kept, lambda k: (k.x - c.x) * (k.x - c.x) + (k.y - c.y) * (k.y - c.y) < {radius**2})) = 0"
    return f""", {p}r(n, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(y INT, x INT)[]) UNION ALL
  SELECT rn, CASE WHEN len(kept) < {most} AND {far} THEN list_append(kept, struct_pack(y := c.y, x := c.x)) ELSE kept END FROM {p}r JOIN {p}cd c ON rn = n + 1),
{p}one AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM {p}r ORDER BY n DESC LIMIT 1)), {p}st AS (SELECT {p}cd.* FROM {p}cd JOIN {p}one ON y = k.y AND x = k.x)"""


def _stamps(px: DataFrame) -> DataFrame:
    t = _tiled(px)
    return detect.detect_stamps(t, tiles.background(t, 1 << 40), 2, 2.0, 150, 0.0, 5, 3, 3, WIDTH)


@_register(f"{_candidates('px', 's')}{_thinned('s', 5, 150)} SELECT y, x, round(flux, 6) AS flux, round(fwhm, 6) AS fwhm FROM sst")
def detect_stamps(px, spark, sf_dir):
    """Bright, clean, isolated peaks, 150 at most."""
    return _round(_stamps(px).select("y", "x", "flux", "fwhm"))


_SELECTED = f""", {SECOND}{_candidates('px2', 's')}{_thinned('s', 5, 150)}{_candidates('px', 'r')}{_thinned('r', 5, 150)},
mt AS (SELECT r.y, r.x, r.flux, r.fwhm AS fr, s.fwhm AS fs, row_number() OVER (PARTITION BY r.y, r.x ORDER BY (r.x - s.x) * (r.x - s.x) + (r.y - s.y) * (r.y - s.y), s.flux DESC, s.y, s.x) AS n
  FROM rst r JOIN sst s ON (r.x - s.x) * (r.x - s.x) + (r.y - s.y) * (r.y - s.y) <= 4)"""


@_register(f"{_SELECTED} SELECT CAST(row_number() OVER (ORDER BY flux DESC, y, x) - 1 AS INT) AS stamp, y, x, round(fs, 6) AS fwhm_science, round(fr, 6) AS fwhm_reference FROM mt WHERE n = 1")
def select_stamps(px, spark, sf_dir):
    """Stamps that two frames share."""
    return _round(detect.select_stamps(_stamps(second(px)), _stamps(px)).select("stamp", "y", "x", "fwhm_science", "fwhm_reference"))


@_register(f"{_SELECTED}, md AS (SELECT {_upper('fs')} AS s, {_upper('fr')} AS r FROM mt WHERE n = 1) SELECT round(s, 6) AS median_fwhm_science, round(r, 6) AS median_fwhm_reference, CASE WHEN r <= s THEN 'reference' ELSE 'science' END AS direction FROM md")
def stamp_summary(px, spark, sf_dir):
    """The widths of a pair and which of its frames is convolved."""
    out = detect.summary(detect.select_stamps(_stamps(second(px)), _stamps(px)))
    return _round(out.select("median_fwhm_science", "median_fwhm_reference", "direction"))


@_register(f"""{POINTS}, b AS (SELECT pt.y, pt.x, p.y - pt.y AS dy, p.x - pt.x AS dx, p.v FROM {_box(2)}), whole AS (SELECT y, x FROM b GROUP BY y, x HAVING count(*) = 25),
s AS (SELECT y, x, quantile_cont(v, 0.5) AS m, sum(v) AS t FROM b JOIN whole USING (y, x) GROUP BY y, x),
c AS (SELECT dy, dx, quantile_cont((v - m) / (t - 25 * m), 0.5) AS c FROM b JOIN s USING (y, x) WHERE t - 25 * m > 0 GROUP BY dy, dx)
SELECT CAST((dy + 2) * 5 + dx + 2 AS INT) AS i, round(greatest(c, 0) / (SELECT sum(greatest(c, 0)) FROM c), 6) AS psf FROM c""")
def psf_estimate(px, spark, sf_dir):
    """The point source from the stamps of bright peaks."""
    order = F.row_number().over(pixels.Window.partitionBy("frame_id").orderBy("py", "px"))
    stamps = _points(px).select("frame_id", order.alias("stamp"), F.col("px").alias("x"), F.col("py").alias("y"))
    psf = noise.estimate_psf(_tiled(px), stamps, 2, "value", WIDTH)
    return _round(psf.select(F.posexplode("psf").alias("i", "psf")))


def _seed(p: int) -> str:
    return f"score {'>=' if p > 0 else '<='} CAST({p * (SETTINGS.threshold if p > 0 else SETTINGS.dipole_threshold)} AS FLOAT) AND mask = 0"


@_register(f", {SCORED} SELECT y, x, score FROM sc WHERE {_seed(1)}")
def seed_mask_pos(px, spark, sf_dir):
    return pixels.seeds(scored(px), SETTINGS.threshold, 1).select("y", "x", "score")


@_register(f", {SCORED} SELECT y, x, score FROM sc WHERE {_seed(-1)}")
def seed_mask_neg(px, spark, sf_dir):
    return pixels.seeds(scored(px), SETTINGS.dipole_threshold, -1).select("y", "x", "score")


def _labels(p: int, name: str) -> str:
    """Seeds with the smallest place that each can reach through neighbours."""
    return f""", s{name} AS (SELECT y, x, score, v, CAST(y AS BIGINT) * 2147483648 + x AS id FROM sc WHERE {_seed(p)}),
r{name}(id, y, x, l) AS (SELECT id, y, x, id FROM s{name} UNION SELECT b.id, b.y, b.x, a.l FROM r{name} a JOIN s{name} b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.l < b.id),
l{name} AS (SELECT s.y, s.x, s.score, s.v, min(r.l) AS label FROM s{name} s JOIN r{name} r USING (id) GROUP BY s.y, s.x, s.score, s.v)"""


@_register(f", {SCORED}{_labels(1, 'p')} SELECT y, x, label FROM lp")
def component_labels(px, spark, sf_dir):
    return catalog.label(pixels.seeds(scored(px), SETTINGS.threshold, 1)).select("y", "x", "label")


@_register(f", {SCORED}{_labels(1, 'p')} SELECT DISTINCT label FROM lp JOIN sc n ON n.y BETWEEN lp.y - 1 AND lp.y + 1 AND n.x BETWEEN lp.x - 1 AND lp.x + 1 AND n.score <= CAST(-{SETTINGS.dipole_threshold} AS FLOAT) AND n.mask = 0")
def dipole_touch(px, spark, sf_dir):
    s = scored(px)
    return catalog.touching(catalog.label(pixels.seeds(s, SETTINGS.threshold, 1)), pixels.seeds(s, SETTINGS.dipole_threshold, -1)).select("label")


def _entries(p: int, name: str) -> str:
    threshold = SETTINGS.threshold if p > 0 else SETTINGS.dipole_threshold
    return f""", g{name} AS (SELECT label, count(*) AS n, sum(abs(CAST(score AS DOUBLE))) AS s, sum(abs(CAST(score AS DOUBLE)) * x) AS sx, sum(abs(CAST(score AS DOUBLE)) * y) AS sy,
  first(struct_pack(x := x, y := y, v := CAST(score AS DOUBLE)) ORDER BY -abs(CAST(score AS DOUBLE)), y, x) AS p FROM l{name} GROUP BY label),
k{name} AS (SELECT label, bit_or(mask) AS bits FROM (SELECT DISTINCT label, q.y, q.x, q.mask FROM l{name} l JOIN px q ON q.y BETWEEN l.y - 1 AND l.y + 1 AND q.x BETWEEN l.x - 1 AND l.x + 1) GROUP BY label),
f{name} AS (SELECT label, sum(q.v) AS flux FROM g{name} JOIN px q ON q.y BETWEEN round(sy / s) - 2 AND round(sy / s) + 2 AND q.x BETWEEN round(sx / s) - 2 AND round(sx / s) + 2
  AND (q.y - round(sy / s)) * (q.y - round(sy / s)) + (q.x - round(sx / s)) * (q.x - round(sx / s)) <= 4 GROUP BY label),
c{name} AS (SELECT sx / s AS x, sy / s AS y, p.x AS peak_x, p.y AS peak_y, p.v AS peak_snr, CAST(n AS INT) AS n_pix, flux, CAST(bits AS SMALLINT) AS mask_flags, label,
  {math.pi * SETTINGS.sigma**2!r} * greatest(0, ln(pow(abs(p.v) / {threshold}, 2))) AS expected FROM g{name} JOIN k{name} USING (label) JOIN f{name} USING (label))"""


_SUMMARY = "round(x, 6) AS x, round(y, 6) AS y, peak_x, peak_y, round(peak_snr, 5) AS peak_snr, n_pix, round(flux, 6) AS flux, mask_flags"


def _summary(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "peak_x", "peak_y", F.round("peak_snr", 5).alias("peak_snr"), "n_pix", F.round("flux", 6).alias("flux"), "mask_flags", *more)


@_register(f", {SCORED}{_labels(1, 'p')}{_entries(1, 'p')} SELECT {_SUMMARY}, round(expected, 5) AS expected_n_pix, n_pix / expected BETWEEN {SETTINGS.fwhm_lo} AND {SETTINGS.fwhm_hi} AND expected > 0 AS fwhm_consistent FROM cp")
def component_summary(px, spark, sf_dir):
    s = scored(px)
    out = catalog.summarise(catalog.label(pixels.seeds(s, SETTINGS.threshold, 1)), px, SETTINGS, 1)
    return _summary(out.withColumn("expected_n_pix", F.round("expected_n_pix", 5)), "expected_n_pix", "fwhm_consistent")


@_register(f", {SCORED}{_labels(1, 'p')}{_entries(1, 'p')}{_labels(-1, 'n')}{_entries(-1, 'n')} SELECT {_SUMMARY}, CAST(1 AS TINYINT) AS sign FROM cp UNION ALL SELECT {_SUMMARY}, CAST(-1 AS TINYINT) AS sign FROM cn")
def polarity_both(px, spark, sf_dir):
    return _summary(catalog.build(scored(px), SETTINGS, "both"), "sign")


@_register(f"""{POINTS}, {_tap_rows(PSF)}, m AS (SELECT pt.y, pt.x, p.v AS d, p.variance AS r, k FROM pt, taps JOIN px p ON p.y = pt.y + dy AND p.x = pt.x + dx WHERE p.mask = 0),
a AS (SELECT y, x, sum(d * k / r) / sum(k * k / r) AS a, sqrt(1 / sum(k * k / r)) AS err, CAST(count(*) - 1 AS INT) AS dof FROM m GROUP BY y, x HAVING count(*) >= 3)
SELECT y, x, round(any_value(a), 6) AS psf_amplitude, round(any_value(err), 6) AS psf_amplitude_err, round(sum((d - a * k) * (d - a * k) / r), 6) AS psf_chi2, any_value(dof) AS psf_chi2_dof FROM m JOIN a USING (y, x) GROUP BY y, x""")
def psf_fit(px, spark, sf_dir):
    return _round(catalog.psf_fit(_points(px), px, np.array(PSF)).select("point.y", "point.x", "psf_amplitude", "psf_amplitude_err", "psf_chi2", "psf_chi2_dof"))


@_register(f"{POINTS}, br AS (SELECT y, x FROM px WHERE v > 0.4) SELECT pt.y, pt.x, round(min(sqrt((pt.x - br.x) * (pt.x - br.x) + (pt.y - br.y) * (pt.y - br.y))), 6) AS dist FROM pt, br GROUP BY pt.y, pt.x")
def bright_star_distance(px, spark, sf_dir):
    bright = px.where("value > 0.4").select("frame_id", F.col("x").alias("px"), F.col("y").alias("py"))
    return _round(pixels.nearest_bright(_points(px), bright, "dist").select("point.y", "point.x", "dist"))


@_register(f"SELECT round(quantile_cont(v * v / variance, 0.5) / {MEDIAN_CHI2_1!r}, 6) AS scale FROM px WHERE mask = 0")
def variance_rescale(px, spark, sf_dir):
    return _round(pixels.variance_rescale(px).select("scale"))


@_register('SELECT round(min(v), 6) AS "min", round(quantile_cont(v, 0.5), 6) AS "median", round(max(v), 6) AS "max", CAST(sum(CASE WHEN mask <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_masked, round(sum(CASE WHEN mask <> 0 THEN 1 ELSE 0 END) / count(*), 6) AS masked_fraction FROM px')
def layer_stats(px, spark, sf_dir):
    return _round(pixels.layer_stats(px).select("min", "median", "max", "n_masked", "masked_fraction"))


@_register("SELECT round(stddev_pop(v), 6) AS rms, CAST(sum(CASE WHEN mask <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_masked FROM px")
def difference_rms(px, spark, sf_dir):
    return _round(pixels.rms_and_masked(px).select("rms", "n_masked"))


@_register("SELECT round(stddev_pop(v), 6) AS rms FROM px, dims WHERE y >= 10 AND y < h - 10 AND x >= 5 AND x < w - 5")
def residual_rms(px, spark, sf_dir):
    return _round(pixels.residual_rms(px, 10, -10, 5, -5).select("rms"))


@_register(", mu AS (SELECT avg(v) AS m FROM px), d AS (SELECT v - m AS d, lead(v - m) OVER (PARTITION BY y ORDER BY x) AS dx, lead(v - m) OVER (PARTITION BY x ORDER BY y) AS dy FROM px, mu) SELECT round(avg(d * dx) / avg(d * d), 6) AS acf_x, round(avg(d * dy) / avg(d * d), 6) AS acf_y FROM d")
def autocorr_lag1(px, spark, sf_dir):
    return _round(pixels.autocorrelation(px).select("acf_x", "acf_y"))


@_register(f"{POINTS}, c AS (SELECT pt.y, pt.x, quantile_cont(abs(p.v), 0.5) AS c FROM {_box(2)} GROUP BY pt.y, pt.x) SELECT round(quantile_cont(c, 0.5), 6) AS \"median\", round(quantile_cont(c, 0.9), 6) AS p90 FROM c")
def core_residual(px, spark, sf_dir):
    return _round(pixels.core_residual(_points(px), px).select("median", "p90"))


@_register(f"{POINTS} SELECT pt.y, pt.x, round(max(p.v), 6) AS peak, max(p.v) >= 0.35 AS recovered FROM {_box(3)} GROUP BY pt.y, pt.x")
def completeness(px, spark, sf_dir):
    out = synth.completeness(_points(px), px, 0.35, 3)
    return _round(out.select("point.y", "point.x", "peak", "recovered"))


@_register(", t AS (SELECT x / 63.0 AS u, y / 99.0 AS w, v, 1 / variance AS q FROM px WHERE mask = 0) SELECT round(sum(q), 4) AS m00, round(sum(q * u), 4) AS m01, round(sum(q * w), 4) AS m02, round(sum(q * u * u), 4) AS m11, round(sum(q * u * w), 4) AS m12, round(sum(q * w * w), 4) AS m22, round(sum(q * v), 4) AS r0, round(sum(q * u * v), 4) AS r1, round(sum(q * w * v), 4) AS r2, round(sum(q * v * v), 4) AS energy, count(*) AS n FROM t")
def normal_equations_small(px, spark, sf_dir):
    """A8 for a plane: the sums of parts of the frame add up."""
    terms = {"m00": (0, 0), "m01": (0, 1), "m02": (0, 2), "m11": (1, 1), "m12": (1, 2), "m22": (2, 2)}

    def run(batches):
        for df in batches:
            design = np.column_stack([np.ones(len(df)), df.x / 63.0, df.y / 99.0])
            part = Normal.of(design, np.zeros((len(df), 0)), df["value"].to_numpy(), 1 / df.variance.to_numpy())
            yield pd.DataFrame([{t: part.m[at] for t, at in terms.items()} | {f"r{k}": part.rhs[k] for k in range(3)} | {"energy": part.energy, "n": part.n}])

    names = [*terms, "r0", "r1", "r2", "energy"]
    parts = pixels.good_pixels(px).select("y", "x", "value", "variance").mapInPandas(run, ", ".join(f"{n} double" for n in names) + ", n long")
    return _round(parts.agg(*(F.sum(n).alias(n) for n in [*names, "n"])), 4)


def _cramer(column: int | None = None) -> str:
    """The determinant of the plane's equations, with the right side in place of a column."""
    m = [["m00", "m01", "m02"], ["m01", "m11", "m12"], ["m02", "m12", "m22"]]
    if column is not None:
        m = [[f"r{i}" if j == column else x for j, x in enumerate(row)] for i, row in enumerate(m)]
    minor = lambda a, b: f"({m[1][a]} * {m[2][b]} - {m[1][b]} * {m[2][a]})"
    return f"({m[0][0]} * {minor(1, 2)} - {m[0][1]} * {minor(0, 2)} + {m[0][2]} * {minor(0, 1)})"


@_register(f""", t AS (SELECT (x - 21.0) / 66 AS u, (y - 33.0) / 66 AS w, v, 1 / variance AS q FROM px WHERE mask = 0),
eq AS (SELECT sum(q) AS m00, sum(q * u) AS m01, sum(q * w) AS m02, sum(q * u * u) AS m11, sum(q * u * w) AS m12, sum(q * w * w) AS m22, sum(q * v) AS r0, sum(q * u * v) AS r1, sum(q * w * v) AS r2, sum(q * v * v) AS e, count(*) AS n FROM t),
th AS (SELECT *, {', '.join(f'{_cramer(k)} / {_cramer()} AS t{k}' for k in range(3))} FROM eq), rs AS (SELECT *, e - t0 * r0 - t1 * r1 - t2 * r2 AS rss FROM th)
SELECT round(t0, 6) AS t0, round(t1, 6) AS t1, round(t2, 6) AS t2, round(rss, 4) AS rss, 3.0 AS effective_dof, round(n * rss / ((n - 3) * (n - 3)), 8) AS gcv FROM rs""".replace("3.0 AS effective_dof", "CAST(3 AS DOUBLE) AS effective_dof"))
def plane_fit(px, spark, sf_dir):
    """A background plane by weighted least squares from sums of the frame's parts, its misfit, freedom and score."""
    knots = np.array([(0.0, 0.0), (63.0, 0.0), (0.0, 99.0)])  # three knots: no bending

    def sums(batches):
        for df in batches:
            part = Normal.of(Spline(knots).design(df[["x", "y"]].to_numpy()), np.zeros((len(df), 0)), df["value"].to_numpy(), 1 / df.variance.to_numpy())
            yield pd.DataFrame([{f"m{i}": v for i, v in enumerate(part.m.ravel())} | {f"r{i}": v for i, v in enumerate(part.rhs)} | {"energy": part.energy, "n": part.n}])

    def solved(batches):
        for df in batches:
            r = df.iloc[0]
            normal = Normal(np.array([r[f"m{i}"] for i in range(9)]).reshape(3, 3), np.array([r[f"r{i}"] for i in range(3)]), r.energy, int(r.n))
            fit = solve_at(normal, Spline(knots), 0.5)
            yield pd.DataFrame([{f"t{i}": v for i, v in enumerate(fit.theta)} | {"rss": fit.rss, "effective_dof": fit.effective_dof, "gcv": fit.gcv}])

    names = [*(f"m{i}" for i in range(9)), "r0", "r1", "r2", "energy"]
    parts = pixels.good_pixels(px).select("y", "x", "value", "variance").mapInPandas(sums, ", ".join(f"{n} double" for n in names) + ", n long")
    out = parts.agg(*(F.sum(n).alias(n) for n in [*names, "n"])).mapInPandas(solved, "t0 double, t1 double, t2 double, rss double, effective_dof double, gcv double")
    return out.select(*(F.round(c, 6).alias(c) for c in ("t0", "t1", "t2")), F.round("rss", 4).alias("rss"), F.round("effective_dof", 6).alias("effective_dof"), F.round("gcv", 8).alias("gcv"))


_COEF = [round(0.3 * math.sin(1.7 * k), 4) for k in range(9)]
_WEIGHTS = [float(w) for w in _SPLINE.null_space @ np.array(_COEF[:6])]


def _green_sql(i: int) -> str:
    ku, kv = (float(a) for a in _SPLINE._u[i])
    r2 = f"(pow({_u()} - {ku!r}, 2) + pow({_v()} - {kv!r}, 2))"
    return f"{_WEIGHTS[i]!r} * CASE WHEN {r2} > 0 THEN 0.5 * {r2} * ln({r2}) ELSE 0 END"


@_register(f"SELECT y, x, round({' + '.join(_green_sql(i) for i in range(9))} + {_COEF[6]!r} + {_COEF[7]!r} * {_u()} + {_COEF[8]!r} * {_v()}, 5) AS field FROM px")
def spline_field(px, spark, sf_dir):
    """A thin-plate spline at every pixel of the frame."""

    def run(batches):
        for df in batches:
            yield pd.DataFrame({"y": df.y, "x": df.x, "field": evaluate(_KNOTS, df[["x", "y"]].to_numpy(), _COEF)})

    return _round(px.select("y", "x").mapInPandas(run, "y int, x int, field double"), 5)


def _clipping(source: str, rounds: int = 6) -> str:
    """Tables k0 (all values v of source) to k6, each what a round of clipping leaves."""
    out = f", k0 AS (SELECT v FROM {source})"
    for k in range(rounds):
        out += f""", m{k} AS (SELECT quantile_cont(v, 0.5) AS m FROM k{k}), s{k} AS (SELECT m, {MAD_TO_SIGMA} * quantile_cont(abs(v - m), 0.5) AS s FROM k{k}, m{k} GROUP BY m),
k{k + 1} AS (SELECT v FROM k{k}, s{k} WHERE s <= 0 OR (v > m - 4 * s AND v < m + 4 * s))"""
    return out


@_register(f"{_clipping('px')}, mm AS (SELECT quantile_cont(v, 0.5) AS m, count(*) AS n FROM k6) SELECT round(m, 6) AS median, round({MAD_TO_SIGMA} * quantile_cont(abs(v - m), 0.5), 6) AS sigma, n FROM k6, mm GROUP BY m, n")
def sigma_clip(px, spark, sf_dir):
    return _round(pixels.sigma_clip(px).select("median", "sigma", "n"))


_CDF = "0.5 * (1 + sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2)))"


@_register(f""", pl AS (SELECT v / sqrt(variance) AS v FROM px WHERE mask = 0){_clipping('pl')}, st AS (SELECT avg(v) AS a, stddev_pop(v) AS d, count(*) AS n FROM k6),
z AS (SELECT (v - a) / d AS z, n FROM k6, st), zt AS (SELECT z, n, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t, row_number() OVER (ORDER BY z) AS r FROM z)
SELECT round(any_value(s), 6) AS robust_sigma, round(avg(z * z * z), 6) AS skewness, round(avg(z * z * z * z) - 3, 6) AS kurtosis, round(max(abs(r / n - {_CDF})), 6) AS ks FROM zt, s0""")
def gaussianity(px, spark, sf_dir):
    pulls = px.where("mask = 0").select("frame_id", (F.col("value") / F.sqrt("variance")).alias("value"))
    return _round(pixels.gaussianity(pulls).select("robust_sigma", "skewness", "kurtosis", "ks"))


@_register(f"""{POINTS}, o AS (SELECT pt.y, pt.x, p.v, p.y AS ay, p.x AS ax, row_number() OVER (PARTITION BY pt.y, pt.x ORDER BY p.v DESC, p.y, p.x) AS n FROM {_box(3)})
SELECT y, x, v AS peak, ay AS peak_y, ax AS peak_x FROM o WHERE n = 1""")
def peak_near(px, spark, sf_dir):
    """T6."""
    return synth.peak_near(_points(px), px, 3).select("point.y", "point.x", "peak", "peak_y", "peak_x")


@_register(f"""{POINTS}, g AS (SELECT p.y, p.x, sum(40 * pt.v / (2 * pi() * 1.21) * exp(-0.5 * ((p.y - pt.y - 0.25) * (p.y - pt.y - 0.25) + (p.x - pt.x + 0.25) * (p.x - pt.x + 0.25)) / 1.21)) AS more FROM {_box(6)} GROUP BY p.y, p.x)
SELECT y, x, CAST(v + coalesce(more, 0) AS FLOAT) AS value FROM px LEFT JOIN g USING (y, x)""")
def inject_stars(px, spark, sf_dir):
    """A star put a quarter of a pixel beside each bright peak."""
    stars = _points(px).select("frame_id", (F.col("px") - 0.25).alias("x"), (F.col("py") + 0.25).alias("y"), (40 * F.col("flux")).alias("flux"))
    return synth.inject(px, stars, 1.1, WIDTH, px.agg(F.max("y") + 1).first()[0]).select("y", "x", "value")


_QUALITY = f"""CAST((CASE WHEN n_pix / expected BETWEEN {SETTINGS.fwhm_lo} AND {SETTINGS.fwhm_hi} AND expected > 0 THEN 0 ELSE 1 END) | (CASE WHEN dipole THEN 2 ELSE 0 END) | (CASE WHEN mask_flags <> 0 THEN 4 ELSE 0 END)
 | (CASE WHEN chi2 / dof > {SETTINGS.shape_tolerance} THEN 8 ELSE 0 END) | (CASE WHEN dist <= {3 * SETTINGS.expected_fwhm} THEN 16 ELSE 0 END) AS SMALLINT)"""


@_register(f""", {SCORED}{_labels(1, 'p')}{_entries(1, 'p')}, {_tap_rows(PSF)}, pm AS (SELECT label, p.v AS d, p.variance AS r, k FROM cp, taps JOIN px p ON p.y = round(cp.y) + dy AND p.x = round(cp.x) + dx WHERE p.mask = 0),
pa AS (SELECT label, sum(d * k / r) / sum(k * k / r) AS a, count(*) - 1 AS dof FROM pm GROUP BY label HAVING count(*) >= 3),
pc AS (SELECT label, sum((d - a * k) * (d - a * k) / r) AS chi2, any_value(dof) AS dof FROM pm JOIN pa USING (label) GROUP BY label),
br AS (SELECT y, x FROM px WHERE v > 0.4), bd AS (SELECT label, min(sqrt((cp.x - br.x) * (cp.x - br.x) + (cp.y - br.y) * (cp.y - br.y))) AS dist FROM cp, br GROUP BY label),
dp AS (SELECT DISTINCT label FROM lp JOIN sc n ON n.y BETWEEN lp.y - 1 AND lp.y + 1 AND n.x BETWEEN lp.x - 1 AND lp.x + 1 AND n.score <= CAST(-{SETTINGS.dipole_threshold} AS FLOAT) AND n.mask = 0),
al AS (SELECT cp.*, pc.chi2, pc.dof, bd.dist, dp.label IS NOT NULL AS dipole FROM cp LEFT JOIN pc USING (label) LEFT JOIN bd USING (label) LEFT JOIN dp USING (label))
SELECT round(x, 6) AS x, round(y, 6) AS y, dipole AS is_dipole, round(dist, 6) AS bright_star_dist, {_QUALITY} AS quality FROM al""")
def catalog_quality(px, spark, sf_dir):
    """Shape, neighbours and flags of the catalog."""
    bright = px.where("value > 0.4").select("frame_id", F.col("x").alias("px"), F.col("y").alias("py"))
    out = catalog.build(scored(px), SETTINGS, "positive", np.array(PSF), bright)
    return _round(out.select("x", "y", "is_dipole", "bright_star_dist", "quality"))


@_register("SELECT round(stddev_pop(v), 6) AS rms, round(avg(abs(v)), 6) AS mean_abs FROM px WHERE mask = 0")
def field_stats(px, spark, sf_dir):
    return _round(synth.field_stats(px.where("mask = 0")).select("rms", "mean_abs"))
