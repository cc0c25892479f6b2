"""Operators on frames with a row per pixel: column expressions, windows, joins and aggregates only.

A frame has columns frame_id, y, x, value, variance and mask; variance and mask may be null. Windows are by row and then by
column, so their partitions are a frame's lines, never a frame. Non-finite values count as bad wherever pixels are judged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .schema import FWHM_PER_SIGMA, MAD_TO_SIGMA, MEDIAN_CHI2_1


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to spark.checkpoint.dir, else only kept. Long plans joined with themselves take very long to analyse."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def along_row():
    return Window.partitionBy("frame_id", "y").orderBy("x")


def along_column():
    return Window.partitionBy("frame_id", "x").orderBy("y")


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def good(value: Column, mask: Column) -> Column:
    """finite and not masked."""
    return finite(value) & (F.coalesce(mask, F.lit(0)) == 0)


def positive_variance(variance: Column) -> Column:
    """F2."""
    return finite(variance) & (variance > 0)


def good_pixels(px: DataFrame) -> DataFrame:
    return px.where(good(F.col("value"), F.col("mask")))


def upper_median_of(df: DataFrame, by: str | Sequence[str], name: str, out: str = "median") -> DataFrame:
    """A3 by group, as an ordered percentile that Spark merges from partial counts."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) within group (order by `{name}` desc)").alias(out))


def synth_variance(px: DataFrame, gain: float, read_noise: float = 0.0) -> DataFrame:
    """Poisson noise of the positive part and read noise."""
    if not gain > 0:
        raise ValueError("the gain must be positive")
    return px.withColumn("variance", F.greatest(F.col("value"), F.lit(0.0)) / gain + read_noise**2)


def weighted_mean(px: DataFrame) -> DataFrame:
    """A1: (frame_id, mean) by inverse variance over good pixels of positive variance; 0 if there are none."""
    use = good(F.col("value"), F.col("mask")) & positive_variance(F.col("variance"))
    w = F.when(use, 1 / F.col("variance").cast("double"))
    mean = F.try_divide(F.sum(w * F.col("value")), F.sum(w))
    return px.groupBy("frame_id").agg(F.coalesce(mean, F.lit(0.0)).alias("mean"))


def frame_sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("frame_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def linear_index(width: Column | str = "width") -> Column:
    width = F.col(width) if isinstance(width, str) else width
    return F.col("y").cast("long") * width + F.col("x")


def background(px: DataFrame, samples: int = 1 << 18) -> DataFrame:
    """A2: (frame_id, median, sigma) by upper medians over every n-th good pixel, n such that about `samples` are used."""
    sized = px.join(frame_sizes(px), "frame_id")
    step = F.greatest(F.lit(1), F.floor(F.col("width").cast("long") * F.col("height") / samples))
    used = sized.where((F.pmod(linear_index(), step) == 0) & good(F.col("value"), F.col("mask")))
    med = upper_median_of(used, "frame_id", "value")
    dev = used.join(med, "frame_id").withColumn("dev", F.abs(F.col("value") - F.col("median")))
    mad = dev.groupBy("frame_id").agg(F.first("median").alias("median"), F.expr("percentile_disc(0.5) within group (order by dev desc)").alias("mad"))
    every = px.select("frame_id").distinct().join(mad, "frame_id", "left")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return every.select("frame_id", zero(F.col("median")).alias("median"), (zero(F.col("mad")) * MAD_TO_SIGMA).alias("sigma"))


def fill_value(px: DataFrame, step: int = 7) -> DataFrame:
    """A4: (frame_id, fill): the upper median of good pixels at every 7th place; 0 if none."""
    used = px.join(frame_sizes(px), "frame_id").where((F.pmod(linear_index(), F.lit(step)) == 0) & good(F.col("value"), F.col("mask")))
    return px.select("frame_id").distinct().join(upper_median_of(used, "frame_id", "value", "fill"), "frame_id", "left").select("frame_id", F.coalesce(F.col("fill").cast("double"), F.lit(0.0)).alias("fill"))


def _convolved(value: Column, kernel: Sequence[float], over) -> Column:
    half, total = len(kernel) // 2, None
    for j, k in enumerate(kernel):
        shift = half - j
        at = value if shift == 0 else F.lead(value, shift).over(over) if shift > 0 else F.lag(value, -shift).over(over)
        term = F.lit(float(k)) * F.coalesce(at, F.lit(0.0))
        total = term if total is None else total + term
    return total


def convolve_x(px: DataFrame, kernel: Sequence[float], value: str = "value", out: str = "value") -> DataFrame:
    """True convolution along x, zero beyond the frame; rows must be dense."""
    return px.withColumn(out, _convolved(F.col(value).cast("double"), kernel, along_row()))


def convolve_y(px: DataFrame, kernel: Sequence[float], value: str = "value", out: str = "value") -> DataFrame:
    """W2."""
    return px.withColumn(out, _convolved(F.col(value).cast("double"), kernel, along_column()))


def convolve_separable(px: DataFrame, kernel_x: Sequence[float], kernel_y: Sequence[float], value: str = "value", out: str = "value") -> DataFrame:
    """W3."""
    return convolve_y(convolve_x(px, kernel_x, value, "_along_x"), kernel_y, "_along_x", out).drop("_along_x")


def dilate(px: DataFrame, radius: int, mask: str = "mask", out: str = "mask") -> DataFrame:
    """The bits of all pixels within radius in x and in y."""
    wide = px.withColumn("_bits", F.bit_or(F.coalesce(F.col(mask), F.lit(0))).over(along_row().rowsBetween(-radius, radius)))
    return wide.withColumn(out, F.bit_or("_bits").over(along_column().rowsBetween(-radius, radius)).cast("smallint")).drop("_bits")


def footprint_ok(px: DataFrame, radius: int, saturation: float = 0.0, out: str = "footprint_ok") -> DataFrame:
    """the box of radius lies in the frame and is finite, unmasked and, with saturation above 0, below it."""
    bad = ~good(F.col("value"), F.col("mask"))
    if saturation > 0:
        bad = bad | F.coalesce(F.col("value") >= saturation, F.lit(True))
    wide = px.withColumn("_bad", F.max(bad.cast("int")).over(along_row().rowsBetween(-radius, radius)))
    wide = wide.withColumn("_n", F.count(F.lit(1)).over(along_row().rowsBetween(-radius, radius)))
    wide = wide.withColumn("_bad", F.max("_bad").over(along_column().rowsBetween(-radius, radius)))
    wide = wide.withColumn("_m", F.count(F.lit(1)).over(along_column().rowsBetween(-radius, radius)))
    side = 2 * radius + 1
    return wide.withColumn(out, (F.col("_bad") == 0) & (F.col("_n") == side) & (F.col("_m") == side)).drop("_bad", "_n", "_m")


def local_maxima(px: DataFrame, threshold: Column | float, value: str = "value", out: str = "is_peak") -> DataFrame:
    """above threshold and no neighbour above the pixel; every pixel of a plateau passes."""
    v = F.when(finite(F.col(value)), F.col(value))
    wide = px.withColumn("_top", F.max(v).over(along_row().rowsBetween(-1, 1)))
    wide = wide.withColumn("_top", F.max("_top").over(along_column().rowsBetween(-1, 1)))
    return wide.withColumn(out, F.coalesce((v > threshold) & (v >= F.col("_top")), F.lit(False))).drop("_top")


def inside(px: DataFrame, border: int) -> DataFrame:
    """pixels at least border away from the frame's edges."""
    sized = px.join(frame_sizes(px), "frame_id")
    return sized.where((F.col("x") >= border) & (F.col("x") < F.col("width") - border) & (F.col("y") >= border) & (F.col("y") < F.col("height") - border)).drop("width", "height")


def seeds(px: DataFrame, threshold: float, polarity: int = 1, exclude_bad: bool = True, score: str = "score") -> DataFrame:
    """pixels whose score reaches the threshold, in single precision; with polarity -1 its negative."""
    s, limit = F.col(score).cast("float"), F.lit(float(threshold)).cast("float")
    hit = s >= limit if polarity > 0 else s <= -limit
    keep = finite(s) & hit
    return px.where(keep & (F.coalesce(F.col("mask"), F.lit(0)) == 0) if exclude_bad else keep)


def variance_rescale(px: DataFrame) -> DataFrame:
    """(frame_id, scale): the median of squared pulls over that of the chi-squared distribution; 1 without good pixels."""
    use = good(F.col("value"), F.col("mask")) & positive_variance(F.col("variance"))
    z2 = F.when(use, F.col("value").cast("double") ** 2 / F.col("variance").cast("double"))
    return px.groupBy("frame_id").agg(F.coalesce(F.percentile(z2, 0.5) / MEDIAN_CHI2_1, F.lit(1.0)).alias("scale"))


def layer_stats(px: DataFrame) -> DataFrame:
    """Extremes and median of finite values, masked pixels and their share."""
    v = F.when(finite(F.col("value")), F.col("value").cast("double"))
    masked = F.sum((F.coalesce(F.col("mask"), F.lit(0)) != 0).cast("long"))
    return px.groupBy("frame_id").agg(
        F.min(v).alias("min"), F.percentile(v, 0.5).alias("median"), F.max(v).alias("max"), masked.alias("n_masked"), (masked / F.count(F.lit(1))).alias("masked_fraction")
    )


def rms_and_masked(px: DataFrame) -> DataFrame:
    """A22."""
    return px.groupBy("frame_id").agg(F.stddev_pop(F.col("value").cast("double")).alias("rms"), F.sum((F.coalesce(F.col("mask"), F.lit(0)) != 0).cast("long")).alias("n_masked"))


def residual_rms(px: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Population deviation in the box y0 <= y < y1, x0 <= x < x1; ends below 1 count from the frame's end."""
    if y1 < 1 or x1 < 1:
        px = px.join(frame_sizes(px), "frame_id")
    y1, x1 = F.lit(y1) if y1 > 0 else F.col("height") + y1, F.lit(x1) if x1 > 0 else F.col("width") + x1
    box = px.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    return box.groupBy("frame_id").agg(F.stddev_pop(F.col("value").cast("double")).alias("rms"))


def _values(px: DataFrame) -> DataFrame:
    return px.where(finite(F.col("value"))).select("frame_id", F.col("value").cast("double").alias("value"))


def _centre(values: DataFrame) -> DataFrame:
    """(frame_id, median, sigma, n) of column value, the deviation from the median absolute one."""
    med = values.groupBy("frame_id").agg(F.percentile("value", 0.5).alias("median"), F.count(F.lit(1)).alias("n"))
    dev = values.join(med, "frame_id").withColumn("dev", F.abs(F.col("value") - F.col("median")))
    return dev.groupBy("frame_id").agg(F.first("median").alias("median"), (F.percentile("dev", 0.5) * MAD_TO_SIGMA).alias("sigma"), F.first("n").alias("n"))


def clipped(px: DataFrame, n_sigma: float = 4.0, rounds: int = 6) -> DataFrame:
    """(frame_id, value) of the finite values nearer to the median than n_sigma robust deviations, told anew `rounds` times.

    A frame that has settled, or has no deviation, no longer changes in the further rounds.
    """
    values = _values(px)
    inf = float("inf")
    bounds = values.groupBy("frame_id").agg(F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"))

    def within(bounds: DataFrame) -> DataFrame:
        return values.join(bounds, "frame_id").where((F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi")))

    for _ in range(rounds):
        reach = F.when(F.col("sigma") > 0, n_sigma * F.col("sigma")).otherwise(inf)
        told = _centre(within(bounds).select("frame_id", "value")).join(bounds, "frame_id")
        # a row for each frame, written so that a round reads the values only for itself
        bounds = cut(told.select("frame_id", F.greatest("lo", F.col("median") - reach).alias("lo"), F.least("hi", F.col("median") + reach).alias("hi")))
    return within(bounds).select("frame_id", "value")


def sigma_clip(px: DataFrame, n_sigma: float = 4.0, rounds: int = 6) -> DataFrame:
    """(frame_id, median, sigma, n) of what clipped() leaves."""
    return _centre(clipped(px, n_sigma, rounds))


def gaussianity(pulls: DataFrame) -> DataFrame:
    """Robust sigma of column value; of its clipped core, standardised by the core's mean and deviation, the skewness, excess
    kurtosis and the largest distance of the share of values up to each from the unit normal.
    """
    whole = _centre(_values(pulls)).select("frame_id", F.col("sigma").alias("robust_sigma"))
    core = clipped(pulls)
    shape = core.groupBy("frame_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count(F.lit(1)).alias("n"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"))
    # ranks by value bins keep a frame's pixels out of one task
    counts = core.groupBy("frame_id", "value").agg(F.count(F.lit(1)).alias("c"))
    bins = counts.join(shape.select("frame_id", "m", "s", "n"), "frame_id").withColumn("z", (F.col("value") - F.col("m")) / F.col("s")).withColumn("bin", F.floor(F.col("z") * 64))
    before = bins.groupBy("frame_id", "bin").agg(F.sum("c").alias("b")).withColumn("below", F.coalesce(F.sum("b").over(Window.partitionBy("frame_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy("frame_id", "bin").orderBy("z").rowsBetween(Window.unboundedPreceding, 0))
    # equal values stand for ranks from the first of them to the last
    gap = F.greatest(F.abs(upto / F.col("n") - normal_cdf(F.col("z"))), F.abs((upto - F.col("c") + 1) / F.col("n") - normal_cdf(F.col("z"))))
    ks = bins.join(before, ["frame_id", "bin"]).withColumn("gap", gap).groupBy("frame_id").agg(F.max("gap").alias("ks"))
    return whole.join(shape.select("frame_id", "skewness", "kurtosis"), "frame_id").join(ks, "frame_id")


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 for the error function, within 1.5e-7."""
    a = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-a * a)
    return 0.5 * (1 + F.when(z < 0, -erf).otherwise(erf))


def autocorrelation(px: DataFrame, lag: int = 1) -> DataFrame:
    """(frame_id, acf_x, acf_y): mean products of values `lag` apart over the mean square, about the mean."""
    mean = px.groupBy("frame_id").agg(F.avg(F.col("value").cast("double")).alias("_mean"))
    d = px.join(mean, "frame_id").withColumn("d", F.col("value").cast("double") - F.col("_mean"))
    d = d.withColumn("dx", F.lead("d", lag).over(along_row())).withColumn("dy", F.lead("d", lag).over(along_column()))
    return d.groupBy("frame_id").agg((F.avg(F.col("d") * F.col("dx")) / F.avg(F.col("d") ** 2)).alias("acf_x"), (F.avg(F.col("d") * F.col("dy")) / F.avg(F.col("d") ** 2)).alias("acf_y"))


def boxed(points: DataFrame, px: DataFrame, radius: int | str, disc: bool = False) -> DataFrame:
    """The pixels within radius (a number or a column of points) of each point (frame_id, point, px, py), with dy and dx.

    Points spread to their places and meet pixels in an equi-join; those beyond the frame find none.
    """
    radius = F.col(radius) if isinstance(radius, str) else F.lit(radius)
    span = F.sequence(-radius, radius)
    at = points.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    if disc:
        at = at.where(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= radius * radius)
    at = at.withColumns({"y": F.col("py") + F.col("dy"), "x": F.col("px") + F.col("dx")})
    return at.join(px.select("frame_id", "y", "x", "value", "variance", "mask"), ["frame_id", "y", "x"])


def fwhm(points: DataFrame, px: DataFrame, radius: int, background_: float = 0.0) -> DataFrame:
    """A5: (frame_id, point, fwhm) by second moments of what lies above the background; null where nothing does."""
    w = F.greatest(F.col("value").cast("double") - background_, F.lit(0.0))
    one = boxed(points, px, radius).withColumn("w", F.when(finite(F.col("value")), w))
    sums = one.groupBy("frame_id", "point").agg(*(F.sum(e).alias(n) for n, e in {"s": F.col("w"), "sx": F.col("w") * F.col("dx"), "sy": F.col("w") * F.col("dy"), "sxx": F.col("w") * F.col("dx") ** 2, "syy": F.col("w") * F.col("dy") ** 2}.items()))
    share = lambda c: F.try_divide(F.col(c), F.when(F.col("s") > 0, F.col("s")))
    var = 0.5 * ((share("sxx") - share("sx") ** 2) + (share("syy") - share("sy") ** 2))
    return sums.select("frame_id", "point", F.when(var > 0, FWHM_PER_SIGMA * F.sqrt(var)).alias("fwhm"))


def aperture_flux(points: DataFrame, px: DataFrame, radius: int | str) -> DataFrame:
    """(frame_id, point, flux): the finite values in a disc around each point."""
    v = F.when(finite(F.col("value")), F.col("value").cast("double"))
    return boxed(points, px, radius, disc=True).groupBy("frame_id", "point").agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("flux"))


def core_residual(points: DataFrame, px: DataFrame, radius: int = 2) -> DataFrame:
    """Over stars, the median and the 90th percentile of the median absolute residual in their cores."""
    core = boxed(points, px, radius).groupBy("frame_id", "point").agg(F.percentile(F.abs(F.col("value").cast("double")), 0.5).alias("core"))
    return core.groupBy("frame_id").agg(F.percentile("core", 0.5).alias("median"), F.percentile("core", 0.9).alias("p90"))


def cross_match(reference: DataFrame, science: DataFrame, radius: int = 2) -> DataFrame:
    """For each reference point the nearest science point within radius; ties go to the brighter, then to y and x.

    Points are (frame_id, point, px, py, flux). Science points enter the nine cells around theirs, of a side of radius,
    so the range join is an equi-join on cells. Reference points without a match are left out.
    """
    side = max(radius, 1)
    cell = lambda c: F.floor(F.col(c) / side).cast("int")
    step = F.sequence(F.lit(-1), F.lit(1))
    s = science.select("frame_id", F.col("point").alias("s_point"), F.col("px").alias("s_x"), F.col("py").alias("s_y"), F.col("flux").alias("s_flux"), cell("px").alias("cx"), cell("py").alias("cy"))
    s = s.withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).withColumns({"cx": F.col("cx") + F.col("i"), "cy": F.col("cy") + F.col("j")}).drop("i", "j")
    r = reference.withColumns({"cx": cell("px"), "cy": cell("py")})
    d2 = (F.col("px") - F.col("s_x")) ** 2 + (F.col("py") - F.col("s_y")) ** 2
    near = r.join(s, ["frame_id", "cx", "cy"]).withColumn("d2", d2.cast("long")).where(F.col("d2") <= radius * radius)
    first = F.row_number().over(Window.partitionBy("frame_id", "point").orderBy("d2", F.desc("s_flux"), "s_y", "s_x"))
    return near.withColumn("_n", first).where("_n = 1").select("frame_id", "point", "px", "py", "s_point", "d2")


def nearest_bright(points: DataFrame, bright: DataFrame, out: str = "bright_star_dist") -> DataFrame:
    """The distance from each point (frame_id, point, px, py) to the nearest bright star of its frame; infinity if none.

    A frame's bright stars are one array, as many as the selection allows, that each point scans.
    """
    stars = bright.groupBy("frame_id").agg(F.collect_list(F.struct(F.col("px").cast("double").alias("bx"), F.col("py").cast("double").alias("by"))).alias("_stars"))
    d2 = F.array_min(F.transform("_stars", lambda s: (F.col("px") - s["bx"]) ** 2 + (F.col("py") - s["by"]) ** 2))
    return points.join(stars, "frame_id", "left").withColumn(out, F.coalesce(F.sqrt(d2), F.lit(float("inf")))).drop("_stars")

