"""sigma_clip and gaussianity against plain Python on a small frame with outliers, ties and values that are not finite."""

import math
import random
import statistics

from stellarframe.operators import pixels

MAD = 1.4826  # as the reference has it


def frame():
    rng = random.Random(4)
    values = [rng.gauss(0.2, 1.1) for _ in range(400)] + [9.0, -12.5, 30.0, 7.0] + [0.5] * 20
    return values, [*values, float("nan"), float("inf"), None]


def robust(values):
    middle = statistics.median(values)
    return middle, MAD * statistics.median(abs(v - middle) for v in values)


def test_sigma_clip_by_hand(spark):
    values, rows = frame()
    got = pixels.sigma_clip(spark.createDataFrame([("f", v) for v in rows], "frame_id string, value double")).first()
    kept, lo, hi = values, -math.inf, math.inf
    for _ in range(6):
        middle, sigma = robust(kept)
        lo, hi = max(lo, middle - 4 * sigma), min(hi, middle + 4 * sigma)
        kept = [v for v in values if lo <= v <= hi]
    middle, sigma = robust(kept)
    assert got.n == len(kept) < len(values)
    assert math.isclose(got["median"], middle, rel_tol=1e-9) and math.isclose(got.sigma, sigma, rel_tol=1e-6)


def test_gaussianity_by_hand(spark):
    values, rows = frame()
    got = pixels.gaussianity(spark.createDataFrame([("f", v) for v in rows], "frame_id string, value double")).first()
    core = values
    for _ in range(6):
        middle, sigma = robust(core)
        core = [v for v in core if abs(v - middle) < 4 * sigma]
    n, mean = len(core), statistics.fmean(core)
    moment = lambda k: sum((v - mean) ** k for v in core) / n
    z = sorted((v - mean) / math.sqrt(moment(2)) for v in core)
    ks = max(abs((k + 1) / n - 0.5 * (1 + math.erf(v / math.sqrt(2)))) for k, v in enumerate(z))
    assert n < len(values)
    assert math.isclose(got.robust_sigma, robust(values)[1], rel_tol=1e-6)
    assert math.isclose(got.skewness, moment(3) / moment(2) ** 1.5, rel_tol=1e-9)
    assert math.isclose(got.kurtosis, moment(4) / moment(2) ** 2 - 3, rel_tol=1e-9)
    assert math.isclose(got.ks, ks, abs_tol=1e-6)
