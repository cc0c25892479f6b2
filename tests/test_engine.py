"""The engine end to end on synthetic pairs: transients kept, clean elsewhere, apply equals subtract."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellarframe.functions.basis import Basis, basis_stack
from stellarframe.functions.spline import Spline, fields
from stellarframe.operators import synth, tiles
from stellarframe.plans.engine import Subtractor, subtract_pairs

KW = dict(n_max=2, n_knots=3, stamp_radius=8, lambda_grid=tuple(np.logspace(-4, 4, 5)), cv_folds=3, tile=128, block=64)
N = 160


def pair_of(spark, science, reference, variance=9.0, s_mask=None, r_mask=None, frame="a", size=128):
    var = None if variance is None else np.full(science.shape, variance)
    return tiles.from_array(spark, {frame: {"s_value": science, "s_variance": var, "s_mask": s_mask, "r_value": reference, "r_variance": var, "r_mask": r_mask}}, size)


@pytest.fixture(scope="module")
def run(spark):
    y, x = np.mgrid[30:N:33, 30:N:33]
    stars = np.column_stack([x.ravel(), y.ravel(), np.full(x.size, 12000.0)])
    rng = np.random.default_rng(3)
    reference, science = (synth.render(stars, (N, N), s) + 120 + rng.normal(0, 3, (N, N)) for s in (1.6, 2.2))
    science += synth.render(np.array([(46, 110, 6000.0)]), (N, N), 2.2)
    pair = pair_of(spark, science, reference).persist()
    engine = Subtractor(score=True, **KW)
    return engine, pair, engine.subtract(pair), science, reference, stars


def test_fit_is_sound(run):
    s = run[2].solutions.collect()
    assert len(s) == 1 and s[0].direction == "reference" and s[0].n_stamps_used >= 8
    assert abs(s[0].reduced_chi2 - 1) < 0.25
    spline, sums = Spline(s[0].knots), np.array(s[0].component_sums)
    scale = spline.design([(80, 80)]) @ fields(s[0].theta, len(sums))[:, : len(sums)] @ sums
    assert abs(scale[0] - 1) < 0.05


def test_difference_is_the_model(run):
    engine, pair, result, science, reference, _ = run
    s = result.solutions.first()
    basis = Basis(s.beta, s.n_max, s.radius)
    y, x = np.mgrid[:N, :N]
    along = (Spline(s.knots).design(np.column_stack([x.ravel(), y.ravel()])) @ fields(s.theta, len(basis))).T.reshape(-1, N, N)
    want = science - (along[:-1] * basis_stack(reference.astype(np.float32), basis)).sum(axis=0) - along[-1]
    assert np.abs(tiles.to_array(result.difference, "value") - want).max() < 0.02
    var = tiles.to_array(result.difference, "variance")
    kernel = np.tensordot(along[:-1, 96, 96], basis.kernels, axes=1)
    assert abs(var[96, 96] - 9 * (1 + (kernel**2).sum())) < 0.05


def test_transient_is_found(run):
    result = run[2]
    rows = result.source_catalog.collect()
    best = max(rows, key=lambda r: r.peak_snr)
    assert np.hypot(best.x - 46, best.y - 110) < 1.5 and best.peak_snr > 10
    assert abs(best.flux - 6000) < 1200 and len(rows) <= 4


def test_apply_equals_subtract(spark, run):
    engine, pair, result, *_ = run
    again = engine.apply(result.solutions, pair)
    a, b = (tiles.to_array(r.difference, "value") for r in (result, again))
    assert np.array_equal(a, b)
    other = pair_of(spark, np.zeros((64, 64)), np.zeros((64, 64)))
    assert engine.apply(result.solutions, other).difference.count() == 0


def test_whitening_removes_correlation(spark, run):
    from stellarframe.operators import pixels

    engine, pair, result, *_ = run
    rng = np.random.default_rng(5)
    s, r = rng.normal(0, 3, (2, N, N))
    noise = pair_of(spark, s, r)
    plain = engine.apply(result.solutions, noise)
    white = Subtractor(decorrelate=True, **KW).apply(result.solutions, noise)
    acf = [pixels.autocorrelation(tiles.to_pixels(x.difference, ["value"])).first() for x in (plain, white)]
    assert acf[0].acf_x > 0.02 and abs(acf[1].acf_x) < 0.02 and abs(acf[1].acf_y) < 0.02
    d, v = tiles.to_array(white.difference, "value"), tiles.to_array(white.difference, "variance")
    assert abs((d / np.sqrt(v)).std() - 1) < 0.05


def test_masks_grow_and_exact_pixels_are_filled(spark, run):
    engine, _, result, science, reference, _ = run
    s_mask, r_mask = np.zeros((2, N, N), int)
    s_mask[30, 40] = 4
    r_mask[130, 127] = 1
    bad = reference.copy()
    bad[130, 127] = np.nan
    out = engine.apply(result.solutions, pair_of(spark, science, bad, s_mask=s_mask, r_mask=r_mask))
    mask, value, var = (tiles.to_array(out.difference, c) for c in ("mask", "value", "variance"))
    r = result.solutions.first().radius
    assert mask[30, 40] == 4 and mask[30, 41] == 0
    box = mask[130 - r : 131 + r, 127 - r : 128 + r]
    assert (box.astype(int) & 1).all() and not mask[130, 128 + r].astype(int) & 1
    assert (mask[:r].astype(int) & 16).all() and not mask[r, r].astype(int) & 16
    assert var[130, 127] == 0 and value[130, 127] == value[30, 40] and abs(value[130, 127]) < 3
    assert var[130, 128] > 0


def test_many_frames_and_options(spark, run):
    _, _, _, science, reference, _ = run
    frames = {f: {"s_value": (science if f == "b" else reference), "s_variance": None, "s_mask": None, "r_value": (reference if f == "b" else science), "r_variance": None, "r_mask": None} for f in ("b", "c")}
    both = tiles.from_array(spark, frames, 128)
    out = subtract_pairs(both, **KW)
    assert {r.frame_id: r.direction for r in out.solutions.collect()} == {"b": "reference", "c": "science"}
    d = {f: tiles.to_array(out.difference, "value", f) for f in ("b", "c")}
    assert d["b"][110, 46] > 50 and d["c"][110, 46] < -50
    assert out.difference.where("variance is not null or mask is not null").count() == 0
    with pytest.raises(ValueError):
        Subtractor(**KW).fit(both, direction="up")


def test_tiles_round_trip(spark):
    a = np.arange(70 * 90, dtype=float).reshape(70, 90)
    t = tiles.from_array(spark, {"f": {"value": a, "mask": (a % 7).astype(int)}}, 32)
    px = tiles.to_pixels(t, ["value", "mask"])
    back = tiles.to_tiles(px, ["value", "mask"], 32)
    assert np.array_equal(tiles.to_array(back, "value"), a) and np.array_equal(tiles.to_array(back, "mask"), a % 7)
    assert px.where((F.col("y") * 90 + F.col("x")) != F.col("value")).count() == 0
