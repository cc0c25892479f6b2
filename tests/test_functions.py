"""Numeric functions against plain NumPy and analytic limits."""

import numpy as np
import pytest

from stellarframe.functions import fourier
from stellarframe.functions.basis import Basis, basis_stack, convolve_separable, correlate2d, default_radius
from stellarframe.functions.solve import Normal, solve_at, solve_cv, solve_gls, solve_gls_cv, solve_gls_gcv
from stellarframe.functions.spline import Spline, evaluate, fields, green, grid_knots, local_kernel, photometric_scale_at
from stellarframe.operators import synth
from stellarframe.operators.fit import knots_along
from stellarframe.operators.noise import psf_fwhm


def test_basis_is_orthonormal_and_ordered():
    b = Basis(2.0, 4, 20)
    assert np.allclose(b.rows @ b.rows.T, np.eye(5), atol=1e-6)
    assert b.orders[:4] == [(0, 0), (1, 0), (0, 1), (2, 0)] and len(b) == 15
    assert np.allclose(b.sums, b.kernels.sum(axis=(1, 2)))
    assert default_radius(0.1, 0) == 3 and Basis(2.0, 2).radius == default_radius(2.0, 2)
    with pytest.raises(ValueError):
        Basis(0.0, 1)


def test_convolution_of_an_impulse_is_the_kernel():
    b = Basis(2.0, 3, 6)
    image = np.zeros((13, 13))
    image[6, 6] = 1
    assert np.allclose(basis_stack(image, b), b.kernels)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(17, 13))
    kx, ky = rng.normal(size=(2, 5))
    full = np.zeros((21, 17))
    for y, k in enumerate(ky):
        for z, q in enumerate(kx):
            full[y : y + 17, z : z + 13] += k * q * x
    assert np.allclose(convolve_separable(x, kx, ky), full[2:-2, 2:-2])
    assert np.allclose(correlate2d(np.pad(x, 2), np.outer(ky, kx)[::-1, ::-1]), full[2:-2, 2:-2])


def test_splines():
    knots = grid_knots(0, 0, 90, 60, 4, 4)
    assert knots.shape == (16, 2) and knots[1].tolist() == [30, 0] and grid_knots(0, 0, 10, 10, 1, 3)[0].tolist() == [5, 0]
    s = Spline(knots)
    assert np.linalg.eigvalsh(s.penalty).min() > -1e-9 and np.allclose(s.penalty[-3:], 0)
    assert green(np.array([0.0, 1.0]))[0] == 0 and abs(s.min_spacing() - 20) < 1e-9
    rng = np.random.default_rng(1)
    points = rng.uniform(0, 60, (80, 2))
    plane = 3 + 0.2 * points[:, 0] - 0.1 * points[:, 1]
    for lam in (0.0, 1e6):
        assert np.allclose(evaluate(knots, points, s.fit(points, plane, lam)), plane, atol=1e-5)
    with pytest.raises(ValueError):
        Spline(knots[:2])


def system(seed=0, n=400, nc=2):
    rng = np.random.default_rng(seed)
    knots = grid_knots(0, 0, 50, 50, 3, 3)
    points, bn = rng.uniform(0, 50, (n, 2)), rng.normal(size=(n, nc))
    theta = rng.normal(size=9 * (nc + 1))
    c = fields(theta, nc)
    v = Spline(knots).design(points) @ c
    return knots, points, (v[:, :nc] * bn).sum(axis=1) + v[:, nc] + rng.normal(0, 0.1, n), rng.uniform(0.5, 2, n), bn, theta


def test_normal_equations_and_limits():
    knots, points, target, weights, bn, theta = system()
    d = Spline(knots).design(points)
    x = np.hstack([d * bn[:, [0]], d * bn[:, [1]], d])
    want = np.linalg.solve(x.T @ (weights[:, None] * x), x.T @ (weights * target))
    assert np.allclose(solve_gls(knots, points, target, weights, bn, 0.0).theta, want, atol=1e-7)
    assert abs(solve_gls(knots, points, target, weights, bn, 0.0).effective_dof - 27) < 1e-3
    assert abs(solve_gls(knots, points, target, weights, bn, 1e9).effective_dof - 9) < 0.5
    grid = np.logspace(-4, 4, 9)
    best = solve_gls_gcv(knots, points, target, weights, bn, grid)
    assert best.lam == grid[int(np.argmin([solve_gls(knots, points, target, weights, bn, lam).gcv for lam in grid]))]
    a, b = (Normal.of(d[s], bn[s], target[s], weights[s]) for s in (slice(0, 150), slice(150, None)))
    whole = Normal.of(d, bn, target, weights)
    assert np.allclose((a + b).m, whole.m) and (a + b).n == whole.n and np.allclose((whole - a).rhs, b.rhs)
    with pytest.raises(ValueError):
        solve_gls_gcv(knots, points, target, weights, bn, [])


def test_group_cv_leaves_groups_out():
    knots, points, target, weights, bn, _ = system(3)
    group, grid, spline = np.arange(400) % 4, [1e-3, 1.0, 1e3], Spline(knots)
    got = solve_gls_cv(knots, points, target, weights, bn, grid, group, 4)
    d, errors = spline.design(points), []
    for lam in grid:
        e = 0.0
        for g in range(4):
            theta = solve_at(Normal.of(d[group != g], bn[group != g], target[group != g], weights[group != g]), spline, lam).theta
            v = d[group == g] @ fields(theta, 2)
            e += (weights[group == g] * (target[group == g] - (v[:, :2] * bn[group == g]).sum(axis=1) - v[:, 2]) ** 2).sum()
        errors.append(e / 400)
    assert np.allclose(got.curve, errors, rtol=1e-6) and got.lam == grid[int(np.argmin(errors))]
    one = solve_cv([Normal.of(d, bn, target, weights)], spline, grid)
    assert one.lam == solve_gls_gcv(knots, points, target, weights, bn, grid).lam


def test_stamped_moments_equal_a_constant_design():
    knots, _, target, weights, bn, _ = system(5, 60)
    d = Spline(knots).design([(20, 30)])
    a, b = Normal.of_stamp(d[0], bn, target, weights), Normal.of(np.repeat(d, 60, axis=0), bn, target, weights)
    assert np.allclose(a.m, b.m) and np.allclose(a.rhs, b.rhs) and abs(a.energy - b.energy) < 1e-9


def test_kernels_at_points():
    knots, *_, theta = system(7)
    basis = Basis(1.5, 1)
    theta = np.concatenate([theta, theta[:9]])
    k = local_kernel(knots, theta, basis, 10, 40)
    assert np.isclose(k.sum(), photometric_scale_at(knots, theta, basis.sums, [(10, 40)])[0])


def test_whitening_flattens_the_noise():
    kernel, n = synth.gaussian_psf(1.6, 6), 64
    power = fourier.kernel_power(kernel, n)
    f = fourier.whitening_filter(kernel, 4.0, 9.0, n)
    assert np.allclose(f**2 * (4 + 9 * power), 4 + 9 * (kernel**2).sum())
    assert np.allclose(fourier.whitening_filter(kernel, 0.0, 0.0, n), 0)
    w = fourier.whitening_kernel(kernel, 4.0, 9.0, n)
    image = np.zeros((n, n))
    image[n // 2, n // 2] = 1
    assert np.allclose(fourier.decorrelate_block(image, kernel, 4.0, 9.0), w, atol=1e-9)
    assert np.isclose(fourier.whiten_psf(synth.gaussian_psf(1.5, 8), kernel, 4.0, 9.0, 64).sum(), 1)
    assert fourier.block_origins(100, 32) == [0, 16, 32, 48, 64, 68] and fourier.block_origins(20, 32) == [0]
    assert np.isclose(fourier.hann(8)[0], 0.5 * (1 - np.cos(np.pi / 8)))
    with pytest.raises(ValueError):
        fourier.block_origins(100, 24)
    assert fourier.upper_median(np.array([1, 2, 3, 4])) == 3 and fourier.upper_median(np.array([]), 0.0) == 0


def test_small_rules():
    assert abs(psf_fwhm(synth.gaussian_psf(2.0, 12)) - 4.71) < 0.03
    assert knots_along(1000, 5, None) == 5 and knots_along(1000, 9, 250) == 5 and knots_along(100, 9, 1000) == 3
    stars = synth.sample_starfield((200, 200), 20, np.random.default_rng(0), min_separation=12)
    d = np.sqrt(((stars[:, None, :2] - stars[None, :, :2]) ** 2).sum(axis=2)) + 1e9 * np.eye(20)
    assert d.min() >= 12
    assert abs(synth.render([(50, 50, 1000)], (100, 100), 2.0).sum() - 1000) < 1
