"""The matching kernel of each pair of frames, fitted on its stamps.

Stamps gather their pixels from the tiles under them; a pair's stamps, bounded in number, then meet in one task that
iterates on arrays. Pairs run side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Basis, basis_stack, correlate2d
from ..functions.fourier import upper_median
from ..functions.solve import Normal, solve_cv, solve_gcv
from ..functions.spline import Spline, fields, grid_knots
from . import tiles
from .schema import MAD_TO_SIGMA, SOLUTION

PAIR = ["t_value", "t_variance", "t_mask", "c_value", "c_variance", "c_mask"]
STAMP_PIXELS = "stamp int, x int, y int, wy0 int, wx0 int, py array<int>, px array<int>, target array<double>, var_t array<double>, var_c array<double>, bn array<double>, noise array<double>, noise_w int, has_var boolean, has_cvar boolean"


def stamp_windows(pair: DataFrame, stamps: DataFrame, margin: str, size: int = tiles.SIZE) -> DataFrame:
    """The tiles under each stamp (frame_id, stamp, x, y) widened by the column margin: an interval join as an equi-join on tiles."""
    m = F.col(margin)
    span = lambda c: F.sequence(F.floor((F.col(c) - m) / size).cast("int"), F.floor((F.col(c) + m) / size).cast("int"))
    at = stamps.withColumn("ty", F.explode(span("y"))).withColumn("tx", F.explode(span("x")))
    at = at.withColumns({"k1": F.col("stamp"), "k2": F.lit(0), "wy0": F.col("y") - m, "wx0": F.col("x") - m, "wh": 2 * m + 1, "ww": 2 * m + 1})
    return pair.join(at.withColumnsRenamed({"x": "sx", "y": "sy"}), ["frame_id", "ty", "tx"])


def stamp_pixels(pair: DataFrame, stamps: DataFrame, stamp_radius: int, n_max: int, size: int = tiles.SIZE) -> DataFrame:
    """One row for each stamp with its usable pixels and the convolved components there.

    stamps has beta, radius (of the basis) and fill (in place of bad pixels of the convolved frame) as columns.
    """
    windows = stamp_windows(pair, stamps.withColumn("_margin", F.col("radius") + stamp_radius), "_margin", size)

    def run(v: tiles.View) -> pd.DataFrame:
        basis = Basis(float(v.extra["beta"]), n_max, int(v.extra["radius"]))
        r = basis.radius
        conv, fine = v["c_value"], v.inside & np.isfinite(v["c_value"])
        if v["c_mask"] is not None:
            fine &= v["c_mask"] == 0
        patch = np.where(fine, conv, np.where(v.inside, float(v.extra["fill"]), 0.0))
        stack = basis_stack(patch, basis)[:, r:-r, r:-r]
        mid = slice(r, -r)
        target = v["t_value"][mid, mid]
        use = v.inside[mid, mid] & np.isfinite(target) & np.isfinite(stack).all(axis=0)
        for m in ("t_mask", "c_mask"):
            if v[m] is not None:
                use &= v[m][mid, mid] == 0
        layer = lambda n: np.zeros(target.shape) if v[n] is None else v[n][mid, mid]
        vt, vc = layer("t_variance"), layer("c_variance")
        has_c = v["c_variance"] is not None
        has = has_c or v["t_variance"] is not None
        if has:
            use &= vt + vc > 0
        noise = np.zeros(0)
        if has_c:
            w = v["c_variance"]
            clean = v.inside & np.isfinite(w) & (w > 0)
            if v["c_mask"] is not None:
                clean &= v["c_mask"] == 0
            noise = np.where(clean, w, 0.0).ravel()
        y, x = np.nonzero(use)
        if not len(y):
            return pd.DataFrame(columns=[c.split()[0] for c in STAMP_PIXELS.split(", ")])
        row = {"stamp": v.key[0], "x": int(v.extra["sx"]), "y": int(v.extra["sy"]), "wy0": v.y0 + r, "wx0": v.x0 + r, "py": y + v.y0 + r, "px": x + v.x0 + r}
        row |= {"target": target[use], "var_t": vt[use], "var_c": vc[use], "bn": stack[:, use].T.ravel(), "noise": noise, "noise_w": v.inside.shape[1], "has_var": has, "has_cvar": has_c}
        return pd.DataFrame([row])

    return tiles.gather(windows, PAIR, run, STAMP_PIXELS, ["beta", "radius", "fill", "sx", "sy"])


class Stamps:
    """The stamps of one pair as arrays; pixels of all stamps one after the other."""

    def __init__(self, rows: pd.DataFrame, nc: int):
        rows = rows.sort_values("stamp")
        self.x, self.y = rows.x.to_numpy(), rows.y.to_numpy()
        cat = lambda c: np.concatenate([np.asarray(a, float) for a in rows[c]])
        self.n = np.array([len(a) for a in rows.target])
        self.of = np.repeat(np.arange(len(rows)), self.n)
        self.points = np.column_stack([cat("px"), cat("py")])
        self.target, self.var_t, self.var_c = cat("target"), cat("var_t"), cat("var_c")
        self.bn = cat("bn").reshape(-1, nc)
        self.has_var, self.has_cvar = bool(rows.has_var.any()), bool(rows.has_cvar.any())
        self._noise = [np.asarray(a, float).reshape(-1, w) if len(a) else None for a, w in zip(rows.noise, rows.noise_w, strict=True)]
        self._origin = list(zip(rows.wy0, rows.wx0, strict=True))

    def noise_through(self, s: int, kernel: np.ndarray) -> np.ndarray:
        """The variance that the kernel brings to the pixels of stamp s."""
        if self._noise[s] is None:
            return np.zeros(self.n[s])
        full = correlate2d(self._noise[s], (kernel**2)[::-1, ::-1])
        at = self.points[self.of == s].astype(int)
        return full[at[:, 1] - self._origin[s][0], at[:, 0] - self._origin[s][1]]


def fit_stamps(s: Stamps, basis: Basis, knots: np.ndarray, grid, stamp_radius: int, clip_sigma: float = 4.0, clip_iterations: int = 5, min_stamps: int = 5, cv_folds: int = 0, stamped: bool | None = None) -> dict:
    """Solve, weigh anew by the noise that the kernel brings, reject stamps that fit badly, until nothing changes.

    stamped: use one row of the spatial design for each stamp; by default if knots are at least 16 stamps apart.
    Folds are dealt by stamp. A pass with variances is always followed by one with the kernel's own noise.
    """
    spline, nc, n_stamps = Spline(knots), len(basis), len(s.n)
    design = spline.design(s.points)
    weights = 1 / (s.var_t + s.var_c) if s.has_var else np.ones(len(s.target))
    accepted = np.ones(n_stamps, bool)
    chi2 = np.full(n_stamps, np.nan)
    passes = clip_iterations if clip_sigma > 0 else 0
    least = 1 if clip_iterations > 0 and s.has_var else 0
    floor = max(1, min(min_stamps, n_stamps))
    if stamped is None:
        stamped = spline.min_spacing() >= 16 * (2 * stamp_radius + 1) and cv_folds > 1
    start = None
    for turn in range(max(passes, least) + 1):
        use = accepted[s.of]
        folds = max(cv_folds, 1)

        def normal(fold: int, use=use, folds=folds) -> Normal:
            at = use & (s.of % folds == fold)
            if not stamped:
                return Normal.of(design[at], s.bn[at], s.target[at], weights[at])
            parts = [Normal.of_stamp(spline.design([s.points[p].mean(axis=0)])[0], s.bn[p], s.target[p], weights[p]) for k in np.unique(s.of[at]) if (p := np.flatnonzero(at & (s.of == k))).size]
            zero = Normal(np.zeros(((nc + 1) * len(spline),) * 2), np.zeros((nc + 1) * len(spline)))
            return sum(parts, zero)

        parts = [normal(f) for f in range(folds)]
        fit = solve_cv(parts, spline, grid, start) if folds > 1 else solve_gcv(parts[0], spline, grid)
        start = int(np.flatnonzero(np.asarray(grid) == fit.lam)[0])  # the next pass differs by few stamps
        c = fields(fit.theta, nc)
        values = design @ c
        residual = s.target - values[:, nc] - (values[:, :nc] * s.bn).sum(axis=1)
        total = np.bincount(s.of[use], (weights * residual**2)[use], n_stamps)
        active = accepted & (np.bincount(s.of[use], minlength=n_stamps) > 0)
        chi2 = np.where(active, total / np.maximum(s.n, 1), np.nan)
        n_pixels = int(use.sum())
        if s.has_cvar:
            at_stamps = spline.design(np.column_stack([s.x, s.y])) @ c
            for k in np.flatnonzero(active):
                noise = s.var_t[s.of == k] + s.noise_through(k, np.tensordot(at_stamps[k, :nc], basis.kernels, axes=1))
                weights[s.of == k] = np.where(noise > 0, 1 / np.where(noise > 0, noise, 1), weights[s.of == k])
        elif s.has_var:
            weights = np.where(s.var_t > 0, 1 / np.where(s.var_t > 0, s.var_t, 1), weights)
        reject: list[int] = []
        if turn < passes and active.sum() > floor:
            med = upper_median(chi2[active])
            limit = med + clip_sigma * MAD_TO_SIGMA * upper_median(np.abs(chi2[active] - med))
            worst = sorted(np.flatnonzero(active & (chi2 > limit)), key=lambda k: -chi2[k])
            reject = worst[: int(active.sum()) - floor]
        if (not reject and turn >= least) or turn >= max(passes, least):
            break
        accepted[reject] = False
    free = n_pixels - fit.effective_dof
    used = int((accepted & np.isfinite(chi2)).sum())
    return {"fit": fit, "chi2": chi2, "accepted": accepted, "n_used": used, "n_pixels": n_pixels, "reduced_chi2": fit.rss / free if free > 0 else float("nan")}


def fit_kernels(stamp_rows: DataFrame, frames: DataFrame, n_max: int, grid, stamp_radius: int, n_knots: int = 5, spatial_scale: float | None = None, **clip) -> DataFrame:
    """Solutions (SOLUTION) of all pairs. frames: (frame_id, width, height, beta, radius, direction)."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        f = df.iloc[0]
        basis = Basis(float(f.beta), n_max, int(f.radius))
        kx, ky = (knots_along(n, n_knots, spatial_scale) for n in (int(f.width), int(f.height)))
        knots = grid_knots(0, 0, f.width - 1, f.height - 1, kx, ky)
        s = Stamps(df, len(basis))
        got = fit_stamps(s, basis, knots, grid, stamp_radius, **clip)
        fit = got["fit"]
        row = {"frame_id": f.frame_id, "beta": basis.beta, "n_max": n_max, "radius": basis.radius, "knots": knots.ravel().tolist(), "theta": fit.theta.tolist(), "n_components": len(basis), "n_spatial": len(knots)}
        row |= {"lam": fit.lam, "gcv": fit.gcv, "effective_dof": fit.effective_dof, "rss": fit.rss, "component_sums": basis.sums.tolist(), "direction": f.direction, "height": int(f.height), "width": int(f.width)}
        row |= {"reduced_chi2": got["reduced_chi2"], "n_stamps_used": got["n_used"], "n_stamps_rejected": len(s.n) - got["n_used"], "stamp_x": s.x.tolist(), "stamp_y": s.y.tolist(), "stamp_chi2": got["chi2"].tolist(), "stamp_accepted": got["accepted"].tolist()}
        return pd.DataFrame([row | {"n_pixels": got["n_pixels"], "curve": [float(c) for c in fit.curve]}])

    return stamp_rows.join(frames, "frame_id").groupBy("frame_id").applyInPandas(run, SOLUTION)


def knots_along(extent: int, n_knots: int, spatial_scale: float | None) -> int:
    """Knots about spatial_scale apart, from 3 to n_knots."""
    return n_knots if not spatial_scale or spatial_scale <= 0 else int(np.clip(round((extent - 1) / spatial_scale) + 1, 3, n_knots))
