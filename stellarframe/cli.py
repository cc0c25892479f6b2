"""Command line: subtract, apply and info on FITS files."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.engine import Subtractor, configure_logging, load_solutions, save_solutions, timed
from .sources import fits, inputs

_NUMBERS = {"n_max": int, "beta": float, "n_knots": int, "stamp_radius": int, "threshold_sigma": float, "max_stamps": int, "saturation": float, "cv_folds": int, "spatial_scale": float, "block": int}


def _parser() -> argparse.ArgumentParser:
    from . import __version__

    p = argparse.ArgumentParser(prog="stellarframe")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("-v", "--verbose", action="count", default=0)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("subtract", "apply"):
        c = sub.add_parser(name)
        if name == "apply":
            c.add_argument("solution")
        c.add_argument("science")
        c.add_argument("reference")
        c.add_argument("output")
        c.add_argument("--overwrite", action="store_true")
        c.add_argument("--gain", type=float)
        c.add_argument("--read-noise", type=float, default=0.0)
        c.add_argument("--score", action="store_true")
        c.add_argument("--decorrelate", action="store_true")
        c.add_argument("--save-solution")
        c.add_argument("--catalog")
        for key, kind in _NUMBERS.items():
            c.add_argument(f"--{key.replace('_', '-')}", type=kind)
    sub.add_parser("info").add_argument("image")
    return p


def _readable(path: str, what: str, read):
    try:
        return read(path)
    except (OSError, ValueError) as e:
        print(f"cannot read {what} {path}: {e}", file=sys.stderr)
        raise SystemExit(2) from e


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    configure_logging(args.verbose)
    if args.command == "info":
        import numpy as np

        got = _readable(args.image, "image", fits.read)
        for name, a in got.items():
            if a is not None:
                extra = f", {np.count_nonzero(a)} masked ({np.count_nonzero(a) / a.size:.2%})" if name == "mask" else ""
                print(f"{name}: {a.shape[1]} x {a.shape[0]}, min {np.nanmin(a):g}, median {np.nanmedian(a):g}, max {np.nanmax(a):g}{extra}")
        return 0
    if os.path.exists(args.output) and not args.overwrite:
        print(f"{args.output} exists; --overwrite replaces it", file=sys.stderr)
        return 2
    shapes = [_readable(path, what, fits.shape) for path, what in ((args.science, "science"), (args.reference, "reference"))]
    if shapes[0] != shapes[1]:
        print("science and reference must share a shape", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("stellarframe").getOrCreate()
    engine = Subtractor(score=args.score, decorrelate=args.decorrelate, **{k: v for k in _NUMBERS if (v := getattr(args, k)) is not None})
    try:
        sides = [fits.read_tiles(spark, path, engine.tile, "*").withColumn("frame_id", F.lit("frame")) for path in (args.science, args.reference)]
        if args.gain is not None:
            sides = [inputs.with_variance(side, args.gain, args.read_noise) for side in sides]
        pair = inputs.pair_tiles(*sides).persist()
        with timed(args.command):
            if args.command == "apply":
                result = engine.apply(load_solutions(spark, args.solution), pair)
            else:
                result = engine.subtract(pair, inputs.positions(spark, args.catalog) if args.catalog else None)
            s = result.solutions.first()
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if s is None:
        print("no stamps selected: lower the threshold, give a catalog or widen the match", file=sys.stderr)
        return 1
    options = {"SCIENCE": os.path.basename(args.science), "REFERNCE": os.path.basename(args.reference)}
    with open(args.output, "wb") as f:
        f.write(result.to_fits(options).first().content)
    if args.save_solution:
        save_solutions(result.solutions, args.save_solution, "overwrite" if args.overwrite else "errorifexists")
    print(f"direction {s.direction}, beta {s.beta:.3f}, lambda {s.lam:.3g}, stamps {s.n_stamps_used} used and {s.n_stamps_rejected} rejected, reduced chi2 {s.reduced_chi2:.3f}")
    if result.source_catalog is not None:
        print(f"sources: {result.source_catalog.count()}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
