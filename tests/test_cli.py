"""The command line, results as FITS files, provenance, and frames as a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellarframe import cli
from stellarframe.operators import synth, tiles
from stellarframe.plans import provenance
from stellarframe.plans.engine import Subtractor, load_solutions
from stellarframe.sources import fits
from stellarframe.streaming.frames import subtract_stream

N = 128
OPTIONS = "--n-max 2 --n-knots 3 --stamp-radius 7 --cv-folds 3 --block 64".split()


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """A subtraction on the command line, with its files."""
    home = tmp_path_factory.mktemp("cli")
    y, x = np.mgrid[24:N:26, 24:N:26]
    stars = np.column_stack([x.ravel(), y.ravel(), np.full(x.size, 9000.0)])
    rng = np.random.default_rng(4)
    reference, science = (synth.render(stars, (N, N), s) + 100 + rng.normal(0, 3, (N, N)) for s in (1.5, 2.0))
    science += synth.render(np.array([(37, 89, 5000.0)]), (N, N), 2.0)
    for name, image in (("science", science), ("reference", reference)):
        fits.write(str(home / f"{name}.fits"), image, np.full((N, N), 9.0))
    said = cli.main(["subtract", *(str(home / f"{n}.fits") for n in ("science", "reference", "out")), "--score", "--save-solution", str(home / "solution"), *OPTIONS])
    return home, said


def test_result_file(run, capsys):
    home, said = run
    raw = (home / "out.fits").read_bytes()
    got, units = fits.parse(raw), list(fits.units(raw))
    assert said == 0 and got["value"].shape == (N, N) and got["variance"].min() > 9
    assert [h.get("EXTNAME") for h, _ in units] == [None, "VARIANCE", "SCORE", "CATALOG"]
    head, score = units[0][0], units[2][1]
    assert head["DIRECT"] == "reference" and head["NSTAMPS"] > 5 and 0.7 < head["CHI2"] < 1.3 and head["SCIENCE"] == "science.fits"
    table = fits.read_table(raw, "CATALOG")
    best = table.loc[table.peak_snr.idxmax()]
    assert np.hypot(best.x - 37, best.y - 89) < 1.5 and np.isclose(score[int(best.peak_y), int(best.peak_x)], best.peak_snr, rtol=1e-5)
    assert table.is_dipole.dtype == bool
    assert cli.main(["info", str(home / "out.fits")]) == 0 and "value: 128 x 128" in capsys.readouterr().out


def test_apply_gives_the_same(run):
    home, _ = run
    assert cli.main(["apply", str(home / "solution"), str(home / "science.fits"), str(home / "reference.fits"), str(home / "again.fits"), *OPTIONS]) == 0
    a, b = (fits.read(str(home / f"{n}.fits"))["value"] for n in ("out", "again"))
    assert np.array_equal(a, b)


def test_errors(run, capsys):
    home, _ = run
    files = [str(home / f"{n}.fits") for n in ("science", "reference", "out")]
    assert cli.main(["subtract", *files]) == 2 and "exists" in capsys.readouterr().err
    with pytest.raises(SystemExit) as e:
        cli.main(["subtract", str(home / "none.fits"), files[1], str(home / "x.fits")])
    assert e.value.code == 2
    fits.write(str(home / "small.fits"), np.zeros((4, 5)))
    assert fits.shape(str(home / "small.fits")) == (4, 5)
    assert cli.main(["subtract", str(home / "small.fits"), files[1], str(home / "x.fits")]) == 1 and "shape" in capsys.readouterr().err


def test_provenance():
    cards = provenance.environment()
    assert cards["SPARK"] and cards["PYTHON"] and (provenance.commit() is None or len(provenance.commit().rstrip("+")) == 40)


def test_stream_takes_each_file_once(spark, run, tmp_path):
    home, _ = run
    sides = [fits.read_tiles(spark, str(home / f"{n}.fits")) for n in ("science", "reference")]
    named = [df.select(*tiles.HEAD, *(F.col(c).alias(f"{p}_{c}") for c in ("value", "variance", "mask"))).withColumn("frame_id", F.lit("frame")) for df, p in zip(sides, "sr", strict=True)]
    pair = named[0].join(named[1].select("ty", "tx", "r_value", "r_variance", "r_mask"), ["ty", "tx"]).select(*tiles.HEAD, *named[0].columns[9:], "r_value", "r_variance", "r_mask")
    pair.coalesce(1).write.parquet(str(tmp_path / "in"))
    solutions, seen = load_solutions(spark, str(home / "solution")), []
    engine = Subtractor(n_max=2, n_knots=3, stamp_radius=7, block=64)
    schema = pair.schema
    for _ in range(2):  # the second run finds nothing new
        query = subtract_stream(spark, str(tmp_path / "in"), schema, solutions, engine, lambda r, k: seen.append(tiles.to_array(r.difference, "value")), str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
    assert len(seen) == 1 and np.allclose(seen[0], fits.read(str(home / "out.fits"))["value"], atol=1e-3)
