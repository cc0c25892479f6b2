import numpy as np
import pytest

from stellarframe.operators import tiles
from stellarframe.sources import fits, inputs


@pytest.fixture
def files(tmp_path):
    rng = np.random.default_rng(1)
    frames = {}
    for name in ("a", "b"):
        frames[name] = {"value": rng.normal(size=(5, 7)).astype(np.float32), "variance": np.full((5, 7), 2.0, np.float32), "mask": rng.integers(0, 200, (5, 7)).astype(np.uint8)}
        fits.write(str(tmp_path / f"{name}.fits"), **frames[name], cards={"OBJECT": "x"})
    return tmp_path, frames


def test_round_trip(files):
    path, frames = files
    for name, layers in frames.items():
        got = fits.read(str(path / f"{name}.fits"))
        assert all(np.array_equal(got[k], a) for k, a in layers.items())
    plain = str(path / "c.fits")
    fits.write(plain, np.arange(6.0).reshape(2, 3))
    got = fits.read(plain)
    assert got["value"].shape == (2, 3) and got["variance"] is None and got["mask"] is None
    with pytest.raises(FileExistsError):
        fits.write(plain, np.zeros((2, 2)))
    fits.write(plain, np.zeros((2, 2)), overwrite=True)


def test_difference_extension_and_errors():
    empty = fits._header({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0})
    body = fits.encode(np.ones((3, 4)), mask=np.ones((3, 4), int))
    ext = body.replace(b"SIMPLE  =                    T", b"XTENSION= 'IMAGE   '          ", 1).replace(b"EXTEND  =                    T", b"EXTNAME = 'DIFFERENCE'        ", 1)
    assert fits.parse(empty + ext)["value"].shape == (3, 4)
    with pytest.raises(ValueError):
        fits.parse(empty)


def test_distributed_reads(spark, files):
    path, frames = files
    t = fits.read_tiles(spark, str(path), 4)
    for name, layers in frames.items():
        for k, a in layers.items():
            assert np.array_equal(tiles.to_array(t, k, name).astype(a.dtype), a)
    fits.register(spark)
    px = spark.read.format("fits").load(str(path / "a.fits"))
    assert px.count() == 35 and abs(px.agg({"value": "sum"}).first()[0] - float(frames["a"]["value"].sum())) < 1e-4


def test_inputs(spark, tmp_path):
    m = np.ma.MaskedArray(np.ones((4, 5)), mask=np.eye(4, 5, dtype=bool))
    got = inputs.as_layers(m)
    assert got["mask"].sum() == 4 and got["variance"] is None
    with pytest.raises(ValueError):
        inputs.as_layers(np.ones(3))
    with pytest.raises(ValueError):
        inputs.pair(spark, np.ones((3, 3)), np.ones((3, 4)))
    p = inputs.pair(spark, np.full((4, 5), 8.0), m, gain=2.0, read_noise=1.0)
    assert tiles.to_array(p, "s_variance")[0, 0] == 5 and p.first()["s_mask"] is None
    (tmp_path / "xy.txt").write_text("1.7 2\n# no\n3\t4 5\n\n")
    assert sorted((r.x, r.y) for r in inputs.positions(spark, str(tmp_path / "xy.txt")).collect()) == [(1, 2), (3, 4)]
