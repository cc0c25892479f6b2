"""Statistics on tiles against those on pixel rows and plain Python."""

import numpy as np
import pytest

from stellarframe.functions.solve import least_on_grid
from stellarframe.operators import pixels, tiles


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(-3, 50, (70, 90)).astype(np.float32)
    a[3, 5:20], a[40, 41] = np.nan, np.inf
    mask = (rng.random((70, 90)) < 0.1).astype(int)
    flat = np.zeros((70, 90), np.float32)
    flat[0, :7] = -0.0
    return tiles.from_array(spark, {"a": {"value": a, "mask": mask}, "flat": {"value": flat, "mask": None}, "none": {"value": a * np.nan, "mask": mask}}, 32)


def test_median_at_and_background(frames):
    px = tiles.to_pixels(frames, ["value", "mask"])
    for got, want in ((tiles.median_at(frames), pixels.fill_value(px)), (tiles.background(frames, 1000), pixels.background(px, 1000))):
        rows = [{r.frame_id: tuple(r)[1:] for r in df.select(*want.columns).collect()} for df in (got, want)]
        assert set(rows[0]) == {"a", "flat", "none"}
        for f in rows[0]:
            assert rows[0][f] == pytest.approx(rows[1][f], rel=1e-12)


def test_the_grid_is_searched_to_the_end_of_its_valley():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 25):
        for _ in range(40):
            curve = np.abs(np.arange(n) - rng.integers(n) - rng.random() * 0.9) ** rng.uniform(0.5, 2)
            seen = []
            for start in (None, int(rng.integers(n))):
                place, told = least_on_grid(lambda i, seen=seen, curve=curve: seen.append(i) or curve[i], n, start)
                assert place == int(np.argmin(curve)) and told[place] == curve[place]
            if n == 25 and place == start:
                assert len(set(seen)) < n
