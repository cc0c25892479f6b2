"""Frames as tiles: a row holds a rectangle of every layer, so array code sees whole neighbourhoods.

gather() brings together what a window needs from the tiles under it: each tile sends only the part that a window asks for
(a halo of r pixels costs a strip of r), the parts meet by window key, and array code runs on the window. Frames of any
size and number spread over the cluster tile by tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fourier import upper_median
from .pixels import frame_sizes
from .schema import MAD_TO_SIGMA

SIZE = 256
HEAD = ["frame_id", "ty", "tx", "y0", "x0", "h", "w", "width", "height"]


def _field(name: str):
    return lambda p: p[name]


def _null_of(kind):
    return lambda v: F.lit(None).cast(kind)


def to_tiles(px: DataFrame, layers: Sequence[str] = ("value", "variance", "mask"), size: int = SIZE) -> DataFrame:
    """Tiles of dense pixel rows: HEAD and an array for each layer, rows of y first; an absent layer is all null."""
    keyed = px.join(frame_sizes(px), "frame_id").withColumns({"ty": F.floor(F.col("y") / size).cast("int"), "tx": F.floor(F.col("x") / size).cast("int")})
    got = keyed.groupBy("frame_id", "ty", "tx").agg(
        F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"), F.first("width").alias("width"), F.first("height").alias("height"),
        F.array_sort(F.collect_list(F.struct("y", "x", *layers))).alias("_p"),
    )
    return got.select(*HEAD, *(F.transform("_p", _field(c)).alias(c) for c in layers))


def to_pixels(tiles: DataFrame, layers: Sequence[str]) -> DataFrame:
    """The inverse of to_tiles: (frame_id, y, x, layers). The first layer must be there; nulls stand for others that are absent."""
    first, fields = layers[0], {f.name: f.dataType.elementType for f in tiles.schema.fields if f.name in layers}
    whole = [F.col(first), *(F.coalesce(F.col(c), F.transform(first, _null_of(fields[c]))).alias(c) for c in layers[1:])]
    one = tiles.select("frame_id", "y0", "x0", "w", F.posexplode(F.arrays_zip(*whole)).alias("_i", "_p"))
    return one.select("frame_id", (F.col("y0") + F.floor(F.col("_i") / F.col("w")).cast("int")).alias("y"), (F.col("x0") + F.pmod("_i", "w")).cast("int").alias("x"), *(F.col(f"_p.{c}").alias(c) for c in layers))


def from_array(spark, frames: dict[str, dict[str, np.ndarray | None]], size: int = SIZE) -> DataFrame:
    """Tiles of NumPy images: {frame_id: {layer: (H, W) array or None}}; mask layers are those whose name ends in mask."""
    rows, names = [], list(next(iter(frames.values())))
    for frame, layers in frames.items():
        h, w = next(a.shape for a in layers.values() if a is not None)
        for y0 in range(0, h, size):
            for x0 in range(0, w, size):
                th, tw = min(size, h - y0), min(size, w - x0)
                cuts = [None if a is None else (a[y0 : y0 + th, x0 : x0 + tw].ravel().astype(int).tolist() if n.endswith("mask") else a[y0 : y0 + th, x0 : x0 + tw].ravel().astype(float).tolist()) for n, a in layers.items()]
                rows.append((frame, y0 // size, x0 // size, y0, x0, th, tw, w, h, *cuts))
    kinds = ", ".join(f"{n} array<{'smallint' if n.endswith('mask') else 'float'}>" for n in names)
    return spark.createDataFrame(rows, f"frame_id string, ty int, tx int, y0 int, x0 int, h int, w int, width int, height int, {kinds}")


def to_array(tiles: DataFrame, layer: str, frame_id: str | None = None) -> np.ndarray:
    """One frame's layer on the driver, for tests and small frames."""
    rows = (tiles if frame_id is None else tiles.where(F.col("frame_id") == frame_id)).select(*HEAD, layer).collect()
    out = np.full((rows[0].height, rows[0].width), np.nan)
    for r in rows:
        if r[layer] is not None:
            out[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.array(r[layer], float).reshape(r.h, r.w)
    return out


def decimated(frame_tiles: DataFrame, step: int | None = None, samples: int = 1 << 18, extra: Sequence[str] = ()) -> DataFrame:
    """(frame_id, values, extra): of each tile the finite, unmasked values at every step-th place of the frame, counted along its rows.

    Without a step, one for which about `samples` places of a frame are used.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frame_tiles.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            values = []
            for r in df.itertuples(index=False):
                v = np.asarray(r.value, np.float32).reshape(r.h, r.w)
                k = step or max(1, int(r.width) * int(r.height) // samples)
                y, x = np.arange(r.y0, r.y0 + r.h, dtype=np.int64)[:, None], np.arange(r.x0, r.x0 + r.w)
                use = ((y * int(r.width) + x) % k == 0) & np.isfinite(v)
                if r.mask is not None:
                    use &= np.asarray(r.mask).reshape(r.h, r.w) == 0
                values.append(v[use])
            yield pd.DataFrame({"frame_id": df.frame_id, "values": pd.Series(values, dtype=object, index=df.index)} | {c: df[c] for c in extra})

    more = "".join(f", `{c}` {kinds[c]}" for c in extra)
    return frame_tiles.select(*HEAD, "value", "mask", *extra).mapInPandas(run, f"frame_id string, values array<float>{more}")


def background(frame_tiles: DataFrame, samples: int = 1 << 18) -> DataFrame:
    """A2 on tiles: (frame_id, median, sigma). A frame's samples, twice `samples` at most, meet in one task."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate([np.asarray(a, np.float64) for a in df["values"]])
        med = upper_median(v, 0.0)
        return pd.DataFrame({"frame_id": [df.frame_id.iloc[0]], "median": [med], "sigma": [MAD_TO_SIGMA * upper_median(np.abs(v - med), 0.0)]})

    return decimated(frame_tiles, None, samples).groupBy("frame_id").applyInPandas(run, "frame_id string, median double, sigma double")


def _ordered(v: np.ndarray) -> np.ndarray:
    """Single-precision numbers as unsigned integers in the same order."""
    bits = np.ascontiguousarray(v + np.float32(0), np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def median_at(frame_tiles: DataFrame, step: int = 7, out: str = "fill") -> DataFrame:
    """A3, A4 on tiles: (frame_id, out): the upper median of the good values at every step-th place; 0 if there are none.

    Exact, and no task sees more than 65,536 rows of a frame: the upper halves of the numbers' bits are counted first,
    then the lower halves of those that share the median's upper half.
    """

    def count(low: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                rows = []
                for r in df.itertuples(index=False):
                    bits = _ordered(np.asarray(r.values, np.float32))
                    part, n = np.unique(bits[bits >> 16 == r.high] & 0xFFFF if low else bits >> 16, return_counts=True)
                    rows.append(pd.DataFrame({"frame_id": r.frame_id, "part": part.astype(np.int64), "n": n.astype(np.int64)}))
                yield pd.concat(rows) if rows else pd.DataFrame({"frame_id": pd.Series([], dtype=object), "part": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})

        return run

    def pick(df: pd.DataFrame, rank: int) -> tuple[int, int]:
        """The part that holds the number of this rank, and its rank in the part."""
        df = df.sort_values("part")
        ends = df.n.cumsum().to_numpy()
        k = int(np.searchsorted(ends, rank, side="right"))
        return int(df.part.iloc[k]), rank - int(ends[k] - df.n.iloc[k])

    def upper(df: pd.DataFrame) -> pd.DataFrame:
        high, rank = pick(df, int(df.n.sum()) // 2)
        return pd.DataFrame({"frame_id": [df.frame_id.iloc[0]], "high": [high], "rank": [rank]})

    def lower(df: pd.DataFrame) -> pd.DataFrame:
        bits = np.uint32(int(df.high.iloc[0]) << 16 | pick(df, int(df["rank"].iloc[0]))[0])
        value = (bits ^ np.uint32(1 << 31) if bits >> 31 else ~bits).view(np.float32)
        return pd.DataFrame({"frame_id": [df.frame_id.iloc[0]], out: [float(value)]})

    counted = lambda df, low: df.mapInPandas(count(low), "frame_id string, part long, n long").groupBy("frame_id", "part").agg(F.sum("n").alias("n"))
    highs = counted(decimated(frame_tiles, step), False).groupBy("frame_id").applyInPandas(upper, "frame_id string, high long, rank long")
    again = decimated(frame_tiles.join(highs.select("frame_id", "high"), "frame_id"), step, extra=["high"])
    lows = counted(again, True).join(highs, "frame_id").groupBy("frame_id").applyInPandas(lower, f"frame_id string, `{out}` double")
    return frame_tiles.select("frame_id").distinct().join(lows, "frame_id", "left").select("frame_id", F.coalesce(out, F.lit(0.0)).alias(out))


@dataclass
class View:
    """A window: key, place (y0, x0) in the frame, frame size, layers as (h, w) arrays (None if absent) and the extras."""

    frame_id: str
    key: tuple[int, int]
    y0: int
    x0: int
    width: int
    height: int
    inside: np.ndarray
    layers: dict[str, np.ndarray | None]
    extra: dict

    def __getitem__(self, layer: str) -> np.ndarray | None:
        return self.layers[layer]

    def points(self, margin: int = 0) -> np.ndarray:
        """(x, y) of the pixels, without a margin on each side, row by row."""
        h, w = self.inside.shape
        y, x = np.mgrid[self.y0 + margin : self.y0 + h - margin, self.x0 + margin : self.x0 + w - margin]
        return np.column_stack([x.ravel(), y.ravel()])


def halo_windows(tiles: DataFrame, radius: int | str, size: int = SIZE) -> DataFrame:
    """For each tile the windows (tiles widened by radius) that it has a part of: columns k1, k2, wy0, wx0, wh, ww.

    Radius is a number or a column; it must not exceed the tile size, so only the eight neighbours are touched. Windows at
    the frame's edge reach beyond it.
    """
    if isinstance(radius, int) and radius > size:
        raise ValueError("the radius exceeds the tiles' size")
    step = F.sequence(F.lit(-1), F.lit(1)) if radius else F.array(F.lit(0))
    radius = F.col(radius) if isinstance(radius, str) else F.lit(radius)
    at = tiles.withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step)).withColumns({"k1": F.col("ty") + F.col("_dy"), "k2": F.col("tx") + F.col("_dx")}).drop("_dy", "_dx")
    at = at.where((F.col("k1") >= 0) & (F.col("k2") >= 0) & (F.col("k1") * size < F.col("height")) & (F.col("k2") * size < F.col("width")))
    y0, x0 = F.col("k1") * size, F.col("k2") * size
    tall, wide = F.least(F.lit(size), F.col("height") - y0), F.least(F.lit(size), F.col("width") - x0)
    return at.withColumns({"wy0": y0 - radius, "wx0": x0 - radius, "wh": tall + 2 * radius, "ww": wide + 2 * radius})


_DTYPES = {"float": np.float32, "double": np.float64, "int": np.int32, "smallint": np.int16, "boolean": bool}


def gather(windows: DataFrame, layers: Sequence[str], fn: Callable[[View], pd.DataFrame], schema: str, extra: Sequence[str] = ()) -> DataFrame:
    """Run fn on every window; windows has the tiles' columns, k1, k2, wy0, wx0, wh, ww and the extra columns (one value a window).

    Outside the frame values are NaN and masks 0. fn returns rows of schema without frame_id, which comes first.
    """
    cols = [*HEAD, "k1", "k2", "wy0", "wx0", "wh", "ww"]
    fields = {f.name: f.dataType.simpleString() for f in windows.schema.fields}
    kinds = ", ".join(f"`{c}` {fields[c]}" for c in [*cols, *layers, *extra])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            ya, xa = np.maximum(df.y0, df.wy0).to_numpy(), np.maximum(df.x0, df.wx0).to_numpy()
            yb, xb = np.minimum(df.y0 + df.h, df.wy0 + df.wh).to_numpy(), np.minimum(df.x0 + df.w, df.wx0 + df.ww).to_numpy()
            met = np.flatnonzero((ya < yb) & (xa < xb))
            y0, x0, h, w = (df[c].to_numpy() for c in ("y0", "x0", "h", "w"))
            out = {c: df[c].iloc[met].to_numpy() for c in [*cols, *extra]} | {"y0": ya[met], "x0": xa[met], "h": (yb - ya)[met], "w": (xb - xa)[met]}
            for c in layers:
                have = df[c].to_numpy()
                out[c] = [None if have[i] is None else np.asarray(have[i]).reshape(h[i], w[i])[ya[i] - y0[i] : yb[i] - y0[i], xa[i] - x0[i] : xb[i] - x0[i]].ravel() for i in met]
            yield pd.DataFrame({c: pd.Series(out[c], dtype=object) if c in layers else out[c] for c in [*cols, *layers, *extra]})

    arrays = {c.split()[0]: _DTYPES[c.split()[1][6:-1]] for c in schema.split(", ") if c.split()[1].startswith("array<")}

    def run(df: pd.DataFrame) -> pd.DataFrame:
        r = df.iloc[0]
        shape = (int(r.wh), int(r.ww))
        inside = np.zeros(shape, bool)
        got: dict[str, np.ndarray | None] = {}
        for c in layers:
            if df[c].isna().all():
                got[c] = None
                continue
            full = np.zeros(shape, np.int64) if c.endswith("mask") else np.full(shape, np.nan)
            for p in df.itertuples(index=False):
                if getattr(p, c) is not None:
                    full[p.y0 - p.wy0 : p.y0 - p.wy0 + p.h, p.x0 - p.wx0 : p.x0 - p.wx0 + p.w] = np.asarray(getattr(p, c), full.dtype).reshape(p.h, p.w)
            got[c] = full
        for p in df.itertuples(index=False):
            inside[p.y0 - p.wy0 : p.y0 - p.wy0 + p.h, p.x0 - p.wx0 : p.x0 - p.wx0 + p.w] = True
        view = View(r.frame_id, (int(r.k1), int(r.k2)), int(r.wy0), int(r.wx0), int(r.width), int(r.height), inside, got, {c: r[c] for c in extra})
        out = fn(view)
        for c, kind in arrays.items():  # numbers as they are sent, not as Python objects
            out[c] = pd.Series([None if a is None else np.asarray(a, kind) for a in out[c]], dtype=object, index=out.index)
        out.insert(0, "frame_id", r.frame_id)
        return out

    parts = windows.select(*cols, *layers, *extra).mapInPandas(cut, kinds)
    return parts.groupBy("frame_id", "k1", "k2").applyInPandas(run, f"frame_id string, {schema}")


TILE = "ty int, tx int, y0 int, x0 int, h int, w int, width int, height int"


def tile_row(v: View, margin: int, layers: dict[str, np.ndarray]) -> pd.DataFrame:
    """A tile of results for the window's middle."""
    h, w = v.inside.shape[0] - 2 * margin, v.inside.shape[1] - 2 * margin
    head = {"ty": v.key[0], "tx": v.key[1], "y0": v.y0 + margin, "x0": v.x0 + margin, "h": h, "w": w, "width": v.width, "height": v.height}
    return pd.DataFrame([head | {n: None if a is None else a.ravel() for n, a in layers.items()}])


def convolve_basis(tiles: DataFrame, basis, size: int = SIZE) -> DataFrame:
    """Each tile with `stack`, the frame's values convolved with all components of the basis, component by component.

    Zero beyond the frame.
    """
    from ..functions.basis import basis_stack

    r = basis.radius

    def run(v: View) -> pd.DataFrame:
        stack = basis_stack(np.where(v.inside, v["value"], 0.0), basis)[:, r:-r, r:-r]
        return tile_row(v, r, {"stack": stack})

    return gather(halo_windows(tiles, r, size), ["value"], run, f"{TILE}, stack array<double>")


def matched_filter(tiles: DataFrame, psf_col: str = "psf", size: int = SIZE, radius: int = 8) -> DataFrame:
    """Tiles with `score`: correlation with the point source (column psf_col, a flat square of 2 radius + 1) over its noise.

    Zero beyond the frame and for non-finite values; 0 where the variance is not positive.
    """
    from ..functions.basis import correlate2d

    def run(v: View) -> pd.DataFrame:
        psf = np.asarray(v.extra[psf_col], float).reshape(2 * radius + 1, -1)
        image = np.where(v.inside & np.isfinite(v["value"]), v["value"], 0.0)
        var = v["variance"][radius:-radius, radius:-radius]
        ok = np.isfinite(var) & (var > 0)
        score = np.where(ok, correlate2d(image, psf) / np.sqrt(np.where(ok, var, 1.0) * (psf**2).sum()), 0.0)
        return tile_row(v, radius, {"score": score})

    return gather(halo_windows(tiles, radius, size), ["value", "variance"], run, f"{TILE}, score array<float>", [psf_col])
