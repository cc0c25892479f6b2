"""What users hold, as frames: arrays, masked arrays, objects with data, and lists of positions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tiles


def as_layers(obj, variance=None, mask=None) -> dict[str, np.ndarray | None]:
    """{value, variance, mask} of an array or of an object with data, mask and uncertainty; arguments win over it.

    A standard deviation is squared; True in a boolean mask becomes the bad bit.
    """
    data = np.ma.getdata(obj.data) if hasattr(obj, "data") and not isinstance(obj, np.ndarray) else np.ma.getdata(obj)
    if mask is None and isinstance(obj, np.ma.MaskedArray) and obj.mask is not np.ma.nomask:
        mask = obj.mask
    elif mask is None and not isinstance(obj, np.ndarray):
        mask = getattr(obj, "mask", None)
    sigma = getattr(obj, "uncertainty", None)
    if variance is None and sigma is not None:
        array = np.asarray(getattr(sigma, "array", sigma), np.float32)
        variance = array**2 if getattr(sigma, "uncertainty_type", "std") == "std" else array
    value = np.asarray(data, np.float32)
    if value.ndim != 2:
        raise ValueError("an image of two axes is needed")
    out = {"value": value, "variance": None if variance is None else np.asarray(variance, np.float32), "mask": None if mask is None else np.asarray(mask).astype(np.uint8)}
    if any(a is not None and a.shape != value.shape for a in out.values()):
        raise ValueError("layers of different shapes")
    return out


def pair(spark: SparkSession, science, reference, frame_id: str = "frame", size: int = tiles.SIZE, gain: float | None = None, read_noise: float = 0.0, **layers) -> DataFrame:
    """Tiles of one pair for the engine; with a gain, missing variances follow from the data."""
    out = {}
    for p, obj, name in (("s", science, "science"), ("r", reference, "reference")):
        got = as_layers(obj, layers.get(f"{name}_var"), layers.get(f"{name}_mask"))
        if got["variance"] is None and gain is not None:
            if not gain > 0:
                raise ValueError("the gain must be positive")
            got["variance"] = np.maximum(got["value"], 0) / gain + read_noise**2
        out |= {f"{p}_{c}": a for c, a in got.items()}
    if out["s_value"].shape != out["r_value"].shape:
        raise ValueError("science and reference must share a shape")
    return tiles.from_array(spark, {frame_id: out}, size)


def pair_tiles(science: DataFrame, reference: DataFrame) -> DataFrame:
    """Tiles of many pairs: science and reference tiles (value, variance, mask) of the same frame_id."""
    named = lambda df, p: df.select(*tiles.HEAD, *(F.col(c).alias(f"{p}_{c}") for c in ("value", "variance", "mask")))
    return named(science, "s").join(named(reference, "r").drop("y0", "x0", "h", "w", "width", "height"), ["frame_id", "ty", "tx"])


def with_variance(frame_tiles: DataFrame, gain: float, read_noise: float = 0.0) -> DataFrame:
    """S10 on tiles: missing variances from the data."""
    if not gain > 0:
        raise ValueError("the gain must be positive")
    made = F.transform("value", lambda v: (F.greatest(v, F.lit(0.0).cast("float")) / gain + read_noise**2).cast("float"))
    return frame_tiles.withColumn("variance", F.coalesce("variance", made))


def positions(spark: SparkSession, path: str, frame_id: str = "frame") -> DataFrame:
    """(frame_id, stamp, x, y) from a text file of x and y, white space between; other columns are ignored."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where((F.size("c") >= 2) & ~F.col("c")[0].startswith("#"))
    xy = rows.select(*(F.col("c")[k].cast("double").cast("int").alias(n) for k, n in ((0, "x"), (1, "y")))).where("x is not null and y is not null")
    return xy.withColumn("frame_id", F.lit(frame_id)).withColumn("stamp", (F.monotonically_increasing_id() % (1 << 31)).cast("int")).select("frame_id", "stamp", "x", "y")
