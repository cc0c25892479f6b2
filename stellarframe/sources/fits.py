"""FITS images: a reader and writer in NumPy, a Spark data source, and distributed reads of many files."""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.schema import PIXELS
from ..operators.tiles import SIZE

# Fixed values of the format.
BLOCK, CARD = 2880, 80
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
LAYER_NAMES = ("VARIANCE", "MASK")


def _cards(raw: bytes, at: int) -> tuple[dict, int]:
    """Keywords of the header at `at`, and where its data begins."""
    head: dict = {}
    while True:
        block = raw[at : at + BLOCK].decode("ascii", "replace")
        if len(block) < BLOCK:
            raise ValueError("the header does not end")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD]
            key = card[:8].strip()
            if key == "END":
                return head, at
            if card[8:10] == "= ":
                text = card[10:].strip()
                if text.startswith("'"):
                    value: object = text[1:].split("'")[0].rstrip()
                else:
                    text = text.split("/")[0].strip()
                    value = {"T": True, "F": False}.get(text)
                    if value is None:
                        value = float(text.replace("D", "E")) if any(c in text for c in ".ED") else int(text or 0)
                head[key] = value


def units(raw: bytes) -> Iterator[tuple[dict, np.ndarray | None]]:
    """(header, image) of each unit of a file; None for units without an image of two or more axes."""
    at = 0
    while at + BLOCK <= len(raw):
        head, at = _cards(raw, at)
        shape = [int(head[f"NAXIS{k}"]) for k in range(int(head.get("NAXIS", 0)), 0, -1)]
        count = int(np.prod(shape)) * int(head.get("GCOUNT", 1)) + int(head.get("PCOUNT", 0)) if shape else 0
        kind = np.dtype(KINDS[int(head["BITPIX"])])
        image = None
        if len(shape) == 2 and head.get("XTENSION", "IMAGE") == "IMAGE":
            image = np.frombuffer(raw, kind, shape[0] * shape[1], at).reshape(shape)
            scale, zero = head.get("BSCALE", 1), head.get("BZERO", 0)
            if scale != 1 or zero != 0:
                image = image * float(scale) + float(zero)
        yield head, image
        at += -(-count * kind.itemsize // BLOCK) * BLOCK


def parse(raw: bytes, layers: tuple[str, ...] = LAYER_NAMES) -> dict[str, np.ndarray | None]:
    """{value, variance, mask}: the primary image, or else the extension DIFFERENCE, and the named layers."""
    found: dict[str, np.ndarray] = {}
    for k, (head, image) in enumerate(units(raw)):
        name = "PRIMARY" if k == 0 else str(head.get("EXTNAME", "")).upper()
        if image is not None and name not in found and (name in ("PRIMARY", "DIFFERENCE") or name in layers):
            found[name] = image
    value = found.get("PRIMARY", found.get("DIFFERENCE"))
    if value is None:
        raise ValueError("no two-dimensional image in the primary unit, and no DIFFERENCE")
    pick = lambda n, kind: found[n].astype(kind) if n in found else None
    out = {"value": value.astype(np.float32), "variance": pick("VARIANCE", np.float32), "mask": pick("MASK", np.uint8)}
    if any(a is not None and a.shape != value.shape for a in out.values()):
        raise ValueError("layers of different shapes")
    return out


def _header(cards: dict) -> bytes:
    lines = []
    for key, value in cards.items():
        shown = f"'{value:<8}'" if isinstance(value, str) else {True: "T", False: "F"}[value] if isinstance(value, bool) else repr(value)
        lines.append(f"{key[:8].upper():<8}= {shown if isinstance(value, str) else shown.rjust(20)}"[:CARD].ljust(CARD))
    text = "".join([*lines, "END".ljust(CARD)])
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii", "replace")


def _unit(head: dict, data: bytes) -> bytes:
    return _header(head) + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


# Fixed values of the format: letters of a binary table's columns.
COLUMNS = {"f8": "D", "f4": "E", "i8": "K", "i4": "J", "i2": "I", "i1": "I", "u1": "B", "b1": "L"}


def table_unit(table: pd.DataFrame, name: str) -> bytes:
    """A binary table extension of columns of numbers and truth values."""
    arrays = []
    for c in table.columns:
        a = table[c].to_numpy()
        a = a.astype("i2") if a.dtype.str[1:] == "i1" else a
        if a.dtype.str[1:] not in COLUMNS:
            raise ValueError(f"column {c}: no such kind of column in FITS")
        arrays.append((c, COLUMNS[a.dtype.str[1:]], np.where(a, b"T", b"F").astype("S1") if a.dtype == bool else a.astype(a.dtype.newbyteorder(">"))))
    rows = np.empty(len(table), [(c, a.dtype) for c, _, a in arrays])
    for c, _, a in arrays:
        rows[c] = a
    head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": rows.dtype.itemsize, "NAXIS2": len(rows), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(arrays), "EXTNAME": name}
    for k, (c, letter, _) in enumerate(arrays, 1):
        head |= {f"TTYPE{k}": c, f"TFORM{k}": f"1{letter}"}
    return _unit(head, rows.tobytes())


def read_table(raw: bytes, name: str) -> pd.DataFrame:
    """The binary table extension of that name."""
    letters = {v: k for k, v in COLUMNS.items() if k != "i1"}
    at = 0
    while at + BLOCK <= len(raw):
        head, at = _cards(raw, at)
        size = int(np.prod([int(head[f"NAXIS{k + 1}"]) for k in range(int(head.get("NAXIS", 0)))])) * abs(int(head["BITPIX"])) // 8 if head.get("NAXIS") else 0
        if head.get("XTENSION") == "BINTABLE" and head.get("EXTNAME") == name:
            kinds = [(head[f"TTYPE{k}"], "S1" if (x := head[f"TFORM{k}"][-1]) == "L" else ">" + letters[x]) for k in range(1, int(head["TFIELDS"]) + 1)]
            rows = np.frombuffer(raw, np.dtype(kinds), int(head["NAXIS2"]), at)
            return pd.DataFrame({c: rows[c] == b"T" if k == "S1" else rows[c].astype(k[1:]) for c, k in kinds})
        at += -(-size // BLOCK) * BLOCK
    raise ValueError(f"no table {name}")


def encode(value: np.ndarray, variance: np.ndarray | None = None, mask: np.ndarray | None = None, cards: dict | None = None, score: np.ndarray | None = None, catalog: pd.DataFrame | None = None) -> bytes:
    """A primary image of single precision, and VARIANCE, MASK, SCORE and CATALOG extensions where there are such layers."""
    out = []
    for k, (name, image, kind) in enumerate((("PRIMARY", value, ">f4"), ("VARIANCE", variance, ">f4"), ("MASK", mask, ">u1"), ("SCORE", score, ">f4"))):
        if image is None:
            continue
        head = {"SIMPLE": True} if k == 0 else {"XTENSION": "IMAGE"}
        head |= {"BITPIX": -32 if kind == ">f4" else 8, "NAXIS": 2, "NAXIS1": image.shape[1], "NAXIS2": image.shape[0]}
        head |= ({"EXTEND": True} | (cards or {})) if k == 0 else {"PCOUNT": 0, "GCOUNT": 1, "EXTNAME": name}
        out.append(_unit(head, np.ascontiguousarray(image).astype(kind).tobytes()))
    return b"".join([*out, *([table_unit(catalog, "CATALOG")] if catalog is not None else [])])


def write(path: str, value: np.ndarray, variance=None, mask=None, overwrite: bool = False, cards: dict | None = None, score=None, catalog: pd.DataFrame | None = None) -> None:
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    with open(path, "wb") as f:
        f.write(encode(value, variance, mask, cards, score, catalog))


def encoded(frame_tiles: DataFrame, cards: DataFrame | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """(frame_id, content): a FITS file for each frame, made where its tiles meet; a frame is one file and has to fit a task.

    frame_tiles: value, variance, mask and, if there is one, score. cards: (frame_id, cards map<string,string>); a number is
    written as one. catalog: rows with frame_id.
    """
    layers = [c for c in ("value", "variance", "mask", "score") if c in frame_tiles.columns]

    def run(key: tuple, df: pd.DataFrame, table: pd.DataFrame | None = None) -> pd.DataFrame:
        first, whole = df.iloc[0], {}
        for c in layers:
            if df[c].notna().any():
                whole[c] = np.zeros((first.height, first.width), np.int64 if c == "mask" else np.float32)
                for r in df.itertuples(index=False):
                    if getattr(r, c) is not None:
                        whole[c][r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.asarray(getattr(r, c)).reshape(r.h, r.w)
        told = dict(first["cards"]) if "cards" in df.columns and first["cards"] is not None else {}
        content = encode(whole["value"], whole.get("variance"), whole.get("mask"), {k: _number(v) for k, v in told.items()}, whole.get("score"), None if table is None else table.drop(columns="frame_id"))
        return pd.DataFrame({"frame_id": [key[0]], "content": [content]})

    given = frame_tiles.select("frame_id", "y0", "x0", "h", "w", "width", "height", *layers)
    given = given if cards is None else given.join(cards, "frame_id", "left")
    if catalog is None:
        return given.groupBy("frame_id").applyInPandas(lambda key, df: run(key, df), "frame_id string, content binary")
    catalog = catalog.select(*(F.col(c).alias(c) for c in catalog.columns))  # columns of its own: it stems from the same tiles
    both = given.groupBy("frame_id").cogroup(catalog.groupBy("frame_id"))
    empty = "frame_id string, content binary"
    return both.applyInPandas(lambda key, df, table: run(key, df, table) if len(df) else pd.DataFrame({"frame_id": pd.Series([], dtype=object), "content": pd.Series([], dtype=object)}), empty)


def _number(text: str) -> object:
    for kind in (int, float):
        try:
            value = kind(text)
        except ValueError:
            continue
        return value if np.isfinite(value) else text
    return {"True": True, "False": False}.get(text, text)


def read(path: str) -> dict[str, np.ndarray | None]:
    with open(path, "rb") as f:
        return parse(f.read())


def shape(path: str) -> tuple[int, int]:
    """(height, width) of a file's image, from its headers."""
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as raw:
        at, k = 0, 0
        while at + BLOCK <= len(raw):
            head, at = _cards(raw, at)
            axes = [int(head[f"NAXIS{n}"]) for n in range(1, int(head.get("NAXIS", 0)) + 1)]
            if len(axes) == 2 and head.get("XTENSION", "IMAGE") == "IMAGE" and (k == 0 or head.get("EXTNAME") == "DIFFERENCE"):
                return axes[1], axes[0]
            count = int(np.prod(axes)) * int(head.get("GCOUNT", 1)) + int(head.get("PCOUNT", 0)) if axes else 0
            at += -(-count * abs(int(head["BITPIX"])) // 8 // BLOCK) * BLOCK
            k += 1
    raise ValueError("no two-dimensional image in the primary unit, and no DIFFERENCE")


TILES = "frame_id string, ty int, tx int, y0 int, x0 int, h int, w int, width int, height int, value array<float>, variance array<float>, mask array<smallint>"


def read_tiles(spark: SparkSession, path: str, size: int = SIZE, pattern: str = "*.fits") -> DataFrame:
    """Tiles of all files under path whose names fit the pattern, read by Spark from any store; frame_id is the file's name without its ending."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for where, raw in zip(df.path, df.content, strict=True):
                layers, rows = parse(raw), []
                h, w = layers["value"].shape
                frame = os.path.splitext(os.path.basename(where))[0]
                for y in range(0, h, size):
                    for x in range(0, w, size):
                        cuts = {n: None if a is None else a[y : y + size, x : x + size] for n, a in layers.items()}
                        th, tw = cuts["value"].shape
                        rows.append((frame, y // size, x // size, y, x, th, tw, w, h, *(None if a is None else a.ravel().astype(int if n == "mask" else float).tolist() for n, a in cuts.items())))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in TILES.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(cut, TILES)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self._path = path

    def partitions(self):
        if os.path.isdir(self._path):
            return [_File(os.path.join(self._path, n)) for n in sorted(os.listdir(self._path)) if n.endswith(".fits")]
        return [_File(self._path)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        layers = read(partition.path)
        frame = os.path.splitext(os.path.basename(partition.path))[0]
        h, w = layers["value"].shape
        step = max(1, 65536 // w)
        for y in range(0, h, step):  # some lines at a time
            n = layers["value"][y : y + step].size
            part = lambda c, kind: pa.nulls(n, kind) if layers[c] is None else pa.array(layers[c][y : y + step].ravel()).cast(kind)  # noqa: B023, E731
            gy, gx = np.divmod(np.arange(n, dtype=np.int32), np.int32(w))
            columns = [pa.repeat(pa.scalar(frame), n), pa.array(gy + np.int32(y)), pa.array(gx), part("value", pa.float32()), part("variance", pa.float32()), part("mask", pa.int16())]
            yield pa.RecordBatch.from_arrays(columns, ["frame_id", "y", "x", "value", "variance", "mask"])


class FitsSource(DataSource):
    """`spark.read.format("fits").load(path)`: a row for each pixel of a file or of all files in a folder (PIXELS)."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsSource)
