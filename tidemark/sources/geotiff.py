"""GeoTIFF grids: strips or tiles, uncompressed or deflate, without predictor. The file is fetched by Spark's binary reader and its blocks are decoded in tasks."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.scalars import without_nodata
from ..operators.overlay import Grid

#: TIFF field types: size and struct code.
FIELDS = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d"), 16: (8, "Q")}


@dataclass(frozen=True)
class Layout:
    order: str
    width: int
    height: int
    bands: int
    block: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    planar: bool
    deflate: bool
    dtype: str
    grid: Grid
    nodata: float | None
    names: tuple[str | None, ...]
    meta: tuple[dict[str, str], ...]


#: Keys of the coordinate system in the directory of geographic keys: projected first.
SYSTEM_KEYS = (3072, 2048)


def system_of(keys: tuple[int, ...]) -> str | None:
    """EPSG code from the directory of geographic keys: after four numbers, (key, where, count, value) for each."""
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    return next((f"EPSG:{found[k]}" for k in SYSTEM_KEYS if 0 < found.get(k, 0) < 32767), None)


def items_of(text: str, bands: int) -> tuple[tuple[str | None, ...], tuple[dict[str, str], ...]]:
    """Descriptions and items of the bands from the metadata text; an item without a band holds for all."""
    names: list[str | None] = [None] * bands
    meta: list[dict[str, str]] = [{} for _ in range(bands)]
    for item in ElementTree.fromstring(text).iter("Item") if text else ():
        at = [int(item.get("sample"))] if item.get("sample") else range(bands)
        for b in at:
            if b < bands and item.get("role") == "description":
                names[b] = item.text
            elif b < bands:
                meta[b][item.get("name", "")] = item.text or ""
    return tuple(names), tuple(meta)


def layout(data: bytes, srs: str | None = None) -> Layout:
    """What the first directory of the file says. srs, if given, replaces its coordinate system."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise DataError("not a classic TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in FIELDS:
            size, code = FIELDS[kind]
            place = at + 10 + 12 * i if size * n <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{code}", data, place)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(259, 1) not in (1, 8, 32946) or one(317, 1) != 1:
        raise DataError("only uncompressed and deflate files without predictor can be read")
    width, height, bands = one(256, 0), one(257, 0), one(277, 1)
    block = (one(322, width), one(323, height)) if 322 in tags else (width, one(278, height))
    if 33550 not in tags or 33922 not in tags:
        raise DataError("the file has no north-up georeference")
    (dx, dy), tie = tags[33550][:2], tags[33922]
    grid = Grid(tie[3] - tie[0] * dx, dx, tie[4] + tie[1] * dy, -dy, width, height, srs or system_of(tags.get(34735, ())) or "EPSG:4326")
    items = items_of(b"".join(tags.get(42112, ())).rstrip(b"\0 ").decode(), bands)
    text = b"".join(tags.get(42113, ())).rstrip(b"\0 ").decode()
    dtype = order + {1: "u", 2: "i", 3: "f"}[one(339, 1)] + str(one(258, 8) // 8)
    return Layout(order, width, height, bands, block, tags.get(324, tags.get(273)), tags.get(325, tags.get(279)), one(284, 1) == 2, one(259, 1) != 1, dtype, grid, float(text) if text else None, *items)


def cells_of(data: bytes, lay: Layout, k: int) -> pd.DataFrame:
    """band, row, col, value of a block."""
    w, h = lay.block
    across, down = -(-lay.width // w), -(-lay.height // h)
    plane, i = divmod(k, across * down) if lay.planar else (0, k)
    r0, c0 = i // across * h, i % across * w
    raw = data[lay.offsets[k] : lay.offsets[k] + lay.sizes[k]]
    a = np.frombuffer(zlib.decompress(raw) if lay.deflate else raw, lay.dtype)
    per = 1 if lay.planar else lay.bands
    a = a[: len(a) // (w * per) * w * per].reshape(-1, w, per)[: lay.height - r0, : lay.width - c0]
    rows, cols, bands = np.indices(a.shape)
    return pd.DataFrame({"band": (bands + 1 + plane).ravel(), "row": (rows + r0).ravel(), "col": (cols + c0).ravel(), "value": a.astype(float).ravel()})


def read_geotiff(spark: SparkSession, path: str, srs: str | None = None):
    """(cells, layout)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    lay = layout(bytes(files.first()["content"]), srs)

    def run(batches):
        for batch in batches:
            for content, k in zip(batch["content"], batch["k"], strict=True):
                yield cells_of(bytes(content), lay, int(k))

    blocks = files.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(lay.offsets) - 1))))
    cells = blocks.mapInPandas(run, "band int, row int, col int, value double")
    return cells.withColumn("value", without_nodata(F.col("value"), lay.nodata)).where("value IS NOT NULL"), lay
