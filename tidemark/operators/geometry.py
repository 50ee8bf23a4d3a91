"""Geometries as WKB: building, envelopes, tests against cells, interior points and reprojection between EPSG:4326 and EPSG:3857.

Shapes are (kind, parts): kind `point`, `line` or `polygon`; parts are coordinate arrays: a polygon's rings together obey the even-odd rule,
so holes and several polygons need no special case. Touching counts as intersecting.
"""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Shape = tuple[str, list[np.ndarray]]
CODES = {"point": 1, "line": 2, "polygon": 3, "multipoint": 4, "multiline": 5, "multipolygon": 6}
EARTH = 6378137.0


def to_wkb(kind: str, parts: list) -> bytes:
    """WKB of a point, a line, or a polygon of rings."""
    arrays = [np.asarray(p, dtype="<f8").reshape(-1, 2) for p in parts]
    if kind == "point":
        return struct.pack("<BI", 1, 1) + arrays[0][:1].tobytes()
    if kind == "line":
        return struct.pack("<BII", 1, 2, len(arrays[0])) + arrays[0].tobytes()
    return struct.pack("<BII", 1, 3, len(arrays)) + b"".join(struct.pack("<I", len(a)) + a.tobytes() for a in arrays)


def from_wkb(data: bytes) -> Shape:
    """Shape of WKB, two or more dimensions; collections of one kind are joined."""
    shape, _ = _read(data, 0)
    return shape


def _read(data: bytes, at: int) -> tuple[Shape, int]:
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    dims = 2 + bool(code & 0x80000000 or code // 1000 % 10 in (1, 3)) + bool(code & 0x40000000 or code // 1000 % 10 in (2, 3))
    at += 5 + 4 * bool(code & 0x20000000)
    code = (code & 0xFFFF) % 1000

    def run(at: int, n: int) -> tuple[np.ndarray, int]:
        a = np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)[:, :2]
        return a.astype(float), at + 8 * n * dims

    def number(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if code == 1:
        a, at = run(at, 1)
        return ("point", [a]), at
    n, at = number(at)
    if code == 2:
        a, at = run(at, n)
        return ("line", [a]), at
    parts: list[np.ndarray] = []
    kind = {3: "polygon", 4: "point", 5: "line", 6: "polygon"}.get(code)
    if kind is None:
        raise ValueError(f"WKB geometry type {code} isn't supported")
    for _ in range(n):
        if code == 3:
            m, at = number(at)
            a, at = run(at, m)
            parts.append(a)
        else:
            (_, more), at = _read(data, at)
            parts += more
    return (kind, parts), at


def from_geojson(geometry: dict) -> Shape | None:
    if not geometry:
        return None
    kind, c = geometry["type"], geometry["coordinates"]
    flat = {
        "Point": ("point", [[c]]),
        "MultiPoint": ("point", [[p] for p in c]),
        "LineString": ("line", [c]),
        "MultiLineString": ("line", c),
        "Polygon": ("polygon", c),
        "MultiPolygon": ("polygon", [ring for polygon in c for ring in polygon] if kind == "MultiPolygon" else []),
    }
    name, parts = flat[kind]
    return name, [np.array([p[:2] for p in part], dtype=float) for part in parts]


def to_geojson(shape: Shape) -> dict:
    kind, parts = shape
    lists = [p.tolist() for p in parts]
    if kind == "point":
        return {"type": "Point", "coordinates": lists[0][0]} if len(lists) == 1 else {"type": "MultiPoint", "coordinates": [p[0] for p in lists]}
    if kind == "line":
        return {"type": "LineString", "coordinates": lists[0]} if len(lists) == 1 else {"type": "MultiLineString", "coordinates": lists}
    return {"type": "Polygon", "coordinates": lists}


def envelope(shape: Shape) -> tuple[float, float, float, float]:
    """minx, maxx, miny, maxy."""
    xy = np.concatenate(shape[1])
    return float(xy[:, 0].min()), float(xy[:, 0].max()), float(xy[:, 1].min()), float(xy[:, 1].max())


def contains(shape: Shape, x: float, y: float) -> bool:
    """Even-odd rule over all rings; a point on the border may fall on either side."""
    odd = False
    for ring in shape[1]:
        x0, y0 = ring[:, 0], ring[:, 1]
        x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
        crosses = (y0 > y) != (y1 > y)
        if crosses.any():
            at = x0[crosses] + (y - y0[crosses]) * (x1[crosses] - x0[crosses]) / (y1[crosses] - y0[crosses])
            odd ^= bool((at > x).sum() % 2)
    return odd


def crosses_box(a: np.ndarray, b: np.ndarray, box: tuple[float, float, float, float]) -> bool:
    """Whether any segment a[i]-b[i] meets the closed box: its parameter range within all four half-planes isn't empty."""
    minx, maxx, miny, maxy = box
    low, high = np.zeros(len(a)), np.ones(len(a))
    ok = np.ones(len(a), bool)
    for axis, lo, hi in ((0, minx, maxx), (1, miny, maxy)):
        d, p = b[:, axis] - a[:, axis], a[:, axis]
        still = d == 0
        ok &= ~still | ((p >= lo) & (p <= hi))
        safe = np.where(still, 1.0, d)
        t0, t1 = (lo - p) / safe, (hi - p) / safe
        low = np.where(still, low, np.maximum(low, np.minimum(t0, t1)))
        high = np.where(still, high, np.minimum(high, np.maximum(t0, t1)))
    return bool((ok & (low <= high)).any())


def touches_box(shape: Shape, box: tuple[float, float, float, float]) -> bool:
    """Whether the shape and the closed box have a point in common."""
    minx, maxx, miny, maxy = box
    kind, parts = shape
    for p in parts:
        if ((p[:, 0] >= minx) & (p[:, 0] <= maxx) & (p[:, 1] >= miny) & (p[:, 1] <= maxy)).any():
            return True
        if kind == "line" and len(p) > 1 and crosses_box(p[:-1], p[1:], box):
            return True
        if kind == "polygon" and crosses_box(p, np.roll(p, -1, axis=0), box):
            return True
    return kind == "polygon" and contains(shape, minx, miny)


def interior_point(shape: Shape) -> tuple[float, float]:
    """A point on the shape: for a polygon the middle of the widest inner stretch at half height, for a line a middle vertex."""
    kind, parts = shape
    if kind == "point":
        return float(parts[0][0, 0]), float(parts[0][0, 1])
    if kind == "line":
        longest = max(parts, key=len)
        return tuple(map(float, longest[len(longest) // 2]))
    _, _, miny, maxy = envelope(shape)
    ys = np.unique(np.concatenate([p[:, 1] for p in parts]))
    middle = (miny + maxy) / 2
    if middle in ys and len(ys) > 1:  # not through a vertex: between it and its neighbour
        i = int(np.searchsorted(ys, middle))
        middle = (ys[i] + ys[i + 1]) / 2 if i + 1 < len(ys) else (ys[i] + ys[i - 1]) / 2
    xs = []
    for ring in parts:
        x0, y0 = ring[:, 0], ring[:, 1]
        x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
        c = (y0 > middle) != (y1 > middle)
        xs += (x0[c] + (middle - y0[c]) * (x1[c] - x0[c]) / (y1[c] - y0[c])).tolist()
    xs.sort()
    stretches = list(zip(xs[::2], xs[1::2], strict=False))
    if not stretches:
        return tuple(map(float, parts[0][0]))
    a, b = max(stretches, key=lambda s: s[1] - s[0])
    return (a + b) / 2, float(middle)


def reprojected(shape: Shape, src: str, dst: str) -> Shape:
    """Between EPSG:4326 (x is the longitude) and EPSG:3857; other systems need a projection library."""
    if src == dst:
        return shape
    if {src, dst} != {"EPSG:4326", "EPSG:3857"}:
        raise ValueError(f"no reprojection from {src} to {dst}; only EPSG:4326 and EPSG:3857 are built in")

    def go(p: np.ndarray) -> np.ndarray:
        if dst == "EPSG:3857":
            return np.column_stack([np.radians(p[:, 0]) * EARTH, EARTH * np.log(np.tan(math.pi / 4 + np.radians(p[:, 1]) / 2))])
        return np.column_stack([np.degrees(p[:, 0] / EARTH), np.degrees(2 * np.arctan(np.exp(p[:, 1] / EARTH)) - math.pi / 2)])

    return shape[0], [go(p) for p in shape[1]]


#: Cells whose answer hangs on less than this part of a cell are tested one by one with touches_box.
NEAR = 1e-7


def _union(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of closed integer intervals as disjoint intervals that don't adjoin."""
    keep = first <= last
    first, last = first[keep], last[keep]
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.r_[True, first[1:] > reach[:-1] + 1]
    return first[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]


def _segments(shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the border's pieces; a point is a piece without length."""
    kind, parts = shape
    if kind == "polygon":
        return np.concatenate(parts), np.concatenate([np.concatenate((p[1:], p[:1])) for p in parts])
    pairs = [(p, p) if kind == "point" or len(p) < 2 else (p[:-1], p[1:]) for p in parts]
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def touched_runs(shapes: list[Shape], windows: np.ndarray, transform: tuple[float, float, float, float]) -> np.ndarray:
    """Rows (number of the shape, row, first col, last col), ordered, of the cells that each shape touches within its window c0, c1, r0, r1.

    transform is x0, dx, y0, dy. A row's cells are those that meet the border's pieces in the row, or the stretches inside along the row's
    middle. Work and memory follow the borders' lengths in rows and the runs, not the cells.
    """
    x0, dx, y0, dy = transform
    ends = [_segments(s) for s in shapes]
    shape = np.repeat(np.arange(len(shapes)), [len(a) for a, _ in ends])
    area = np.array([kind == "polygon" for kind, _ in shapes])
    c0, c1, r0, r1 = windows.T
    a, b = np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends])
    ua, va, ub, vb = (a[:, 0] - x0) / dx, (a[:, 1] - y0) / dy, (b[:, 0] - x0) / dx, (b[:, 1] - y0) / dy
    low, high = np.minimum(va, vb), np.maximum(va, vb)
    top = np.maximum(np.ceil(low - NEAR) - 1, r0[shape]).astype(np.int64)
    n = np.maximum(np.minimum(np.floor(high + NEAR), r1[shape]).astype(np.int64) - top + 1, 0)
    row = np.arange(n.sum()) + np.repeat(top - np.cumsum(n) + n, n)
    ua, va, ub, vb, low, high, shape = (np.repeat(c, n) for c in (ua, va, ub, vb, low, high, shape))
    flat = va == vb
    slope = (ub - ua) / np.where(flat, 1.0, vb - va)
    at = lambda v: np.where(v == va, ua, np.where(v == vb, ub, ua + (v - va) * slope))
    # a line is a row of a shape's window; lines of all shapes follow each other
    lines = np.cumsum(r1 - r0 + 1) - (r1 - r0 + 1)
    line = lines[shape] + row - r0[shape]
    width = int((c1 - c0).max()) + 3  # runs of two lines never adjoin

    def coded(shape: np.ndarray, line: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = np.maximum(first, c0[shape]), np.minimum(last, c1[shape])
        some = first <= last
        base = (line * width - c0[shape])[some]
        return base + first[some].astype(np.int64), base + last[some].astype(np.int64)

    def border(margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Runs that meet the border within each row, which is widened by the margin."""
        v0, v1 = np.maximum(low, row - margin), np.minimum(high, row + 1 + margin)
        p, q = np.where(flat, ua, at(v0)), np.where(flat, ub, at(v1))
        first, last = np.ceil(np.minimum(p, q) - margin) - 1, np.floor(np.maximum(p, q) + margin)
        return coded(shape, line, first, np.where(v0 <= v1, last, first - 1))

    middle = row + 0.5
    over = ((va > middle) != (vb > middle)) & area[shape]
    u, inner, whose = at(middle)[over], line[over], shape[over]
    order = np.lexsort((u, inner))
    u, inner, whose = u[order], inner[order], whose[order]
    stretches = coded(whose[::2], inner[::2], np.ceil(u[::2] + NEAR) - 1, np.floor(u[1::2] - NEAR))
    both = lambda *runs: _union(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]))
    known = both(border(-NEAR), stretches)
    reach = both(known, border(NEAR))
    # known runs lie within those in reach, so sorted ends pair up to the gaps between them
    tested = []
    for g0, g1 in zip(np.sort(np.r_[reach[0], known[1] + 1]).tolist(), np.sort(np.r_[known[0] - 1, reach[1]]).tolist(), strict=True):
        for cell in range(g0, g1 + 1):
            i = int(np.searchsorted(lines, cell // width, "right")) - 1
            x, y = x0 + (cell % width + int(c0[i])) * dx, y0 + (cell // width - int(lines[i]) + int(r0[i])) * dy
            if touches_box(shapes[i], (min(x, x + dx), max(x, x + dx), min(y, y + dy), max(y, y + dy))):
                tested.append(cell)
    more = np.array(tested, dtype=np.int64)
    first, last = both(known, (more, more))
    i = np.searchsorted(lines, first // width, "right") - 1
    return np.column_stack([i, first // width - lines[i] + r0[i], first % width + c0[i], last % width + c0[i]])


#: Vertices and rows of cells that touched_runs takes at a time.
AT_ONCE = 200_000


def runs_of(geom: Column, window: list[Column], transform: tuple[float, float, float, float], start: Column, height: int, outer: bool) -> Column:
    """Array of (row, c0, c1) that the WKB touches within its window c0, c1, r0, r1, for the rows from start on.

    With outer, a geometry that touches nothing in its window has one run of NULLs, in its first slice.
    """

    @F.pandas_udf("array<struct<row:int,c0:int,c1:int>>")
    def run(g: pd.Series, c0: pd.Series, c1: pd.Series, r0: pd.Series, r1: pd.Series, start: pd.Series) -> pd.Series:
        nothing = [{"row": None, "c0": None, "c1": None}] if outer else []
        have = np.flatnonzero((g.notna() & start.notna()).to_numpy())
        out: list[list[dict]] = [[] if g.iat[i] is not None and pd.notna(start.iat[i]) else list(nothing) for i in range(len(g))]
        whole = np.column_stack([c.fillna(0).to_numpy(dtype=np.int64) for c in (c0, c1, r0, r1)])
        first = start.fillna(0).to_numpy(dtype=np.int64)
        windows = whole.copy()
        windows[:, 2], windows[:, 3] = first, np.minimum(first + height - 1, whole[:, 3])
        at = 0
        while at < len(have):
            shapes, size, begin = [], 0, at
            while at < len(have) and (not shapes or size < AT_ONCE):
                i = have[at]
                shapes.append(from_wkb(g.iat[i]))
                size += sum(map(len, shapes[-1][1])) + int(windows[i, 3] - windows[i, 2])
                at += 1
            these = have[begin:at]
            for n, row, a, b in touched_runs(shapes, windows[these], transform).tolist():
                out[these[n]].append({"row": row, "c0": a, "c1": b})
            for n, i in enumerate(these) if outer else ():
                if not out[i] and first[i] == whole[i, 2] and not len(touched_runs([shapes[n]], whole[i : i + 1], transform)):
                    out[i] = list(nothing)
        return pd.Series(out, dtype=object)

    return run(geom, *window, start)


def envelope_of(geom: Column) -> Column:
    """struct minx, maxx, miny, maxy of WKB."""

    @F.pandas_udf("minx double, maxx double, miny double, maxy double")
    def run(g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([envelope(from_wkb(x)) if x is not None else (None,) * 4 for x in g], columns=["minx", "maxx", "miny", "maxy"])

    return run(geom)


def interior_point_of(geom: Column) -> Column:
    """struct x, y: a point on the WKB geometry."""

    @F.pandas_udf("x double, y double")
    def run(g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([interior_point(from_wkb(x)) if x is not None else (None, None) for x in g], columns=["x", "y"])

    return run(geom)


def reprojected_of(geom: Column, src: str, dst: str) -> Column:
    """WKB in another system."""
    reprojected(("point", [np.zeros((1, 2))]), src, dst)  # raises on the driver

    @F.pandas_udf("binary")
    def run(g: pd.Series) -> pd.Series:
        return g.map(lambda x: None if x is None else to_wkb(*reprojected(from_wkb(x), src, dst)))

    return run(geom)


def wkb_of_geojson(text: Column) -> Column:
    """WKB of a GeoJSON geometry's text."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None or (shape := from_geojson(json.loads(t))) is None else to_wkb(*shape))

    return run(text)
