"""Shapefile geometry records and ISO well-known binary, either way; for bytes and as Arrow-batched SQL functions."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

# Fixed values of the formats: shape types by geometry, ISO codes, and what counts as "no measure".
POINT, LINE, POLYGON, POINTS = 1, 3, 5, 8
Z_SHAPES, M_SHAPES = 10, 20
MULTI = {LINE: (5, 2), POLYGON: (6, 3), POINTS: (4, 1)}  # ISO code of the collection and of its parts
NO_MEASURE, WRITTEN_NO_MEASURE = -1e38, -1e40
MODES = ("wkb", "raw", "geoarrow")


def spatial_mode(text: str | None) -> str:
    mode = (text or "wkb").lower()
    if mode not in MODES:
        raise ValueError(f"spatial must be one of {', '.join(MODES)}, not {text!r}")
    return mode


def _doubles(data: bytes, at: int, n: int) -> np.ndarray:
    if at + 8 * n > len(data):
        raise ValueError("a geometry record is cut off")
    return np.frombuffer(data, dtype="<f8", count=n, offset=at)


def _int(data: bytes, at: int) -> int:
    if at + 4 > len(data):
        raise ValueError("a geometry record is cut off")
    return struct.unpack_from("<i", data, at)[0]


def _coordinates(xy: np.ndarray, *more: np.ndarray | None) -> np.ndarray:
    return np.column_stack([xy, *(m for m in more if m is not None)]).astype("<f8")


def signed_area(xy: np.ndarray) -> float:
    x, y = xy[:, 0], xy[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def shp_to_wkb(shape: bytes | None, ring_order: str = "area") -> bytes | None:
    """ISO WKB (little-endian) of a shapefile record; None for a null shape.

    Rings with a shoelace area of zero or more, and the first, begin a polygon; others are holes of the one before. ring_order "esri": clockwise
    rings (negative area) begin polygons, as shapefiles have it.
    """
    if shape is None:
        return None
    kind = _int(shape, 0)
    if kind == 0:
        return None
    has_z, has_m, base = kind // 10 == 1, kind // 10 == 2, kind % 10
    if kind // 10 > 2 or base not in (POINT, LINE, POLYGON, POINTS):
        raise ValueError(f"unknown shape type {kind}")
    if base == POINT:
        values = list(_doubles(shape, 4, 2))
        z = _doubles(shape, 20, 1) if has_z else None
        m = _doubles(shape, 20, 1) if has_m else _doubles(shape, 28, 1) if has_z and len(shape) >= 36 else None
        if has_z and m is not None and not m[0] > NO_MEASURE:
            m = None
        values += [] if z is None else list(z)
        values += [] if m is None else list(m)
        code = 1 + 1000 * (z is not None) + 2000 * (m is not None)
        return struct.pack(f"<BI{len(values)}d", 1, code, *values)
    if base == POINTS:
        n_parts, n, at, starts = 0, _int(shape, 36), 40, None
    else:
        n_parts, n = _int(shape, 36), _int(shape, 40)
        if n_parts < 0 or 44 + 4 * n_parts > len(shape):
            raise ValueError("a geometry record is cut off")
        starts, at = list(struct.unpack_from(f"<{n_parts}i", shape, 44)), 44 + 4 * n_parts
    if n < 0:
        raise ValueError("a geometry record has a negative number of points")
    xy = _doubles(shape, at, 2 * n).reshape(-1, 2)
    at += 16 * n
    z = m = None
    if has_z:
        z = _doubles(shape, at + 16, n)
        at += 16 + 8 * n
        if len(shape) >= at + 16 + 8 * n:
            m = _doubles(shape, at + 16, n)
            m = m if (m > NO_MEASURE).any() else None
    elif has_m:
        m = _doubles(shape, at + 16, n)
    extra = 1000 * (z is not None) + 2000 * (m is not None)
    all_code, part_code = (c + extra for c in MULTI[base])
    rows = _coordinates(xy, z, m)
    if base == POINTS:
        head = struct.pack("<BI", 1, part_code)
        return struct.pack("<BII", 1, all_code, n) + b"".join(head + r.tobytes() for r in rows)
    bounds = [*starts, n]
    if any(a > b or a < 0 for a, b in zip(bounds, bounds[1:])):
        raise ValueError("a geometry record's parts overlap")
    parts = [rows[a:b] for a, b in zip(bounds, bounds[1:])]
    ring = lambda p: struct.pack("<I", len(p)) + p.tobytes()
    if base == LINE:
        return struct.pack("<BII", 1, all_code, len(parts)) + b"".join(struct.pack("<BI", 1, part_code) + ring(p) for p in parts)
    polygons: list[list[np.ndarray]] = []
    for p in parts:
        area = signed_area(p[:, :2]) if len(p) else 0.0
        if not polygons or (area >= 0 if ring_order == "area" else area < 0):
            polygons.append([p])
        else:
            polygons[-1].append(p)
    return struct.pack("<BII", 1, all_code, len(polygons)) + b"".join(struct.pack("<BII", 1, part_code, len(g)) + b"".join(map(ring, g)) for g in polygons)


class _Wkb:
    """A cursor over well-known binary of either byte order."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def head(self) -> int:
        if self.at + 5 > len(self.data):
            raise ValueError("WKB is cut off")
        order = self.data[self.at]
        if order not in (0, 1):
            raise ValueError(f"unknown WKB byte order {order}")
        self.order = "<" if order else ">"
        self.at += 1
        code = self.number()
        self.width = {0: 2, 1: 3, 2: 3, 3: 4}.get(code // 1000)
        if self.width is None or not 1 <= code % 1000 <= 6:
            raise ValueError(f"unknown WKB type {code}")
        return code

    def number(self) -> int:
        if self.at + 4 > len(self.data):
            raise ValueError("WKB is cut off")
        (n,) = struct.unpack_from(self.order + "I", self.data, self.at)
        self.at += 4
        return n

    def points(self, n: int) -> np.ndarray:
        size = 8 * self.width * n
        if self.at + size > len(self.data):
            raise ValueError("WKB is cut off")
        out = np.frombuffer(self.data, dtype=self.order + "f8", count=self.width * n, offset=self.at).reshape(-1, self.width)
        self.at += size
        return out

    def parts(self, code: int) -> list[np.ndarray]:
        """Lines or rings (or, for points, the one point) of a geometry, parts of collections one after the other."""
        base = code % 1000
        if base == 1:
            return [self.points(1)]
        if base == 2:
            return [self.points(self.number())]
        if base == 3:
            return [self.points(self.number()) for _ in range(self.number())]
        found = []
        for _ in range(self.number()):
            inner = self.head()
            if inner % 1000 != base - 3:
                raise ValueError(f"WKB type {inner} within {code}")
            found += self.parts(inner)
        return found


def wkb_to_shp(wkb: bytes | None) -> bytes | None:
    """The shapefile record of ISO WKB; lines and polygons become records of one part or more."""
    if not wkb:
        return None
    cursor = _Wkb(wkb)
    code = cursor.head()
    base, has_z, has_m = code % 1000, code // 1000 in (1, 3), code // 1000 in (2, 3)
    parts = cursor.parts(code)
    shape = {1: POINT, 2: LINE, 5: LINE, 3: POLYGON, 6: POLYGON, 4: POINTS}[base] + (Z_SHAPES if has_z else M_SHAPES if has_m else 0)
    if base == 1:
        p = [float(v) for v in parts[0][0]]
        return struct.pack(f"<i{len(p) + (has_z and not has_m)}d", shape, *p, *([WRITTEN_NO_MEASURE] if has_z and not has_m else []))
    width = 2 + has_z + has_m
    points = np.concatenate(parts).astype("<f8") if parts else np.empty((0, width))
    xy = points[:, :2]
    box = [*xy.min(0), *xy.max(0)] if len(points) else [0.0] * 4
    out = struct.pack("<i4d", shape, *box)
    if base == 4:
        out += struct.pack("<i", len(points))
    else:
        starts = np.cumsum([0, *(len(p) for p in parts)])[:-1] if parts else []
        out += struct.pack(f"<ii{len(parts)}i", len(parts), len(points), *(int(s) for s in starts))
    out += np.ascontiguousarray(xy).tobytes()

    def ranged(values: np.ndarray) -> bytes:
        ends = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        return struct.pack("<2d", *ends) + np.ascontiguousarray(values).tobytes()

    if has_z:
        out += ranged(points[:, 2])
    if has_m:
        out += ranged(points[:, -1])
    return out


# A plain point is 20 bytes as a shape record (type, x, y) and 21 as WKB (byte order, type, x, y).
_SHAPE_POINT, _WKB_POINT = np.frombuffer(struct.pack("<i", POINT), np.uint8), np.frombuffer(struct.pack("<BI", 1, 1), np.uint8)


def _points(column: pa.Array, head: np.ndarray, new: np.ndarray) -> pa.Array | None:
    """A column in which all values that are there are points with this head, with the other head instead; None for other columns."""
    size = len(head) + 16
    _, offsets, data = column.buffers()
    if data is None or not pa.types.is_binary(column.type):
        return None
    valid = np.asarray(column.is_valid())
    off = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    length = np.diff(off)
    there = valid & (length > 0)
    if not there.any() or (length[there] != size).any():
        return None
    rows = np.frombuffer(data, dtype=np.uint8)[off[:-1][there][:, None] + np.arange(size)]
    if (rows[:, : len(head)] != head).any():
        return None
    out = np.concatenate([np.broadcast_to(new, (len(rows), len(new))), rows[:, len(head) :]], axis=1)
    stops = np.append(0, np.cumsum(there * (len(new) + 16))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(column), [pa.array(there).buffers()[1], pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(out))])


def converted(column: pa.Array, how) -> pa.Array:
    """A binary column through shp_to_wkb or wkb_to_shp; null and empty values, and null shapes, become null. Columns of plain points go by array operations."""
    heads = (_WKB_POINT, _SHAPE_POINT) if how is wkb_to_shp else (_SHAPE_POINT, _WKB_POINT)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if (found := _points(column, *heads)) is not None:
        return found
    return pa.array([how(v) if v else None for v in column.to_pylist()], pa.binary())


def register(spark) -> None:
    """SQL functions shp_to_wkb and wkb_to_shp, a batch at a time."""
    from pyspark.sql import functions as F

    def batched(how):
        @F.arrow_udf("binary")
        def run(values: pa.Array) -> pa.Array:
            return converted(values.cast(pa.binary()), how)

        return run

    spark.udf.register("shp_to_wkb", batched(shp_to_wkb))
    spark.udf.register("wkb_to_shp", batched(wkb_to_shp))
