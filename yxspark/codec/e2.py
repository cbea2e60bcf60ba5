"""The Snappy-based layout (read only): blocks, records, and cells with a prefix byte each."""

from __future__ import annotations

import bisect
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..types import FieldInfo
from . import texts
from .files import opened
from .header import Header

# Fixed values of the format.
MOST_BLOCK = 512 << 20
MARK = 0x0A
NULLS = {"Bool": (0x43,), "Byte": (0x47,), "Int16": (0x45,), "Int32": (0x49,), "Int64": (0x4A,), "Float": (0x4B,), "Double": (0x48, 0x4C), "Date": (0x4D,), "DateTime": (0x4E,), "Time": (0x4F,), "String": (0x41, 0), "WString": (0x41, 0), "V_String": (0x41, 0), "V_WString": (0x41, 0), "Blob": (0x41, 0), "SpatialObj": (0x43, 0), "FixedDecimal": (0x4C, 0)}
INT_BYTES = {"Byte": 1, "Int16": 2, "Int32": 4, "Int64": 8}
BASES = {"Date": 0x0A, "DateTime": 8, "Time": 0x0C}
LONG = {"String": (1,), "WString": (1,), "V_String": (1,), "V_WString": (1,), "Blob": (1, 2), "SpatialObj": (1, 3)}
FAR = {"Blob": 0x12, "SpatialObj": 0x13}
#: Types whose E2 form is not established; reading them must be asked for.
UNVERIFIED = ("Time", "WString")
OLE_EPOCH = 25_569  # days from 1899-12-30 to 1970-01-01


class Malformed(ValueError):
    """A record that can't be decoded."""


class Reference:
    def __init__(self, at: int, length: int | None = None):
        self.at, self.length = at, length


def unsnapped(data: bytes) -> bytes:
    """A block's content: a mark and raw Snappy data, whose first varint is the plain size."""
    size = plain_size(data[:6])
    if size > 8 * MOST_BLOCK:
        raise ValueError("implausibly large E2 block")
    try:
        return pa.Codec("snappy").decompress(data[1:], decompressed_size=size, asbytes=True)
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"E2 block: {e}") from None


def walk(f, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(type, block start, content start, content size) of every block."""
    while at < end:
        f.seek(at)
        kind = f.read(1)
        if not kind or kind[0] == 0:
            return
        head = f.read(4)
        if len(head) < 4:
            raise ValueError("an E2 block is cut off")
        (size,) = struct.unpack("<I", head)
        if size > MOST_BLOCK:
            raise ValueError(f"implausibly large E2 block: {size} bytes")
        if kind[0] not in (1, 2, 3, 4):
            raise ValueError(f"unknown E2 block type {kind[0]:#04x}")
        body = at + 5 + (20 if kind[0] == 1 else 4 if kind[0] in (3, 4) else 0)
        if body + size > end:
            raise ValueError("an E2 block is cut off")
        yield kind[0], at, body, size
        at = body + size


def records(plain: bytes) -> Iterator[bytes]:
    if len(plain) < 12:
        raise ValueError("an E2 record block is cut off")
    _, count, _ = (x & 0x7FFFFFFF for x in struct.unpack_from("<III", plain))
    # the first record's size is the third number, later ones have theirs before them
    at = 8
    for _ in range(count):
        if at + 4 > len(plain):
            return
        size = struct.unpack_from("<I", plain, at)[0] & 0x7FFFFFFF
        if at + 4 + size > len(plain):
            raise ValueError("an E2 record reaches beyond its block")
        yield plain[at + 4 : at + 4 + size]
        at += 4 + size


def _take(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise Malformed("a cell is cut off")
    return data[at : at + n]


def _decimal(data: bytes, at: int, f: FieldInfo):
    """Mark 4, digits - 1, sign and scale, then packed digits; or text."""
    p = data[at]
    if p == 4:
        more, mark = _take(data, at + 1, 2)
        packed = _take(data, at + 3, more // 2 + 1).hex()[: more + 1]
        if not packed.isdigit():
            raise Malformed("a decimal has other than digits")
        scale = mark & 0x7F
        text = packed.rjust(scale + 1, "0")
        text = f"{text[: len(text) - scale]}.{text[len(text) - scale:]}" if scale else text
        return ("-" if mark & 0x80 else "") + text, at + 4 + more // 2
    if p & 0x80:
        return _take(data, at + 1, p & 0x7F).decode("utf-8", "replace"), at + 1 + (p & 0x7F)
    if p == 1:
        (n,) = struct.unpack("<H", _take(data, at + 1, 2))
        return _take(data, at + 3, n).decode("utf-8", "replace"), at + 3 + n
    raise Malformed(f"prefix {p:#04x} in a decimal")


def cell(data: bytes, at: int, f: FieldInfo, base: int = 6):
    """A value (numbers raw, dates as days since 1970, times in centiseconds, datetimes in microseconds, text as bytes) and what comes after it."""
    if at >= len(data):
        raise Malformed("the record ends before its last field")
    p, kind = data[at], f.type
    if p in NULLS[kind]:
        return None, at + 1
    if kind == "Bool":
        if p not in (0x14, 0x15):
            raise Malformed(f"prefix {p:#04x} in a Bool")
        return p == 0x15, at + 1
    if kind in INT_BYTES:
        low = 6 if kind == "Byte" else base
        if p < low:
            return None, at + 1
        n = p - low
        if n > 8:
            raise Malformed(f"prefix {p:#04x} in an integer")
        width = max(INT_BYTES[kind], n)
        value = int.from_bytes(_take(data, at + 1, n).ljust(width, b"\0"), "little", signed=kind != "Byte")
        bits = 8 * INT_BYTES[kind]
        if not (0 <= value < 256 if kind == "Byte" else -(1 << bits - 1) <= value < 1 << bits - 1):
            raise Malformed(f"{value} in a {kind}")
        return value, at + 1 + n
    if kind in ("Float", "Double"):
        low, width = (7, 4) if kind == "Float" else (6, 8)
        if p < low:
            return None, at + 1
        if p == low:
            return 0.0, at + 1
        n = p - (7 if kind == "Float" else 4)
        if n > width:
            raise Malformed(f"prefix {p:#04x} in a {kind}")
        raw = _take(data, at + 1, n).ljust(width, b"\0")
        return struct.unpack("<f" if kind == "Float" else "<d", raw)[0], at + 1 + n
    if kind in BASES:
        low = BASES[kind]
        if p < low:
            return None, at + 1
        n = p - low
        if n > 8:
            raise Malformed(f"prefix {p:#04x} in a {kind}")
        value = int.from_bytes(_take(data, at + 1, n), "little")
        if kind == "Date":
            return value - OLE_EPOCH, at + 1 + n
        if kind == "DateTime":
            return ((value >> 24) - OLE_EPOCH) * 86_400_000_000 + (value & 0xFFFFFF) * 10_000, at + 1 + n
        return value, at + 1 + n
    if kind == "FixedDecimal":
        return _decimal(data, at, f)
    if p & 0x80:
        return _take(data, at + 1, p & 0x7F), at + 1 + (p & 0x7F)
    if p in LONG[kind]:
        (n,) = struct.unpack("<H", _take(data, at + 1, 2))
        return _take(data, at + 3, n), at + 3 + n
    if p == 0x11:
        return Reference(*struct.unpack("<II", _take(data, at + 1, 8))), at + 9
    if p == FAR.get(kind):
        return Reference(struct.unpack("<Q", _take(data, at + 1, 8))[0]), at + 9
    raise Malformed(f"prefix {p:#04x} in a {kind}")


def row(data: bytes, fields: tuple[FieldInfo, ...], shape: tuple) -> list:
    """shape: (base of integers, whether a zero byte precedes the first date)."""
    base, flagged = shape
    at, out = 0, []
    for f in fields:
        if f.type == "Date" and flagged:
            if data[at : at + 1] == b"\0":
                at += 1
            flagged = False
        try:
            value, at = cell(data, at, f, base)
        except Malformed:
            # some files have an integer before a text that their metadata don't tell of
            p = data[at] if at < len(data) else 0xFF
            if f.type not in LONG or not (p <= 0x0E or p == 0x4A):
                raise
            value, at = cell(data, at + 1 + max(0, p - 6) * (p <= 0x0E), f, base)
        out.append(value)
    return out


def shape_of(first: bytes | None, fields: tuple[FieldInfo, ...]) -> tuple:
    """How this file codes integers and dates: the way that reads most of its first record."""
    best, found = -1, (6, False)
    for shape in ((6, False), (6, True), (5, False), (5, True)):
        if first is None or shape[1] and not any(f.type == "Date" for f in fields) or shape[0] == 5 and not any(f.type in INT_BYTES for f in fields):
            continue
        try:
            row(first, fields, shape)
            read = len(first) - _left(first, fields, shape)
            read = 2 * len(first) if read == len(first) else read
        except (Malformed, struct.error):
            read = -1
        if read > best:
            best, found = read, shape
    return found


def _left(data: bytes, fields, shape) -> int:
    base, flagged = shape
    at = 0
    for f in fields:
        if f.type == "Date" and flagged:
            at, flagged = at + (data[at : at + 1] == b"\0"), False
        _, at = cell(data, at, f, base)
    return len(data) - at


def check_verified(h: Header, allow: bool) -> None:
    odd = [f"{f.name} ({f.type})" for f in h.fields if f.type in UNVERIFIED]
    if odd and not allow:
        raise TypeError(f"the E2 form of these fields is not verified: {', '.join(odd)}; option allowUnverifiedE2Types reads them all the same")


def plan_blocks(h: Header, target: int) -> list:
    """Runs of record blocks of about `target` bytes; record blocks stand for themselves."""
    from ..plans.splits import Split

    out, shape, begin, stop = [], None, None, None
    with opened(h.path) as f:
        for kind, at, body, size in walk(f, h.data_start, h.file_size):
            if kind != 2:
                continue
            if shape is None:
                f.seek(body)
                shape = shape_of(next(records(unsnapped(f.read(size))), None), h.fields)
            begin = at if begin is None else begin
            stop = body + size
            if stop - begin >= target:
                out.append(Split(h.path, begin, stop, None, None, None, shape))
                begin = None
    if begin is not None:
        out.append(Split(h.path, begin, stop, None, None, None, shape))
    return out


def count(h: Header) -> int:
    """Records of a file, from its blocks."""
    n = 0
    with opened(h.path) as f:
        for kind, _, body, size in walk(f, h.data_start, h.file_size):
            if kind == 2:
                f.seek(body)
                n += struct.unpack_from("<I", unsnapped(f.read(size)), 4)[0] & 0x7FFFFFFF
    return n


def plain_size(start: bytes) -> int:
    """Of a block's plain content, from its first bytes: a mark and a varint."""
    if not start or start[0] != MARK:
        raise ValueError("an E2 block lacks its 0x0A mark")
    size = shift = 0
    for b in start[1:6]:
        size |= (b & 127) << shift
        shift += 7
        if b < 128:
            break
    return size


class Blobs:
    """Values kept in blob blocks: by their block's place, or by place in all blob blocks one after the other. Holds the last block read and no other."""

    def __init__(self, f, h: Header):
        self.f, self.h, self.found, self.ends, self.last = f, h, None, None, (None, b"")

    def get(self, r: Reference) -> bytes | None:
        if self.found is None:
            self.found = {at: (body, size) for kind, at, body, size in walk(self.f, self.h.data_start, self.h.file_size) if kind == 1}
            self.places = sorted(self.found)
        if r.length is None:
            return self._block(r.at) if r.at in self.found else None
        if self.ends is None:
            self.ends = list(itertools.accumulate(map(self._size, self.places)))
        stop = r.at + r.length
        if stop > (self.ends[-1] if self.ends else 0):
            return None
        out, k = [], bisect.bisect_right(self.ends, r.at)
        while r.length and (begin := self.ends[k - 1] if k else 0) < stop:
            out.append(self._block(self.places[k])[max(0, r.at - begin) : stop - begin])
            k += 1
        return b"".join(out)

    def _size(self, at: int) -> int:
        body, size = self.found[at]
        self.f.seek(body)
        return plain_size(self.f.read(min(size, 6)))

    def _block(self, at: int) -> bytes:
        if self.last[0] != at:
            body, size = self.found[at]
            self.f.seek(body)
            self.last = at, unsnapped(self.f.read(size))
        return self.last[1]


def _column(f: FieldInfo, values: list) -> pa.Array:
    if f.type in ("String", "WString", "V_String", "V_WString"):
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in values], pa.string())
    if f.type == "FixedDecimal":
        return texts.decimals(values, *f.decimal)
    if f.type == "Time":
        return pa.array([None if v is None else v * 10_000_000 for v in values], pa.int64()).cast(pa.time64("ns"))
    if f.type == "Date":
        return pa.array([v if v is None or -(1 << 31) <= v < 1 << 31 else None for v in values], pa.int32()).cast(pa.date32())
    if f.type == "DateTime":
        return pa.array(values, pa.int64()).cast(pa.timestamp("us"))
    return pa.array(values, f.arrow)


def read_split(f, h: Header, split, wanted: list[str] | None, mode: str = "PERMISSIVE", rows: int = 16_384, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """mode: PERMISSIVE (a record that can't be decoded is all null), DROPMALFORMED or FAILFAST. A batch ends at so many rows or bytes."""
    names = [x.name for x in h.fields] if wanted is None else wanted
    place = {x.name: i for i, x in enumerate(h.fields)}
    chosen = [(h.fields[place[n]], place[n]) for n in names]
    blobs, held, size_ = Blobs(f, h), [], 0

    def batch():
        columns = [_column(x, [r[k] for r in held]) for k, (x, _) in enumerate(chosen)]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema([(x.name, x.arrow) for x, _ in chosen]))

    for kind, _, body, size in list(walk(f, split.start, split.end)):
        if kind != 2:
            continue
        f.seek(body)
        for data in records(unsnapped(f.read(size))):
            try:
                values = row(data, h.fields, split.shape or (6, False))
                held.append([blobs.get(v) if isinstance(v := values[i], Reference) else v for _, i in chosen])
                size_ += sum(len(v) for v in held[-1] if isinstance(v, (bytes, str)))
            except Malformed:
                if mode == "FAILFAST":
                    raise
                if mode != "DROPMALFORMED":
                    held.append([None] * len(chosen))
            if len(held) >= rows or size_ >= most:
                size_ = 0
                yield batch()
    if held:
        yield batch()
