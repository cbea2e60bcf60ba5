"""Records of the row-block layout to Arrow columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..types import VARIABLE, FieldInfo
from . import lzf, texts
from .header import ID_SPATIAL, Header

RAW = 0x80000000


def blocks(read, at: int, end: int) -> Iterator[bytes]:
    """Plain bytes of the blocks in [at, end) of a file; read(n) gives its next bytes."""
    while at + 4 <= end:
        (mark,) = struct.unpack("<I", read(4))
        size = mark & ~RAW
        if at + 4 + size > end:
            return  # a truncated last block
        data = read(size)
        at += 4 + size
        yield data if mark & RAW else lzf.decompress(data)


def looks_like_records(block: bytes, fixed: int, probes: int = 3) -> bool:
    """Whether up to three records, one after the other, fit a block; grid blocks of a spatial index don't."""
    at = 0
    for _ in range(probes):
        if at + fixed + 4 > len(block):
            return at > 0 and at == len(block)
        (more,) = struct.unpack_from("<I", block, at + fixed)
        at += fixed + 4 + more
        if at > len(block):
            return False
        if at == len(block):
            return True
    return True


class Framer:
    """Bytes in, whole records out: (bytes, places of the records); keeps the tail for what comes next."""

    def __init__(self, fixed: int, variable: bool):
        self.fixed, self.variable, self.rest = fixed, variable, b""

    def feed(self, data: bytes) -> tuple[bytes, np.ndarray]:
        data = self.rest + data if self.rest else data
        n, fixed = len(data), self.fixed
        if not self.variable:
            count = n // fixed if fixed else 0
            self.rest = data[count * fixed :]
            return data, np.arange(count, dtype=np.int64) * fixed
        found, places, at, head, size = [], [], 0, fixed + 4, struct.Struct("<I").unpack_from
        flat, guess, alone = np.frombuffer(data, dtype=np.uint8), 16, 0
        while at + head <= n:
            stride = head + size(data, at + fixed)[0]
            if at + stride > n:
                break
            if alone:  # the last ones differed in size
                places.append(at)
                at, alone = at + stride, alone - 1
                continue
            # records of one size are found at once: as many as tell this size where they'd begin
            k = min(guess, (n - at) // stride)
            sizes = np.ascontiguousarray(np.lib.stride_tricks.as_strided(flat[at + fixed :], (k, 4), (stride, 1))).view("<u4").ravel() + head
            same = k if (sizes == stride).all() else int((sizes != stride).argmax())
            found += [np.array(places, dtype=np.int64), at + stride * np.arange(same)]
            places, at, guess, alone = [], at + stride * same, min(2 * guess, 1 << 16) if same == guess else 16, 0 if same >= 8 else 256
        self.rest = data[at:]
        return data, np.concatenate([*found, np.array(places, dtype=np.int64)])


class Decoder:
    """Records of one chunk to columns of the wanted fields."""

    def __init__(self, header: Header, wanted: list[str] | None = None):
        self.header, at, self.places = header, 0, {}
        for f in header.fields:
            self.places[f.name] = (f, at)
            at += f.width
        names = [f.name for f in header.fields] if wanted is None else wanted
        self.fields = [self.places[n][0] for n in names]

    @property
    def schema(self) -> pa.Schema:
        return pa.schema([(f.name, f.arrow) for f in self.fields])

    def batch(self, data: bytes, places: np.ndarray, chosen: np.ndarray | None = None) -> pa.RecordBatch:
        """Records at the places; chosen: only those of these numbers."""
        flat = np.frombuffer(data, dtype=np.uint8)
        stops = np.append(places[1:], len(flat))
        if len(places) and not self.header.variable:
            fixed = self.header.fixed
            rows = flat[: len(places) * fixed].reshape(-1, fixed)
            rows = rows if chosen is None else rows[chosen]
            cells = lambda at, width: rows[:, at : at + width]
        elif len(places) > 1 and (np.diff(places) == places[1] - places[0]).all():
            # records of one size are a matrix
            rows = np.lib.stride_tricks.as_strided(flat[places[0] :], (len(places), self.header.fixed + 4), (int(places[1] - places[0]), 1))
            rows = rows if chosen is None else rows[chosen]
            cells = lambda at, width: rows[:, at : at + width]
        else:
            cells = lambda at, width: flat[places[:, None] + np.arange(at, at + width)]
        if chosen is not None:
            places, stops = places[chosen], stops[chosen]
        columns = []
        for f in self.fields:
            _, at = self.places[f.name]
            columns.append(self._variable(f, flat, stops, places + at, cells(at, 4)) if f.type in VARIABLE else self._fixed(f, cells(at, f.width)))
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)

    @staticmethod
    def _fixed(f: FieldInfo, c: np.ndarray) -> pa.Array:
        number = {"Int16": "<i2", "Int32": "<i4", "Int64": "<i8", "Float": "<f4", "Double": "<f8"}
        null = c[:, -1] == 1
        if f.type == "Bool":
            return pa.array(c[:, 0] == 1, mask=c[:, 0] == 2)
        if f.type == "Byte":
            return pa.array(c[:, 0].astype(np.int16), mask=null)
        if f.type in number:
            values = np.ascontiguousarray(c[:, :-1]).view(number[f.type]).ravel()
            return pa.Array.from_buffers(f.arrow, len(values), [texts._mask(~null), pa.py_buffer(values)])
        if f.type in ("Date", "DateTime"):
            days, ok = texts.dates(c)
            if f.type == "Date":
                return pa.array(days.astype(np.int32), pa.int32(), mask=null | ~ok).cast(pa.date32())
            s, fine = texts.seconds(c[:, 11:19])
            return pa.array((days * 86_400 + s) * 1_000_000, pa.int64(), mask=null | ~ok | ~fine).cast(pa.timestamp("us"))
        if f.type == "Time":
            s, ok = texts.seconds(c)
            return pa.array(s * 1_000_000_000, pa.int64(), mask=null | ~ok).cast(pa.time64("ns"))
        unit = 2 if f.type == "WString" else 1
        body, off = texts.until_nul(c[:, :-1], unit)
        if null.any():
            body, off = _emptied(body, off, null)
        if f.type == "WString":
            return texts.utf16(body, off, ~null)
        if f.type == "String":
            return texts.utf8(body, off, ~null)
        raw = body.tobytes()
        found = []
        for a, b, x in zip(off[:-1].tolist(), off[1:].tolist(), null.tolist()):
            try:
                found.append(None if x else raw[a:b].decode("utf-8"))
            except UnicodeDecodeError:
                found.append("0")
        return texts.decimals(found, *f.decimal)

    @staticmethod
    def _variable(f: FieldInfo, flat: np.ndarray, stop: np.ndarray, cell: np.ndarray, raw: np.ndarray) -> pa.Array:
        """Text or bytes behind 4-byte cells: 0 is empty, 1 null, some bytes stand in the cell itself, else it points ahead from its own place."""
        v = np.ascontiguousarray(raw).view("<u4").ravel().astype(np.int64)
        valid = v != 1
        start, length = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
        tiny = (v & 0x80000000 == 0) & (v & 0x30000000 != 0)
        size = v >> 28
        start[tiny], length[tiny] = cell[tiny], size[tiny]
        valid &= ~(tiny & (size > 3))  # more than the cell has room for
        far = np.flatnonzero((v > 1) & ~tiny)
        at = cell[far] + (v[far] & 0x7FFFFFFF)
        ok = at < stop[far]
        first = flat[np.minimum(at, max(0, len(flat) - 1))].astype(np.int64) if len(flat) else np.zeros(len(far), np.int64)
        small = first & 1 == 1
        long_at = np.minimum(at[:, None] + np.arange(4), max(0, len(flat) - 1))
        long_size = np.ascontiguousarray(flat[long_at]).view("<u4").ravel().astype(np.int64) >> 1 if len(far) else np.zeros(0, np.int64)
        start[far] = at + np.where(small, 1, 4)
        length[far] = np.where(small, first >> 1, long_size)
        ok &= start[far] + length[far] <= stop[far]  # a pointer out of the record is no value
        valid[far] &= ok
        length[~valid] = 0
        body, off = texts.gather(flat, start, length), texts.offsets_of(length)
        if f.type == "V_WString":
            return texts.utf16(body, off, valid)
        return texts.utf8(body, off, valid) if f.type == "V_String" else texts.arrow_bytes(body, off, valid, pa.binary())


def _emptied(body: np.ndarray, off: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.where(null, 0, np.diff(off))
    return texts.gather(body, off[:-1], length), texts.offsets_of(length)


def read_range(f, header: Header, start: int, end: int, records: int | None, wanted: list[str] | None, batch_bytes: int = 16 << 20, tests: tuple = ()) -> Iterator[pa.RecordBatch]:
    """Batches of the records in bytes [start, end) of an open file. Raises if they aren't `records` many (None: as many as there are).

    tests: pairs (column, function from its array to a mask). Their columns are decoded first, the others only for records that pass all of them.
    """
    f.seek(start)
    decoder, framer, left = Decoder(header, wanted), Framer(header.fixed, header.variable), records
    grid = header.file_id == ID_SPATIAL and header.spatial_index > 0 and header.variable
    if header.compression:
        source = (b for b in blocks(f.read, start, end) if not grid or framer.rest or looks_like_records(b, header.fixed))
    else:
        source = (f.read(min(1 << 20, end - at)) for at in range(start, end, 1 << 20))
    held, size = [], 0

    def flush():
        nonlocal left, held, size
        data, places = framer.feed(b"".join(held))
        held, size = [], 0
        if left is not None and len(places) > left:
            raise ValueError(f"{header.path}: more records than its header tells")
        if len(places):
            left = None if left is None else left - len(places)
            if not tests:
                return decoder.batch(data, places)
            chosen = None
            for column, passes in tests:
                ok = passes(Decoder(header, [column]).batch(data, places, chosen).column(0))
                chosen = np.flatnonzero(ok) if chosen is None else chosen[ok]
                if not len(chosen):
                    return None
            return decoder.batch(data, places, chosen)
        return None

    for block in source:
        held.append(block)
        size += len(block)
        if size >= batch_bytes:
            if (b := flush()) is not None:
                yield b
    if held and (b := flush()) is not None:
        yield b
    if framer.rest:
        raise ValueError(f"{header.path}: {len(framer.rest)} bytes after the last whole record")
    if left:
        raise ValueError(f"{header.path}: {left} records fewer than its header tells")
