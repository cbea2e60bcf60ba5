"""Small encoder of the Snappy-based layout, in the cell forms that are established: it makes what queries and tests read. The layout isn't a write format of the library."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa

from ..types import FieldInfo
from .e2 import BASES, MARK, OLE_EPOCH
from .header import HEADER_E2, ID_E2, MAGIC_E2

# Fixed values of the format: the null mark of each type.
NULL = {"Bool": 0x43, "Byte": 0x47, "Int16": 0x45, "Int32": 0x49, "Int64": 0x4A, "Float": 0x4B, "Double": 0x48, "Date": 0x4D, "DateTime": 0x4E, "String": 0x41, "V_String": 0x41, "V_WString": 0x41, "Blob": 0x41, "SpatialObj": 0x43, "FixedDecimal": 0x4C}
_EPOCH = datetime.date(1970, 1, 1)
#: Values longer than this go to a blob block.
FAR = 0xFFFF


def _number(value: int, base: int, signed: bool = True) -> bytes:
    n = 1
    while not (-(1 << 8 * n - 1) <= value < 1 << 8 * n - 1 if signed else value < 1 << 8 * n):
        n += 1
    return bytes([base + n]) + value.to_bytes(n, "little", signed=signed)


def _packed(value: Decimal) -> bytes:
    sign, digits, exponent = value.as_tuple()
    text = "".join(map(str, digits))
    return bytes([4, len(text) - 1, -exponent | sign << 7]) + bytes.fromhex(text + "0" * (len(text) % 2))


class Encoder:
    """Records of a file, with blob blocks for what is too long for a record. before: bytes in earlier blob blocks, which count as one with the later ones."""

    def __init__(self, fields: list[FieldInfo]):
        self.fields, self.blob, self.before = fields, bytearray(), 0

    def cell(self, f: FieldInfo, value) -> bytes:
        if value is None:
            return bytes([NULL[f.type]])
        if f.type == "Bool":
            return b"\x15" if value else b"\x14"
        if f.type in ("Byte", "Int16", "Int32", "Int64"):
            return _number(value, 6, f.type != "Byte")
        if f.type == "Double":
            return b"\x06" if value == 0 else b"\x0c" + struct.pack("<d", value)
        if f.type == "Date":
            return _number((value - _EPOCH).days + OLE_EPOCH, BASES["Date"], False)
        if f.type == "DateTime":
            seconds = value.hour * 3600 + value.minute * 60 + value.second
            return _number((value.date() - _EPOCH).days + OLE_EPOCH << 24 | seconds * 100 + value.microsecond // 10_000, BASES["DateTime"], False)
        if f.type == "FixedDecimal":
            return _packed(value)
        raw = value.encode() if isinstance(value, str) else bytes(value)
        if len(raw) < 128:
            return bytes([0x80 | len(raw)]) + raw
        if len(raw) <= FAR:
            return b"\x01" + struct.pack("<H", len(raw)) + raw
        self.blob += raw
        return b"\x11" + struct.pack("<II", self.before + len(self.blob) - len(raw), len(raw))

    def record(self, values) -> bytes:
        return b"".join(map(self.cell, self.fields, values))

    def blob_block(self) -> bytes:
        """What was put aside since the last call."""
        out = _block(1, bytes(self.blob)) if self.blob else b""
        self.before += len(self.blob)
        self.blob.clear()
        return out


def _block(kind: int, data: bytes) -> bytes:
    packed = bytes([MARK]) + pa.Codec("snappy").compress(data, asbytes=True)
    return bytes([kind]) + struct.pack("<I", len(packed)) + (struct.pack("<I", len(data)) + bytes(16) if kind == 1 else b"") + packed


#: A block ends when it has so many bytes, if its records aren't enough.
MOST = 1 << 20


def file_parts(fields: list[FieldInfo], rows, per_block: int = 1000, broken=lambda values: False) -> Iterator[bytes]:
    """A file of the rows (lists of values), block by block; records for which `broken` holds end within their first cell."""
    from xml.sax.saxutils import quoteattr

    encoder, held, size = Encoder(fields), [], 0
    xml = "<RecordInfo>" + "".join(f'<Field name={quoteattr(f.name)} type="{f.type}" size="{f.size}" scale="{f.scale}"/>' for f in fields) + "</RecordInfo>"
    head = bytearray(HEADER_E2)
    head[: len(MAGIC_E2)] = MAGIC_E2
    struct.pack_into("<I", head, 64, ID_E2)
    struct.pack_into("<I", head, 96, len(xml.encode()))
    yield bytes(head) + xml.encode()

    def block() -> bytes:
        body = b"".join(x for r in held for x in (struct.pack("<I", len(r)), r))
        return encoder.blob_block() + _block(2, struct.pack("<II", len(body) + 4, len(held)) + body)

    for r in rows:
        held.append(b"\xff" if broken(r) else encoder.record(r))
        size += len(held[-1])
        if len(held) == per_block or size + len(encoder.blob) >= MOST:
            yield block()
            held, size = [], 0
    if held:
        yield block()
    yield b"\0"


def file_bytes(fields: list[FieldInfo], rows, per_block: int = 1000, broken=lambda values: False) -> bytes:
    """The same as a whole."""
    return b"".join(file_parts(fields, rows, per_block, broken))
