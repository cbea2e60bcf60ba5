"""Headers and field lists of both layouts."""

from __future__ import annotations

import dataclasses
import struct
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

from ..types import KINDS, FieldInfo
from .files import opened

# Fixed values of the format.
MAGIC_E1, MAGIC_E2 = b"Alteryx Database File", b"Alteryx e2 Database file"
ID_PLAIN, ID_SPATIAL, ID_E2 = 0x00440204, 0x00440205, 0x00440208
HEADER_E1, HEADER_E2 = 512, 100
MOST_RECORDS, MOST_FIELDS, MOST_XML, MOST_FIXED = 10_000_000_000, 100_000, 64 << 20, 64 << 20
#: Records between two entries of the block index.
INDEXED = 65_536


@dataclasses.dataclass(frozen=True)
class Header:
    path: str
    layout: str  # E1 or E2
    fields: tuple[FieldInfo, ...]
    file_id: int
    data_start: int
    file_size: int
    records: int | None = None  # E2 doesn't say
    spatial_index: int = 0
    block_index: int = 0
    compression: int = 1

    @property
    def fixed(self) -> int:
        return sum(f.width for f in self.fields)

    @property
    def variable(self) -> bool:
        return any(f.type in ("V_String", "V_WString", "Blob", "SpatialObj") for f in self.fields)

    @property
    def data_end(self) -> int:
        """The block index ends the data where it lies behind its start."""
        return min(self.block_index, self.file_size) if self.block_index > self.data_start else self.file_size


def layout_of(start: bytes) -> str:
    if len(start) < 64:
        raise ValueError("too short for a YXDB file")
    if start.startswith(MAGIC_E2):
        return "E2"
    if start.startswith(MAGIC_E1):
        return "E1"
    raise ValueError("not a YXDB file")


def _whole(text: str | None) -> int:
    try:
        return max(0, int(text or 0))
    except ValueError:
        return 0


def parse_fields(xml: str) -> tuple[FieldInfo, ...]:
    text = xml.rstrip("\0 \r\n\t")
    if text.startswith("<?"):
        text = text[text.index("?>") + 2 :]  # a declared encoding says nothing about text that is decoded already
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("the metadata declares entities")
    try:
        root = ElementTree.fromstring(f"<all>{text}</all>")
    except ElementTree.ParseError as e:
        raise ValueError(f"the metadata is not XML: {e}") from None
    found = [f for info in root.iter("RecordInfo") for f in info.iter("Field")]
    if not found:
        raise ValueError("the metadata has no fields")
    if len(found) > MOST_FIELDS:
        raise ValueError(f"{len(found)} fields are more than {MOST_FIELDS}")
    out = []
    for f in found:
        kind = f.get("type", "")
        if kind not in KINDS:
            raise TypeError(f"unknown field type {kind!r}")
        out.append(FieldInfo(f.get("name", ""), kind, _whole(f.get("size")), _whole(f.get("scale"))))
    return tuple(out)


def read_header(path: str) -> Header:
    with opened(path) as f:
        size = f.size()
        start = f.read(HEADER_E1)
        layout = layout_of(start)
        if layout == "E2":
            return _header_e2(path, f, size, start)
        if len(start) < HEADER_E1:
            raise ValueError("the header is cut off")
        units, spatial, index, records, compression = (struct.unpack_from(k, start, at)[0] for k, at in (("<I", 80), ("<q", 88), ("<q", 96), ("<Q", 104), ("<i", 112)))
        if records > MOST_RECORDS:
            raise ValueError(f"implausible number of records: {records}")
        if 2 * units > MOST_XML or HEADER_E1 + 2 * units > size:
            raise ValueError("the metadata is cut off or implausibly large")
        if compression not in (0, 1):
            raise ValueError(f"unknown compression {compression}")
        fields = parse_fields(f.read(2 * units).decode("utf-16-le", "replace"))
        out = Header(path, layout, fields, struct.unpack_from("<I", start, 64)[0], HEADER_E1 + 2 * units, size, records, spatial, index, compression)
        if out.fixed > MOST_FIXED:
            raise ValueError("implausibly wide records")
        return out


def _header_e2(path: str, f, size: int, start: bytes) -> Header:
    if len(start) < HEADER_E2:
        raise ValueError("the header is cut off")
    (file_id,), (length,) = struct.unpack_from("<I", start, 64), struct.unpack_from("<I", start, 96)
    if file_id != ID_E2:
        raise ValueError(f"unknown file id {file_id:#x}")
    if length > MOST_XML or HEADER_E2 + length > size:
        raise ValueError("the metadata is cut off or implausibly large")
    f.seek(HEADER_E2)
    return Header(path, "E2", parse_fields(f.read(length).decode("utf-8", "replace")), file_id, HEADER_E2 + length, size)


def build_header(fields: list[FieldInfo], records: int, block_index: int, compression: int = 1) -> bytes:
    lines = []
    for f in fields:
        size = f' scale="{f.scale}" size="{f.size}"' if f.type == "FixedDecimal" else f' size="{f.size}"' if f.size and f.type in ("String", "WString", "V_String", "V_WString", "Blob", "SpatialObj") else ""
        lines.append(f"\t<Field name={quoteattr(f.name, {chr(34): '&quot;', chr(39): '&apos;'})}{size} source=\"yxspark\" type=\"{f.type}\"/>\n")
    xml = ("<RecordInfo>\n" + "".join(lines) + "</RecordInfo>\n\0").encode("utf-16-le")
    out = bytearray(HEADER_E1)
    out[: len(MAGIC_E1)] = MAGIC_E1
    struct.pack_into("<I", out, 64, ID_PLAIN)
    struct.pack_into("<I", out, 80, len(xml) // 2)
    struct.pack_into("<qQi", out, 96, block_index, records, compression)
    return bytes(out) + xml
