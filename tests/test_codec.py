"""Bytes of the formats, without Spark."""

import io
import itertools
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from yxspark.codec import e2, lzf, texts
from yxspark.codec.e1_decode import Decoder, Framer, looks_like_records, read_range
from yxspark.codec.e1_encode import FileWriter, write_file
from yxspark.codec.header import Header, build_header, layout_of, parse_fields, read_header
from yxspark.functions.geometry import shp_to_wkb, signed_area, spatial_mode, wkb_to_shp
from yxspark.plans.splits import plan
from yxspark.types import FieldInfo


@given(st.one_of(st.binary(max_size=3000), st.lists(st.sampled_from([b"abc", b"aaaa", b"\0" * 7, b"xyz1"]), max_size=400).map(b"".join)))
@settings(max_examples=80, deadline=None)
def test_lzf_round_trip(data):
    packed = lzf.compress(data)
    assert packed is None or len(packed) < len(data) and lzf.decompress(packed) == data


def test_lzf_long_copies_and_limits():
    data = b"A" * 262_144
    assert lzf.decompress(lzf.compress(data)) == data
    for bad in (b"\x05ab", b"\x20", b"\xe0\x05", b"\x20\x00"):
        with pytest.raises(ValueError):
            lzf.decompress(bad)
    with pytest.raises(ValueError):
        lzf.decompress(lzf.compress(data), limit=1000)


def test_lzf_against_the_jvm(spark):
    """Another decoder reads what we write."""
    data = b"".join(b"row %05d;" % (i % 700) for i in range(3000))
    packed = lzf.compress(data)
    framed = b"ZV\x01" + struct.pack(">HH", len(packed), len(data)) + packed
    assert bytes(spark._jvm.com.ning.compress.lzf.LZFDecoder.decode(bytearray(framed))) == data


def test_layouts():
    assert layout_of(b"Alteryx Database File".ljust(64)) == "E1"
    assert layout_of(b"Alteryx e2 Database file".ljust(64)) == "E2"
    for bad in (b"", b"Alteryx Database File", b"x" * 64):
        with pytest.raises(ValueError):
            layout_of(bad)


def test_field_lists():
    fields = parse_fields('<a><RecordInfo><Field name="A&amp;B &lt;&quot;" type="V_String" size="x"/><Field name="d" type="FixedDecimal" size="19" scale="6"/></RecordInfo><Field name="no" type="Int32"/></a>\0')
    assert [(f.name, f.type, f.size, f.scale) for f in fields] == [('A&B <"', "V_String", 0, 0), ("d", "FixedDecimal", 19, 6)]
    assert fields[1].decimal == (17, 6)
    with pytest.raises(TypeError):
        parse_fields('<RecordInfo><Field name="a" type="Complex"/></RecordInfo>')
    for bad in ("<RecordInfo></RecordInfo>", "<RecordInfo><Field", ""):
        with pytest.raises(ValueError):
            parse_fields(bad)
    names = ["Ñame", "日付", "A&B", "C<D", 'E"F', "user.id", "100%", "it's"]
    head = build_header([FieldInfo(n, "Int32") for n in names], 0, 0)
    assert [f.name for f in parse_fields(head[512:].decode("utf-16-le"))] == names


def test_repr_and_equality():
    assert repr(FieldInfo("a", "Int32")) == "FieldInfo(name='a', type='Int32')"
    assert repr(FieldInfo("a", "String", 5)) == "FieldInfo(name='a', type='String', size=5)"
    assert FieldInfo("a", "Int32") == FieldInfo("a", "Int32") != FieldInfo("a", "Int64")


FIELDS = [FieldInfo("b", "Bool"), FieldInfo("y", "Byte"), FieldInfo("i2", "Int16"), FieldInfo("i4", "Int32"), FieldInfo("i8", "Int64"), FieldInfo("f", "Float"), FieldInfo("d", "Double"), FieldInfo("dec", "FixedDecimal", 12, 4), FieldInfo("s", "String", 50), FieldInfo("w", "WString", 50), FieldInfo("vs", "V_String", 5000), FieldInfo("vw", "V_WString", 5000), FieldInfo("dt", "Date"), FieldInfo("t", "Time"), FieldInfo("ts", "DateTime"), FieldInfo("bl", "Blob"), FieldInfo("sp", "SpatialObj")]


def rows_of(fields, rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.arrow) for i, f in enumerate(fields)], names=[f.name for f in fields])


def through_file(tmp_path, fields, batches, **how):
    path = str(tmp_path / "x.yxdb")
    count = write_file(path, fields, batches, **how)
    h = read_header(path)
    assert h.records == count
    with open(path, "rb") as f:
        f.size = lambda: h.file_size
        return pa.Table.from_batches(list(read_range(f, h, h.data_start, h.data_end, h.records, None)), schema=Decoder(h).schema), h


def test_all_types(tmp_path):
    import datetime as d
    from decimal import Decimal

    rows = [
        (True, 7, -1234, 42000, 9_000_000_000, 2.5, 3.141592653589793, Decimal("1234.5678"), "Alteryx", "Ünïcödé", "short var", "x" * 600, d.date(2025, 3, 15), d.time(8, 30), d.datetime(2025, 3, 15, 8, 30), bytes(i % 256 for i in range(1024)), b"\1\2"),
        (False, 255, 32767, -1, -9_000_000_000, -0.5, 0.0, Decimal("-9999.9999"), "Test", "Wïdé", "y" * 800, "z" * 1200, d.date(1999, 1, 1), d.time(23, 59, 59), d.datetime(1999, 1, 1, 23, 59, 59), b"\xff" * 512, b""),
        (None,) * 17,
        (True, 0, -32768, -(2**31), -(2**63), float("inf"), 5e-324, Decimal("0.0000"), "", "", "", "日本語テスト😀", d.date(1, 1, 1), d.time(0, 0), d.datetime(9999, 12, 31, 23, 59, 59), b"", None),
        (False, 1, 0, 2**31 - 1, 2**63 - 1, float("-inf"), -0.0, Decimal("0.0001"), "A" * 50, "B" * 50, "ÿ" * 127, "a\0b", d.date(9999, 12, 31), d.time(12, 0), d.datetime(1969, 12, 31, 23, 59, 59), b"x" * 127, b"x" * 128),
    ]
    table, h = through_file(tmp_path, FIELDS, [rows_of(FIELDS, rows)])
    assert [tuple(r.values()) for r in table.to_pylist()] == [tuple(x for x in r) for r in rows]
    assert list(h.fields) == FIELDS


@pytest.mark.parametrize("kind,rows", [("Int32", 52_428), ("Int32", 52_430), ("Int64", 29_127), ("Int64", 131_080)])
@pytest.mark.parametrize("compress", [True, False])
def test_block_boundaries(tmp_path, kind, rows, compress):
    fields = [FieldInfo("v", kind)]
    values = pa.array(np.arange(rows), fields[0].arrow)
    table, h = through_file(tmp_path, fields, [pa.RecordBatch.from_arrays([values], names=["v"])], compress=compress)
    assert table.column(0).to_pylist() == list(range(rows))
    splits = plan(h, 1)
    assert [s.records for s in splits] == [min(65_536, rows - i) for i in range(0, rows, 65_536)]
    assert len(splits) == -(-rows // 65_536)


def test_records_across_blocks(tmp_path):
    """Records larger than a block straddle blocks."""
    fields = [FieldInfo("id", "Int32"), FieldInfo("data", "Blob")]
    big = [bytes(i % 256 for i in range(512_000)), None, b"tiny", bytes(np.random.default_rng(1).integers(0, 256, 500_000, dtype=np.uint8))]
    table, _ = through_file(tmp_path, fields, [rows_of(fields, list(enumerate(big)))])
    assert table.column("data").to_pylist() == big


@pytest.mark.parametrize("n", [1, 126, 127, 128, 129, 255, 256])
def test_small_and_large_values(tmp_path, n):
    fields = [FieldInfo("s", "V_String", 500), FieldInfo("b", "Blob"), FieldInfo("w", "V_WString", 500)]
    table, _ = through_file(tmp_path, fields, [rows_of(fields, [("a" * n, b"b" * n, "ü" * n)])])
    assert table.to_pylist() == [{"s": "a" * n, "b": b"b" * n, "w": "ü" * n}]


def test_cells_by_hand():
    """Null, empty, tiny, corrupt pointers; broken text; digits that aren't a date."""
    h = Header("x", "E1", (FieldInfo("v", "V_String"),), 0, 0, 0, 6)
    cells = [struct.pack("<I", 1), struct.pack("<I", 0), b"ab\0\x20", struct.pack("<I", 0x80000000 | 4000), struct.pack("<I", 0x80000008)]
    out = b""
    for k, c in enumerate(cells):
        tail = bytes([2 << 1 | 1]) + b"\xff!" if k == 4 else b""
        out += c + struct.pack("<I", len(tail)) + tail
    data, places = Framer(4, True).feed(out)
    found = Decoder(h).batch(data, places).column(0).to_pylist()
    assert found == [None, "", "ab", None, "�!"]
    day = np.frombuffer(b"2025-13-01\0" + b"2025x02y28\0" + b"20a5-01-01\0" + b"2024-02-29\0" + b"2023-02-29\0", dtype=np.uint8).reshape(-1, 11)
    days, ok = texts.dates(day)
    assert ok.tolist() == [False, True, False, True, False]
    assert str(np.datetime64(int(days[3]), "D")) == "2024-02-29"
    assert [texts.unscaled(t, 2) for t in ("1.239", " -12.5", "", "1a2", "-0.01")] == [123, -1250, 0, 1200, -1]


def test_surrogates():
    units = lambda *u: np.array(u, dtype="<u2").view(np.uint8)
    data = units(0xD83D, 0xDE00, 0xD800, 0x41, 0x42, 0xDC00)
    assert texts.utf16(data, np.array([0, 12]), np.array([True])).to_pylist() == ["😀�B�"]


def test_grid_blocks():
    record = struct.pack("<I", 0) + struct.pack("<I", 0)
    assert looks_like_records(record * 3, 4)
    assert not looks_like_records(struct.pack("<II", 7, 1 << 30), 4)


def test_malformed_files(tmp_path):
    fields = [FieldInfo("v", "Int32"), FieldInfo("s", "V_String", 9)]
    path = str(tmp_path / "good.yxdb")
    write_file(path, fields, [rows_of(fields, [(i, str(i)) for i in range(5000)])])
    whole = open(path, "rb").read()
    bad = {"empty": b"", "short": whole[:100], "no_metadata": whole[:512], "magic": b"x" + whole[1:], "count": whole[:104] + b"\xff" * 8 + whole[112:], "metadata": whole[:80] + b"\xff" * 4 + whole[84:], "compression": whole[:112] + b"\7\0\0\0" + whole[116:]}
    for name, data in bad.items():
        p = tmp_path / name
        p.write_bytes(data)
        with pytest.raises((ValueError, OSError)):
            read_header(str(p))
    with pytest.raises((ValueError, OSError)):
        read_header(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        read_header(str(tmp_path / "none"))
    h = read_header(path)
    for cut in (h.data_start + 30, h.data_end - 100):  # fewer records than the header tells
        f = io.BytesIO(whole[:cut])
        with pytest.raises(ValueError):
            list(read_range(f, h, h.data_start, cut, h.records, None))


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_bit_flips_never_hang(data):
    fields = [FieldInfo("v", "Int32"), FieldInfo("s", "V_String", 9)]
    sink = io.BytesIO()
    w = FileWriter(sink, fields)
    w.write(rows_of(fields, [(i, "abc" * (i % 5)) for i in range(300)]))
    head, _ = w.finish()
    raw = bytearray(head + sink.getvalue())
    at = data.draw(st.integers(0, len(raw) - 1))
    raw[at] ^= 1 << data.draw(st.integers(0, 7))
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".yxdb") as f:
        f.write(raw)
        f.flush()
        try:
            h = read_header(f.name)
            list(read_range(io.BytesIO(bytes(raw)), h, h.data_start, h.data_end, h.records, None))
        except (ValueError, OSError, TypeError, OverflowError):
            pass


# ---- the Snappy layout ----------------------------------------------------------------------------------------------

GOLDEN = [
    ("Int32", "08 0F 27", 9999),
    ("String", "83 41 4E 44", b"AND"),
    ("Float", "0B EC F1 33 44", 719.780029296875),
    ("Double", "0C 00 00 00 80 16 18 80 41", 33_751_760.0),
    ("Double", "0C 00 00 00 00 00 00 F0 3F", 1.0),
    ("Date", "0D 7A A6 00", 42618 - 25569),
    ("FixedDecimal", "04 01 00 30", "30"),
    ("FixedDecimal", "04 02 00 27 70", "277"),
    ("FixedDecimal", "04 00 00 40", "4"),
    ("FixedDecimal", "04 08 06 13 00 00 00 00", "130.000000"),
    ("FixedDecimal", "04 09 06 24 25 00 00 00", "2425.000000"),
    ("FixedDecimal", "04 01 80 24", "-24"),
    ("FixedDecimal", "4C", None),
    ("Bool", "14", False), ("Bool", "15", True), ("Bool", "43", None),
    ("Byte", "47", None), ("Byte", "06", 0), ("Byte", "07 FF", 255),
    ("Int64", "4A", None), ("Int16", "03", None),
    ("V_String", "41", None), ("V_String", "00", None), ("V_String", "01 03 00 61 62 63", b"abc"),
    ("Blob", "02 02 00 01 02", b"\1\2"), ("SpatialObj", "43", None),
]


@pytest.mark.parametrize("kind,data,value", GOLDEN)
def test_e2_cells(kind, data, value):
    raw = bytes.fromhex(data)
    assert e2.cell(raw, 0, FieldInfo("x", kind, 19, 6)) == (value, len(raw))


def test_e2_datetime():
    us, _ = e2.cell(bytes.fromhex("0E 84 21 78 70 AF 00"), 0, FieldInfo("x", "DateTime"))
    assert str(np.datetime64(us, "us"))[:19] == "2022-12-17T21:52:09"


def e2_file(path, fields, rows, blobs=(), flag=False, base=6):
    """A small encoder, for tests only. rows: lists of encoded cells."""

    def block(kind, data):
        packed = b"\x0a" + pa.Codec("snappy").compress(data, asbytes=True)
        return bytes([kind]) + struct.pack("<I", len(packed)) + (struct.pack("<I", len(data)) + b"\0" * 16 if kind == 1 else b"") + packed

    xml = "<RecordInfo>" + "".join(f'<Field name="{f.name}" type="{f.type}" size="{f.size}" scale="{f.scale}"/>' for f in fields) + "</RecordInfo>"
    head = bytearray(100)
    head[:24] = b"Alteryx e2 Database file"
    struct.pack_into("<I", head, 64, 0x00440208)
    struct.pack_into("<I", head, 96, len(xml.encode()))
    out = bytes(head) + xml.encode()
    for b in blobs:
        out += block(1, b)
    for part in rows:
        records = [b"".join(r) for r in part]
        body = b"".join(struct.pack("<I", len(r)) + r for r in records)
        out += block(2, struct.pack("<II", len(body) + 4, len(part)) + body)
    open(path, "wb").write(out + b"\0" + b"YXE2")


def test_e2_read(spark, tmp_path):
    import yxspark as y

    fields = [FieldInfo("i", "Int32"), FieldInfo("d", "Date"), FieldInfo("s", "V_String", 9), FieldInfo("b", "Blob")]
    cells = lambda i, s: [bytes([6 + 2]) + struct.pack("<h", i + 300), b"\0" + bytes.fromhex("0D7AA600"), bytes([0x80 | len(s)]) + s, bytes([0x11]) + struct.pack("<II", i, 2)]
    path = str(tmp_path / "two.yxdb")
    bad = [b"\xff"]
    e2_file(path, fields, [[cells(0, b"a"), cells(1, b"bc")], [cells(2, b"d"), bad]], blobs=[b"0123456789"])
    assert y.detect_format(path) == "E2" and y.record_count(path) == 4
    rows = y.read_yxdb(path, spark=spark).collect()
    assert [(r.i, str(r.d), r.s, bytes(r.b)) for r in rows if r.i is not None] == [(300, "2016-09-05", "a", b"01"), (301, "2016-09-05", "bc", b"12"), (302, "2016-09-05", "d", b"23")]
    assert sum(r.i is None for r in rows) == 1  # the malformed record
    assert y.read_yxdb(path, spark=spark, mode="DROPMALFORMED").count() == 3
    with pytest.raises(Exception, match="prefix"):
        y.read_yxdb(path, spark=spark, mode="FAILFAST").collect()
    assert y.read_yxdb(path, spark=spark, n_rows=2).count() == 2
    assert y.read_yxdb(path, spark=spark, columns=["s"]).columns == ["s"]
    assert sum(t.num_rows for t in y.read_yxdb_batches(path, 3)) == 4


def test_e2_gate_and_base_five(spark, tmp_path):
    import yxspark as y

    path = str(tmp_path / "gate.yxdb")
    e2_file(path, [FieldInfo("t", "Time")], [[[bytes([0x0C + 3]) + (8_640_000 // 2).to_bytes(3, "little")]]])
    with pytest.raises(TypeError):
        y.read_yxdb(path, spark=spark)
    assert str(y.read_yxdb(path, spark=spark, allow_unverified_e2_types=True).first()[0]) == "12:00:00"
    path = str(tmp_path / "five.yxdb")
    e2_file(path, [FieldInfo("i", "Int32"), FieldInfo("s", "V_String")], [[[b"\x07\x0f\x27", b"\x81a"]]])
    assert y.read_yxdb(path, spark=spark).first().i == 9999


def test_e2_malformed(tmp_path):
    path = str(tmp_path / "bad.yxdb")
    e2_file(path, [FieldInfo("i", "Int32")], [[[b"\x07\x01"]]])
    raw = open(path, "rb").read()
    for data in (raw[:80], raw[:64] + b"\0\0\0\0" + raw[68:], raw[:96] + b"\xff\xff\xff\x7f" + raw[100:]):
        open(path, "wb").write(data)
        with pytest.raises(ValueError):
            read_header(path)
    open(path, "wb").write(raw[: raw.index(b"\2", 150)] + b"\2\xff\xff\xff\x7f")
    with pytest.raises(ValueError):
        plan(read_header(path))


# ---- geometry -------------------------------------------------------------------------------------------------------


def wkb(code, *values, order="<"):
    return struct.pack(order + "BI", order == "<", code) + b"".join(struct.pack(order + ("I" if isinstance(v, int) else "d"), v) for v in values)


SIMPLE = [
    wkb(1, 1.0, 2.0), wkb(1001, 1.0, 2.0, 3.0), wkb(2001, 1.0, 2.0, 4.0), wkb(3001, 1.0, 2.0, 3.0, 4.0),
    wkb(5, 1) + wkb(2, 2, 0.0, 0.0, 1.0, 1.0), wkb(1005, 1) + wkb(1002, 2, 0.0, 0.0, 5.0, 1.0, 1.0, 6.0),
    wkb(6, 1) + wkb(3, 1, 4, 0.0, 0.0, 4.0, 0.0, 2.0, 3.0, 0.0, 0.0), wkb(3006, 1) + wkb(3003, 1, 4, *[float(x) for x in (0, 0, 1, 2, 4, 0, 1, 2, 2, 3, 1, 2, 0, 0, 1, 2)]),
    wkb(4, 2) + wkb(1, 0.0, 0.0) + wkb(1, 1.0, 1.0), wkb(2004, 1) + wkb(2001, 0.0, 0.0, 9.0),
]


@pytest.mark.parametrize("g", SIMPLE)
def test_wkb_round_trip(g):
    assert shp_to_wkb(wkb_to_shp(g)) == g


def test_lines_polygons_and_byte_order():
    line = wkb(2, 2, 0.0, 0.0, 1.0, 1.0)
    assert shp_to_wkb(wkb_to_shp(line)) == wkb(5, 1) + line
    assert wkb_to_shp(wkb(1, 1.0, 2.0, order=">")) == wkb_to_shp(wkb(1, 1.0, 2.0))
    assert shp_to_wkb(struct.pack("<i", 0)) is None and wkb_to_shp(b"") is None and shp_to_wkb(None) is None


def test_rings():
    outer, hole = [0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0, 0.0, 0.0], [1.0, 1.0, 1.0, 2.0, 2.0, 2.0, 2.0, 1.0, 1.0, 1.0]
    shape = wkb_to_shp(wkb(3, 2, 5, *outer) + struct.pack("<I10d", 5, *hole))
    assert signed_area(np.array(outer).reshape(-1, 2)) > 0 > signed_area(np.array(hole).reshape(-1, 2))
    assert shp_to_wkb(shape)[5:9] == struct.pack("<I", 1)  # one polygon with a hole
    assert shp_to_wkb(shape, "esri")[5:9] == struct.pack("<I", 2)  # a counter-clockwise exterior is none there
    turned = wkb_to_shp(wkb(3, 2, 5, *hole) + struct.pack("<I10d", 5, *outer))
    assert shp_to_wkb(turned)[5:9] == struct.pack("<I", 2)


def test_measures():
    assert wkb_to_shp(wkb(1001, 1.0, 2.0, 3.0))[28:] == struct.pack("<d", -1e40)
    assert shp_to_wkb(struct.pack("<i3d", 11, 1.0, 2.0, 3.0)) == wkb(1001, 1.0, 2.0, 3.0)
    assert shp_to_wkb(struct.pack("<i4d", 11, 1.0, 2.0, 3.0, -1e39)) == wkb(1001, 1.0, 2.0, 3.0)


@pytest.mark.parametrize("bad", [b"\1\0", struct.pack("<i", 99), struct.pack("<id", 1, 1.0), struct.pack("<i4d2i", 3, 0, 0, 0, 0, 9, 9), struct.pack("<i4di", 8, 0, 0, 0, 0, -1)])
def test_bad_shapes(bad):
    with pytest.raises(ValueError):
        shp_to_wkb(bad)


@given(st.binary(max_size=80))
@settings(max_examples=200, deadline=None)
def test_geometry_fuzz(data):
    for f in (shp_to_wkb, wkb_to_shp):
        try:
            f(data)
        except ValueError:
            pass


def test_modes():
    assert [spatial_mode(m) for m in (None, "WKB", "Raw", "GeoArrow")] == ["wkb", "wkb", "raw", "geoarrow"]
    with pytest.raises(ValueError):
        spatial_mode("wkt")


@pytest.mark.parametrize("kind,char", [("V_String", "x"), ("V_WString", "ж"), ("V_WString", "😀"), ("Blob", None)])
def test_memory_of_long_values(tmp_path, kind, char):
    """Records of 16 MB of long values take a bounded multiple of what is encoded or decoded at a time, however many there are in a batch."""
    import tracemalloc

    f = FieldInfo("t", kind, 1 << 20)
    one = bytes(range(256)) * 16 if char is None else char * (4096 // len(char.encode()))
    values = [one] * 4000 + [None, one[:0], one[:7], one * 2000]
    at = str(tmp_path / "long.yxdb")
    batch = pa.RecordBatch.from_arrays([pa.array(values, f.arrow)], names=["t"])
    tracemalloc.start()
    write_file(at, [f], [batch])
    assert tracemalloc.get_traced_memory()[1] < 90 << 20
    tracemalloc.reset_peak()
    h = read_header(at)
    n = 0
    with open(at, "rb") as source:
        for b in read_range(source, h, h.data_start, h.data_end, h.records, None, 4 << 20):
            assert b.column(0).equals(batch.column(0).slice(n, b.num_rows))
            n += b.num_rows
    assert n == len(values) and tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()


def test_records_of_one_size_and_others():
    """Runs of records of one size, found at once, and single ones between them; cut anywhere."""
    sizes = [3] * 40 + [5, 0, 3, 9] * 90 + [7] * 1000 + [0] * 20 + [1, 2] * 5 + [7] * 9
    data = b"".join(bytes(4) + struct.pack("<I", s) + bytes([s]) * s for s in sizes)
    starts = [0, *itertools.accumulate(8 + s for s in sizes)]
    for step in (1, 7, 1000, len(data)):
        framer, found, done = Framer(4, True), [], 0
        for i in range(0, len(data), step):
            before = len(framer.rest)
            _, places = framer.feed(data[i : i + step])
            found += (places + i - before).tolist()
        assert found == starts[:-1] and not framer.rest


def test_dates_as_text():
    from yxspark.codec.texts import text_of_dates

    days = np.array([-719_528, -719_468, -1, 0, 59, 11_016, 2_932_896], dtype=np.int64)
    assert [bytes(x).decode() for x in text_of_dates(days)] == [str(v) for v in days.astype("datetime64[D]")]


def _e2_batches(path, **how):
    h = read_header(path)
    with open(path, "rb") as f:
        for s in plan(h):
            yield from e2.read_split(f, h, s, None, **how)


def test_e2_blobs_over_many_blocks(tmp_path):
    """References reach over blob blocks, which lie between record blocks; only the last block is kept."""
    path, fields = str(tmp_path / "far.yxdb"), [FieldInfo("i", "Int32"), FieldInfo("b", "Blob")]
    blobs = [bytes([k]) * 100 for k in range(5)]
    refs = [(0, 100), (90, 20), (50, 400), (499, 1), (500, 0), (250, 0), (499, 2)]
    e2_file(path, fields, [[[b"\x07" + bytes([i]), b"\x11" + struct.pack("<II", *r)] for i, r in enumerate(refs)]], blobs=blobs)
    (b,) = _e2_batches(path)
    whole = b"".join(blobs)
    assert b.column(1).to_pylist() == [whole[a : a + n] if a + n <= 500 else None for a, n in refs]


@pytest.mark.parametrize("length", [20, 3000, 100_000])
def test_e2_memory(tmp_path, length):
    """A file is made and read block by block: 24 MB of texts take a few."""
    import tracemalloc

    from yxspark.codec import e2_encode

    path, n = str(tmp_path / "big.yxdb"), min(100_000, (24 << 20) // length)
    fields = [FieldInfo("i", "Int64"), FieldInfo("t", "V_WString", 1 << 20)]
    text = lambda i: f"{i:09d}" * (length // 9)
    tracemalloc.start()
    with open(path, "wb") as out:
        for part in e2_encode.file_parts(fields, ((i, text(i)) for i in range(n))):
            out.write(part)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    done = 0
    tracemalloc.reset_peak()
    for b in _e2_batches(path):
        assert b.to_pydict() == {"i": [*range(done, done + b.num_rows)], "t": [text(i) for i in range(done, done + b.num_rows)]}
        done += b.num_rows
    assert done == n and tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    assert e2.count(read_header(path)) == n
