"""Reads. What gives a DataFrame is lazy; batches and rows for the driver come straight from the file, a batch in memory at a time."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..codec import e2
from ..plans.filters import check
from ..sources.yxdb import ReadOptions, YxdbDataSource, batches_of, first_header, headers, splits_of
from ..types import FieldInfo, schema_of


def session(spark: SparkSession | None = None) -> SparkSession:
    """The session, with the data source and the SQL functions registered."""
    from ..functions import register

    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if not getattr(spark, "_yxdb_registered", False):
        spark.dataSource.register(YxdbDataSource)
        register(spark)
        spark.conf.set("spark.sql.timeType.enabled", "true")  # Time columns
        spark._yxdb_registered = True
    return spark


def _chosen(fields, columns) -> list[FieldInfo]:
    if columns is None:
        return list(fields)
    columns = list(columns)
    known = {f.name: f for f in fields}
    if odd := [c for c in columns if c not in known]:
        raise ValueError(f"unknown columns: {', '.join(map(str, odd))}; there are: {', '.join(known)}")
    if not columns:
        raise ValueError("no columns are asked for")
    if len(set(columns)) < len(columns):
        raise ValueError("a column is asked for twice")
    return [known[c] for c in columns]


def read_yxdb(path, *, columns=None, spatial: str = "wkb", n_rows: int | None = None, allow_unverified_e2_types: bool = False, filters=None, spark: SparkSession | None = None, **options) -> DataFrame:
    """A file, a directory of files, or what a pattern matches. Only the asked-for columns are decoded; n_rows stops the scan early.

    filters: (column, operator, value) triples that all have to hold, tested by the scan: it decodes their columns first, the rest for what
    passes. Operators: = != < <= > >= in, starts with, ends with, contains, is null, is not null.
    """
    path = os.fspath(path)
    spark = session(spark)
    if filters:
        options["filters"] = json.dumps([list(f) for f in filters])
        if n_rows is not None:
            options["nRows"] = n_rows
    reader = spark.read.format("yxdb").option("spatial", spatial).option("allowUnverifiedE2Types", str(allow_unverified_e2_types)).options(**options)
    ReadOptions.of({"path": path, "spatial": spatial, **options})
    first = first_header(path)  # the others are looked at by the scan
    check([(f[0], f[1].lower(), f[2] if len(f) > 2 else None) for f in filters or ()], {f.name: f.spark for f in first.fields if f.type not in ("Blob", "SpatialObj")})
    if first.layout == "E2":
        e2.check_verified(first, allow_unverified_e2_types)
    if n_rows is not None:
        if n_rows < 0:
            raise ValueError("n_rows is below zero")
        reader = reader.option("nRows", n_rows)
    if columns is not None:
        schema = schema_of(_chosen(first.fields, columns))
        if str(options.get("recordIndex", "")).lower() == "true":
            schema = schema.add("_record_index", T.LongType())
        reader = reader.schema(schema)
    return reader.load(path)


def read_yxdb_columns(path, columns, **how) -> DataFrame:
    return read_yxdb(path, columns=columns, **how)


def scan_yxdb(path, **how) -> DataFrame:
    """The same as read_yxdb: every DataFrame is lazy."""
    return read_yxdb(path, **how)


read, scan = read_yxdb, scan_yxdb


# ---- metadata ----------------------------------------------------------------------------------------------------


def detect_format(path) -> str:
    """E1 or E2."""
    from ..codec.files import opened
    from ..codec.header import layout_of

    with opened(os.fspath(path)) as f:
        return layout_of(f.read(64))


def read_yxdb_fields(path) -> list[FieldInfo]:
    return list(first_header(os.fspath(path)).fields)


def read_schema(path) -> list[dict]:
    return [{"name": f.name, "type": f.type, "size": f.size, "scale": f.scale} for f in read_yxdb_fields(path)]


def record_count(path) -> int:
    """From the headers; files of the Snappy layout have their blocks counted."""
    return sum(h.records if h.records is not None else e2.count(h) for h in headers(os.fspath(path)))


def read_spatial_info(path) -> dict:
    h = first_header(os.fspath(path))
    return {"has_spatial_index": h.spatial_index > 0, "spatial_index_pos": h.spatial_index, "file_id": h.file_id, "spatial_columns": spatial_column_names(h.fields)}


def spatial_column_names(fields) -> list[str]:
    return [f.name for f in fields if f.type == "SpatialObj"]


def fields_frame(path, spark: SparkSession | None = None) -> DataFrame:
    """The field list as a DataFrame."""
    rows = [(k, f.name, f.type, f.size, f.scale) for k, f in enumerate(read_yxdb_fields(path))]
    return session(spark).createDataFrame(rows, "position int, name string, type string, size int, scale int")


# ---- batches and rows for the driver --------------------------------------------------------------------------------


def _local(path, columns, n_rows, spatial, allow_unverified_e2_types=False) -> Iterator[pa.RecordBatch]:
    o = ReadOptions.of({"path": os.fspath(path), "spatial": spatial, "nRows": n_rows} if n_rows is not None else {"path": os.fspath(path), "spatial": spatial})
    found = headers(o.path)
    for h in found:
        if h.layout == "E2":
            e2.check_verified(h, allow_unverified_e2_types)
    wanted = [f.name for f in _chosen(found[0].fields, columns)]
    known = {h.path: h for h in found}
    left = n_rows
    for part in splits_of(found, o):
        for s in getattr(part, "splits", [part]):
            for b in batches_of(s, o, wanted, known):
                if left is not None:
                    b = b.slice(0, left)
                    left -= b.num_rows
                yield b
                if left == 0:
                    return


def read_yxdb_batches(path, batch_size: int = 65_536, *, columns=None, n_rows: int | None = None, spatial: str = "wkb") -> Iterator[pa.Table]:
    """Tables of batch_size rows, the last with what is left."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    if n_rows is not None and n_rows < 0:
        raise ValueError("n_rows is below zero")
    source = _local(path, columns, n_rows, spatial)
    _chosen(read_yxdb_fields(path), columns)  # a wrong column is told of at once

    def run():
        held, count = [], 0
        for b in source if n_rows != 0 else ():
            while b.num_rows:
                part = b.slice(0, batch_size - count)
                held.append(part)
                count += part.num_rows
                b = b.slice(part.num_rows)
                if count == batch_size:
                    yield pa.Table.from_batches(held)
                    held, count = [], 0
        if held:
            yield pa.Table.from_batches(held)

    return run()


class YxdbRowReader:
    """A cursor over rows, for the driver. next() moves to a row; a row's values are read by place or name. textual: times and decimals as text."""

    def __init__(self, path, *, spatial: str = "raw", textual: bool = False):
        self.path, self._textual = os.fspath(path), textual
        self._fields = read_yxdb_fields(self.path)
        self._names = [f.name for f in self._fields]
        self._source, self._rows, self._at = _local(self.path, None, None, spatial), None, -1
        self._open = True

    @property
    def fields(self) -> list[FieldInfo]:
        return self._fields

    @property
    def num_records(self) -> int:
        return record_count(self.path)

    def next(self) -> bool:
        if not self._open:
            raise ValueError("the reader is closed")
        self._at += 1
        while self._rows is None or self._at >= self._rows.num_rows:
            self._rows = next(self._source, None)
            self._at = 0
            if self._rows is None:
                return False
        return True

    def read_index(self, index: int):
        if self._rows is None:
            raise TypeError("no row yet; call next() first")
        if not 0 <= index < len(self._names):
            raise TypeError(f"no field {index}")
        value = self._rows.column(index)[self._at].as_py()
        if self._textual and value is not None:
            kind = self._fields[index].type
            if kind == "DateTime":
                return value.strftime("%Y-%m-%d %H:%M:%S")
            if kind in ("Date", "Time", "FixedDecimal"):
                return str(value)
        return value

    def read_name(self, name: str):
        if name not in self._names:
            raise TypeError(f"no field {name!r}")
        return self.read_index(self._names.index(name))

    def read_all(self) -> tuple:
        return tuple(self.read_index(i) for i in range(len(self._names)))

    def read_dict(self) -> dict:
        return dict(zip(self._names, self.read_all()))

    def close(self) -> None:
        self._open, self._rows = False, None
        self._source.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def __iter__(self):
        while self.next():
            yield self.read_all()


# ---- hand-over to other libraries -----------------------------------------------------------------------------------


def read_yxdb_arrow(path, **how) -> pa.Table:
    return read_yxdb(path, **how).toArrow()


def read_yxdb_pandas(path, **how):
    return read_yxdb(path, **how).toPandas()


def read_yxdb_ipc(path, **how) -> bytes:
    """An Arrow IPC stream of the whole table."""
    t = read_yxdb_arrow(path, **how)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def read_yxdb_ipc_batches(path, batch_size: int = 65_536, **how) -> Iterator[bytes]:
    for t in read_yxdb_batches(path, batch_size, **how):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        yield sink.getvalue().to_pybytes()


def geoarrow_fields(table: pa.Table, columns) -> pa.Table:
    """The table with these binary columns marked as WKB geometry, beside the metadata they have."""
    schema = table.schema
    for name in columns:
        i = schema.get_field_index(name)
        f = schema.field(i) if i >= 0 else None
        if f is not None and (pa.types.is_binary(f.type) or pa.types.is_large_binary(f.type)):
            schema = schema.set(i, f.with_metadata({**(f.metadata or {}), b"ARROW:extension:name": b"geoarrow.wkb", b"ARROW:extension:metadata": b"{}"}))
    return pa.Table.from_arrays(table.columns, schema=schema)


def read_yxdb_geoarrow(path, *, columns=None, **how) -> pa.Table:
    names = spatial_column_names(read_yxdb_fields(path))
    t = read_yxdb_arrow(path, columns=columns, spatial="geoarrow", **how)
    return geoarrow_fields(t, [n for n in names if n in t.column_names])


def read_yxdb_geo(path, *, geometry: str | None = None, columns=None, crs=None, **how):
    """A GeoDataFrame; needs geopandas."""
    try:
        import geopandas
    except ImportError:
        raise ImportError("read_yxdb_geo needs geopandas") from None
    names = spatial_column_names(read_yxdb_fields(path))
    if not names:
        raise ValueError("the file has no spatial columns")
    asked = [n for n in names if columns is None or n in columns]
    if not asked:
        raise ValueError("none of the columns asked for is spatial")
    if geometry is not None and geometry not in asked:
        raise ValueError(f"no spatial column {geometry!r}")
    frame = read_yxdb_pandas(path, columns=columns, **how)
    for n in asked:
        frame[n] = geopandas.GeoSeries.from_wkb(frame[n], crs=crs)
    return geopandas.GeoDataFrame(frame, geometry=geometry or asked[0])
