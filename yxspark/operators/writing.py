"""Writes. A DataFrame becomes a directory of files, one a task, or with single_file one file."""

from __future__ import annotations

import dataclasses
import itertools
import json
import os
import uuid
import warnings
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codec import files
from ..codec.e1_encode import copy_pieces, index_block, pieces, write_segment
from ..codec.header import build_header, read_header
from ..functions.geometry import converted, wkb_to_shp
from ..sources.yxdb import YxdbWriter as SparkWriter
from ..types import FieldInfo, field_for, overridden
from .reading import session


def text_widths(df: DataFrame, columns: list[str]) -> dict[str, tuple[bool, int, int]]:
    """For each text column, from one aggregate: whether a character lies beyond U+00FF, most UTF-8 bytes, most UTF-16 units."""
    if not columns:
        return {}
    found = []
    for i, name in enumerate(columns):
        c = F.col(f"`{name.replace('`', '``')}`")
        plain = (F.octet_length(c) == F.length(c)) & F.is_valid_utf8(c)  # only ASCII: no need to look at each character
        wide = F.when(plain, F.lit(False)).otherwise(c.rlike("[^\\u0000-\\u00FF]"))
        units = F.when(plain, F.length(c)).otherwise((F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int"))
        found += [F.max(wide).alias(f"w{i}"), F.max(F.octet_length(c)).alias(f"b{i}"), F.max(units).alias(f"u{i}")]
    one = df.agg(*found).first()
    return {c: (bool(one[f"w{i}"]), int(one[f"b{i}"] or 0), int(one[f"u{i}"] or 0)) for i, c in enumerate(columns)}


def string_profile(df: DataFrame) -> DataFrame:
    """One row a text column: what the writer would choose for it."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    rows = [(c, wide, b, u) for c, (wide, b, u) in text_widths(df, columns).items()]
    return df.sparkSession.createDataFrame(rows, "name string, wide boolean, max_bytes int, max_units int")


def planned_fields(df: DataFrame, spatial: tuple[str, ...] = (), overrides: dict | None = None, infer: bool = True) -> list[FieldInfo]:
    """What each column is written as. Text columns without a known type are V_String where all characters are below U+0100, else V_WString, as wide as their widest value."""
    overrides = overrides or {}
    if odd := [n for n in (*spatial, *overrides) if n not in df.columns]:
        raise ValueError(f"unknown columns: {', '.join(odd)}")
    found = [field_for(c, spatial) for c in df.schema.fields]
    found = [overridden(f, overrides[f.name]) if f.name in overrides else f for f in found]
    open_ = [f.name for f, c in zip(found, df.schema.fields) if f.type in ("V_String", "V_WString", "String", "WString") and not f.size]
    widths = text_widths(df, open_) if infer else {}

    def sized(f: FieldInfo) -> FieldInfo:
        if f.name not in widths:
            return f
        wide, b, u = widths[f.name]
        kind = f.type if f.name in overrides or f.type in ("String", "WString") else "V_WString" if wide else "V_String"
        return dataclasses.replace(f, type=kind, size=max(1, u if kind in ("V_WString", "WString") else b))

    return [sized(f) for f in found]


def prepared(df: DataFrame, fields: list[FieldInfo]) -> DataFrame:
    """df with columns of the types that the fields stand for, and the fields in the columns' metadata."""
    out = []
    for f, c in zip(fields, df.schema.fields):
        column = F.col(f"`{c.name.replace('`', '``')}`")
        if isinstance(c.dataType, T.TimestampType):
            warnings.warn(f"column {c.name!r} is written as UTC without a time zone", stacklevel=3)
            column = F.to_utc_timestamp(column, F.current_timezone()).cast("timestamp_ntz") if f.type == "DateTime" else column
        if f.type == "FixedDecimal" and not isinstance(c.dataType, T.DecimalType) or c.dataType != f.spark:
            column = column.cast(f.spark)
        out.append(column.alias(c.name, metadata={"yxdb.type": f.type, "yxdb.size": f.size, "yxdb.scale": f.scale}))
    return df.select(*out)


def write_yxdb(df: DataFrame, path, *, spatial_columns=None, type_overrides: dict | None = None, mode: str = "overwrite", single_file: bool = False, infer_string_types: bool = True, fields: list[FieldInfo] | None = None, tasks: int | None = None, **options) -> list[FieldInfo]:
    """Writes df and returns what its columns became. mode: overwrite, append, error, ignore. fields: the whole field list, one a column by name, instead of what would be chosen.
    tasks: deal the rows anew to so many, by their places; df has to give the same rows in the same order when a task of it runs again, as scans of files do."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"a Spark DataFrame is needed, not {type(df).__name__}")
    path = os.fspath(path)
    session(df.sparkSession)
    if mode not in ("overwrite", "append", "error", "errorifexists", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    if files.exists(path) and mode not in ("overwrite", "append"):
        if mode == "ignore":
            return []
        raise FileExistsError(f"{path} exists")
    spatial = (spatial_columns,) if isinstance(spatial_columns, str) else tuple(spatial_columns or ())
    if fields is None:
        fields = planned_fields(df, spatial, type_overrides, infer_string_types)
    elif sorted(f.name for f in fields) != sorted(df.columns) or spatial or type_overrides:
        raise ValueError("a field list names each column once and leaves nothing to override")
    else:
        df = df.select(*(F.col(f"`{f.name.replace('`', '``')}`") for f in fields))
    whole = prepared(df, fields)
    whole = whole.repartition(tasks, F.monotonically_increasing_id()) if tasks else whole
    if mode == "overwrite" and any(os.path.abspath(p.removeprefix("file:")).startswith(os.path.abspath(path)) for p in _inputs(df)):
        raise ValueError(f"{path} is read by what is to be written over it")
    if single_file:
        _write_one(whole, path, options)
    else:
        whole.write.format("yxdb").options(**options).mode("append" if mode == "append" else "overwrite").save(path)
    return fields


def _by_task(spark: SparkSession, n: int, run, schema: str) -> list:
    """Rows (k, ...) that run(k) gives for each k below n, every k in a task of its own; in the order of k."""

    def all_(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                row = run(k)
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("k", pa.int64()), ("size", pa.int64()), ("entries", pa.list_(pa.int64()))]))

    return sorted(spark.range(0, n, 1, n).mapInArrow(all_, schema).collect()) if n else []


def _write_one(whole: DataFrame, path: str, options: dict) -> None:
    """df as one file, its rows in the order of its partitions. Tasks write segments; when all are counted, each task parts its segment where entries of the
    record-block index belong and tells its size, then puts it at its place. Stores whose files can't be written at a place get the segments one after the other."""
    spark, at = whole.sparkSession, f"{os.path.dirname(path) or '.'}/.{os.path.basename(path)}-{uuid.uuid4().hex[:8]}"
    w = SparkWriter({"path": at, **{k: str(v) for k, v in options.items()}}, whole.schema, True)
    f, folder = files._fs(at)
    target = f"{folder}/whole.yxdb"

    def segment(batches):
        from pyspark import TaskContext

        to = f"{at}/{uuid.uuid4().hex}.segment"
        n = write_segment(to, w.fields, map(w._prepared, batches), w.compress, w.narrow)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([to]), pa.array([n])], names=["k", "path", "n"])

    try:
        done = [(r.path, r.n) for r in sorted(whole.mapInArrow(segment, "k long, path string, n long").collect()) if r.n]
        firsts = list(itertools.accumulate((n for _, n in done), initial=0))
        parts = [(p, first) for (p, _), first in zip(done, firsts)]

        def sized(k: int) -> dict:
            size, entries = 0, []
            with files.opened(parts[k][0]) as source:
                for begins, piece in pieces(source, w.fields, parts[k][1], w.compress):
                    entries += [size] * begins
                    size += piece[1] if isinstance(piece, tuple) else len(piece)
            return {"k": k, "size": size, "entries": entries}

        found = _by_task(spark, len(parts), sized, "k long, size long, entries array<long>")
        start = len(build_header(w.fields, 0, 0))
        begins = list(itertools.accumulate((r.size for r in found), initial=start))
        index = index_block([b + e for b, r in zip(begins, found) for e in r.entries] or [start])
        head = build_header(w.fields, firsts[-1], begins[-1])

        def placed(k: int) -> dict:
            with files.opened(parts[k][0]) as source, open(target, "r+b") as out:
                out.seek(begins[k])
                copy_pieces(source, w.fields, parts[k][1], w.compress, out.write)
            return {"k": k, "size": None, "entries": None}

        f.create_dir(folder, recursive=True)
        if _sparse(f, target, begins[-1], head, index):
            _by_task(spark, len(parts), placed, "k long, size long, entries array<long>")
        else:
            with f.open_output_stream(target) as out:
                out.write(head)
                for p, first in parts:
                    with files.opened(p) as source:
                        copy_pieces(source, w.fields, first, w.compress, out.write)
                out.write(index)
        files.delete(path)
        f.move(target, files._fs(path)[1])
    finally:
        if files.exists(at):
            f.delete_dir(folder)


def _sparse(f, target: str, index_at: int, head: bytes, index: bytes) -> bool:
    """Makes a file with this start and end, if files of this store can be written at a place."""
    if not isinstance(f, fs.LocalFileSystem):
        return False
    try:
        with open(target, "wb") as out:
            out.truncate(index_at)
            out.write(head)
            out.seek(index_at)
            out.write(index)
        return True
    except OSError:
        return False


def _inputs(df: DataFrame) -> list[str]:
    try:
        return list(df.inputFiles())
    except Exception:  # sources without files
        return []


write = write_yxdb


def write_yxdb_with_overrides(df: DataFrame, path, type_overrides: dict, **how) -> list[FieldInfo]:
    return write_yxdb(df, path, type_overrides=type_overrides, **how)


def write_yxdb_with_schema(df: DataFrame, path, fields: list[FieldInfo], **how) -> list[FieldInfo]:
    return write_yxdb(df, path, fields=fields, **how)


def sink_yxdb(df: DataFrame, path, **how) -> list[FieldInfo]:
    """The same as write_yxdb: what df describes is computed by the write."""
    return write_yxdb(df, path, **how)


sink = sink_yxdb


def write_yxdb_arrow(table: pa.Table, path, *, spark: SparkSession | None = None, **how) -> list[FieldInfo]:
    return write_yxdb(session(spark).createDataFrame(table), path, **how)


def write_yxdb_pandas(frame, path, *, spark: SparkSession | None = None, **how) -> list[FieldInfo]:
    return write_yxdb(session(spark).createDataFrame(frame), path, **how)


def write_yxdb_ipc(data: bytes, path, **how) -> list[FieldInfo]:
    return write_yxdb_arrow(pa.ipc.open_stream(data).read_all(), path, **how)


def write_yxdb_ipc_batches(path, streams: Iterable[bytes], **how) -> int:
    """One file from an iterable of Arrow IPC streams, one in memory at a time; returns the number of records."""
    return write_yxdb_batches(path, (pa.ipc.open_stream(s).read_all() for s in streams), **how)


def write_yxdb_geo(frame, path, *, spatial_columns=None, **how) -> list[FieldInfo]:
    """A GeoDataFrame; its geometry columns become SpatialObj."""
    try:
        import geopandas
    except ImportError:
        raise ImportError("write_yxdb_geo needs geopandas") from None
    names = list(spatial_columns or [c for c in frame.columns if isinstance(frame[c], geopandas.GeoSeries)])
    if not names:
        raise ValueError("the frame has no geometry columns")
    frame = frame.copy()
    for n in names:
        frame[n] = frame[n].to_wkb()
    return write_yxdb_pandas(frame, path, spatial_columns=names, **how)


def arrow_fields(schema: pa.Schema, spatial: tuple[str, ...] = (), overrides: dict | None = None) -> list[FieldInfo]:
    from pyspark.sql.pandas.types import from_arrow_schema

    found = [field_for(c, spatial) for c in from_arrow_schema(schema, prefer_timestamp_ntz=True).fields]
    found = [overridden(f, (overrides or {})[f.name]) if f.name in (overrides or {}) else f for f in found]
    return [dataclasses.replace(f, size=1_073_741_823) if f.type in ("V_String", "V_WString") and not f.size else f for f in found]


class YxdbWriter:
    """One file from batches, on the driver. All batches must have the first one's columns. Used in a with block, it finishes at its end and leaves no file after an error."""

    def __init__(self, path, *, spatial_columns=None, type_overrides: dict | None = None, compress: bool = True):
        self.path, self._spatial, self._overrides, self._compress = os.fspath(path), tuple(spatial_columns or ()), type_overrides, compress
        self._held: list[pa.RecordBatch] = []
        self._fields = self._schema = self._out = self._spool = None
        self.count = 0

    def write(self, batch) -> None:
        import tempfile

        from ..codec.e1_encode import FileWriter

        table = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else pa.Table.from_pandas(batch, preserve_index=False)
        if self._schema is None:
            self._schema = table.schema
            self._fields = arrow_fields(table.schema, self._spatial, self._overrides)
            self._spool = tempfile.TemporaryFile()
            self._out = FileWriter(self._spool, self._fields, self._compress)
        elif table.schema.names != self._schema.names:
            raise ValueError("a batch has other columns than the first")
        table = table.cast(self._schema)
        for b in table.to_batches():
            if b.num_rows:
                b = pa.RecordBatch.from_arrays([converted(c, wkb_to_shp) if n in self._spatial else c for n, c in zip(b.schema.names, b.columns)], names=b.schema.names)
                self._out.write(b)
                self.count += b.num_rows

    def finish(self) -> int:
        import shutil

        if self._out is None:
            raise ValueError("no batch was written")
        if self._spool is not None:
            head, count = self._out.finish()
            self._spool.seek(0)
            with files.created(self.path) as out:
                out.write(head)
                shutil.copyfileobj(self._spool, out, 1 << 20)
            self._spool.close()
            self._spool = None
        return self.count

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if kind is None:
            self.finish()
        elif self._spool is not None:
            self._spool.close()
            self._spool = None


def write_yxdb_batches(path, batches: Iterable, **how) -> int:
    """One file from an iterable of tables or batches; returns the number of records."""
    w = YxdbWriter(path, **how)
    for b in batches:
        w.write(b)
    return w.finish()


def header_of(path):
    return read_header(os.fspath(path))


def options_json(overrides: dict) -> str:
    """typeOverrides for df.write.format("yxdb")."""
    return json.dumps(overrides)
