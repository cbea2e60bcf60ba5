"""Spark data source "yxdb": batch and streaming reads of both layouts, batch and streaming writes of the row-block layout.

Read options: spatial (wkb, raw, geoarrow), ringOrder (area, esri), nRows, recordIndex (adds _record_index, a record's number in its file),
allowUnverifiedE2Types, mode (PERMISSIVE, DROPMALFORMED, FAILFAST; of E2 records), splitBytes, batchBytes, filters (a JSON list of
[column, operator, value]; records that fail one aren't decoded further). A schema given by the user selects columns. Write options: typeOverrides (JSON: column -> type, size, scale), spatialColumns (JSON list or comma list), spatial (wkb, raw), blockCompression
(lzf, none), narrowEncoding (utf-8, latin-1).
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..codec import e2, files
from ..codec.e1_decode import read_range
from ..codec.e1_encode import write_file
from ..codec.header import Header, read_header
from ..functions.geometry import converted, shp_to_wkb, spatial_mode, wkb_to_shp
from ..plans import filters
from ..plans.splits import Split, limited, plan
from ..types import FieldInfo, field_for, overridden, schema_of

INDEX = "_record_index"
#: Declared size of variable text whose width isn't known.
UNKNOWN_WIDTH = 1_073_741_823


def _true(text) -> bool:
    return str(text).strip().lower() in ("true", "1", "yes")


def _names(text: str | None) -> tuple[str, ...]:
    if not text:
        return ()
    return tuple(json.loads(text)) if text.lstrip().startswith("[") else tuple(x.strip() for x in text.split(",") if x.strip())


@dataclasses.dataclass
class ReadOptions:
    path: str
    spatial: str = "wkb"
    ring_order: str = "area"
    rows: int | None = None
    record_index: bool = False
    unverified: bool = False
    mode: str = "PERMISSIVE"
    split_bytes: int = 32 << 20
    batch_bytes: int = 8 << 20
    filters: list = dataclasses.field(default_factory=list)

    @classmethod
    def of(cls, options: dict) -> "ReadOptions":
        o = {k.lower(): v for k, v in options.items()}
        if not o.get("path"):
            raise ValueError("a path is needed")
        rows = o.get("nrows")
        if rows is not None and int(rows) < 0:
            raise ValueError("nRows is below zero")
        mode = o.get("mode", "PERMISSIVE").upper()
        if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
            raise ValueError(f"unknown mode {mode!r}")
        order = o.get("ringorder", "area").lower()
        if order not in ("area", "esri"):
            raise ValueError(f"unknown ringOrder {order!r}")
        found = filters.parse(o.get("filters"))
        if found and (rows is not None or _true(o.get("recordindex", False))):
            raise ValueError("filters don't go with nRows or recordIndex, which count the records of a file")
        return cls(o["path"], spatial_mode(o.get("spatial")), order, None if rows is None else int(rows), _true(o.get("recordindex", False)), _true(o.get("allowunverifiede2types", False)), mode, int(o.get("splitbytes", 32 << 20)), int(o.get("batchbytes", 8 << 20)), found)


@dataclasses.dataclass
class Chain(InputPartition):
    """Splits read one after the other, up to so many rows: for files that don't tell how many they have."""

    splits: list
    limit: int


def _listed(path: str) -> list[tuple[str, int]]:
    found = files.listed(path)
    if not found:
        raise FileNotFoundError(f"no .yxdb files below {path}")
    return found


def _alike(h: Header, first: Header) -> Header:
    if [(f.name, f.spark) for f in h.fields] != [(f.name, f.spark) for f in first.fields]:
        raise ValueError(f"{h.path} has other columns than {first.path}")
    return h


def first_header(path: str) -> Header:
    return read_header(_listed(path)[0][0])


def headers(path: str) -> list[Header]:
    """Of all files: many at a time, as each is a round trip to the store."""
    with ThreadPoolExecutor(32) as pool:
        found = list(pool.map(lambda x: read_header(x[0]), _listed(path)))
    return [found[0], *(_alike(h, found[0]) for h in found[1:])]


@dataclasses.dataclass
class WholeFile(InputPartition):
    """A file that its task opens and checks itself."""

    path: str


def splits_of(found: list[Header], o: ReadOptions) -> list[InputPartition]:
    with ThreadPoolExecutor(32) as pool:
        out = [s for some in pool.map(lambda h: plan(h, o.split_bytes), found) for s in some]
    if o.rows is None:
        return out
    if any(s.records is None for s in out):
        return [Chain(out, o.rows)]
    return limited(out, o.rows)


def batches_of(split: Split, o: ReadOptions, wanted: list[str], headers_: dict[str, Header], tests: tuple = ()) -> Iterator[pa.RecordBatch]:
    """Decoded batches of a split with the wanted columns, geometry converted, cut at its limit. tests: what records have to pass (then there is neither limit nor record index)."""
    h = headers_.get(split.path) or headers_.setdefault(split.path, read_header(split.path))
    columns = [n for n in wanted if n != INDEX]
    read = columns or [h.fields[0].name]  # of no columns, the rows still count
    spatial = {f.name for f in h.fields if f.type == "SpatialObj"} if o.spatial != "raw" else set()
    done = 0
    with files.opened(split.path) as f:
        if h.layout == "E1":
            source = read_range(f, h, split.start, split.end, split.records, read, o.batch_bytes, tests)
        else:
            source = e2.read_split(f, h, split, list(dict.fromkeys([*read, *(n for n, _ in tests)])), o.mode)
            if tests:
                source = (_passing(b, tests).select(read) for b in source)
        for b in source:
            if split.limit is not None:
                b = b.slice(0, split.limit - done)
            arrays = {n: converted(c, lambda v: shp_to_wkb(v, o.ring_order)) if n in spatial else c for n, c in zip(b.schema.names, b.columns)}
            if INDEX in wanted:
                import numpy as np

                arrays[INDEX] = pa.array(np.arange(b.num_rows) + (split.first or 0) + done)
            done += b.num_rows
            yield pa.RecordBatch.from_arrays([arrays[n] for n in wanted], names=wanted) if wanted else b.select([])
            if split.limit is not None and done >= split.limit:
                return


def _passing(b: pa.RecordBatch, tests: tuple) -> pa.RecordBatch:
    for name, passes in tests:
        b = b.filter(pa.array(passes(b.column(name))))
    return b


class YxdbReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.wanted = ReadOptions.of(options), schema.names
        self.kinds = {f.name: f.dataType for f in schema.fields}

    def _checked(self, h: Header) -> Header:
        known = {f.name: f.spark for f in h.fields} | {INDEX: T.LongType()}
        if odd := [n for n in self.wanted if n not in known]:
            raise ValueError(f"unknown columns: {', '.join(odd)}")
        if odd := [n for n in self.wanted if known[n] != self.kinds[n]]:
            raise ValueError(f"columns of another type than asked for: {', '.join(f'{n} is {known[n].simpleString()}' for n in odd)}")
        filters.check(self.options.filters, {f.name: f.spark for f in h.fields if f.type not in ("Blob", "SpatialObj")})
        if h.layout == "E2":
            e2.check_verified(h, self.options.unverified)
        return h

    def partitions(self):
        found = _listed(self.options.path)
        if self.options.rows is not None:
            return splits_of([self._checked(h) for h in headers(self.options.path)], self.options)
        # files of one split are left to their tasks; the driver opens the first and those that may be split
        first = self._checked(read_header(found[0][0]))
        large = [p for p, size in found if size > self.options.split_bytes]
        with ThreadPoolExecutor(32) as pool:
            opened = [self._checked(_alike(h, first)) for h in pool.map(read_header, large)]
        return [*splits_of(opened, self.options), *(WholeFile(p) for p, size in found if size <= self.options.split_bytes)]

    def read(self, partition):
        if partition is None:
            return
        cache: dict[str, Header] = {}
        tests = tuple(map(filters.test, self.options.filters))
        if isinstance(partition, WholeFile):
            h = cache[partition.path] = self._checked(read_header(partition.path))
            for s in plan(h, 1 << 62):
                yield from batches_of(s, self.options, self.wanted, cache, tests)
            return
        if isinstance(partition, Chain):
            left = partition.limit
            for s in partition.splits:
                if left <= 0:
                    return
                for b in batches_of(dataclasses.replace(s, limit=left), self.options, self.wanted, cache):
                    left -= b.num_rows
                    yield b
            return
        yield from batches_of(partition, self.options, self.wanted, cache, tests)


@dataclasses.dataclass
class Written(WriterCommitMessage):
    path: str | None
    records: int


class _Writer:
    """Each task writes hidden files; the commit puts them in place by one journal file, so readers see all of a write or nothing."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        o = {k.lower(): v for k, v in options.items()}
        if not o.get("path"):
            raise ValueError("a path is needed")
        self.path, self.overwrite, self.job = o["path"].rstrip("/"), overwrite, uuid.uuid4().hex[:12]
        spatial = _names(o.get("spatialcolumns"))
        how = json.loads(o.get("typeoverrides") or "{}")
        if odd := [n for n in (*spatial, *how) if n not in schema.names]:
            raise ValueError(f"unknown columns: {', '.join(odd)}")
        if len(set(schema.names)) < len(schema.names):
            raise ValueError("columns share a name")
        if not schema.fields:
            raise ValueError("a table without columns can't be written")
        found = [field_for(c, spatial) for c in schema.fields]
        found = [overridden(f, how[f.name]) if f.name in how else f for f in found]
        self.fields = [dataclasses.replace(f, size=UNKNOWN_WIDTH) if f.type in ("V_String", "V_WString") and not f.size else f for f in found]
        if odd := [f.name for f in self.fields if f.type in ("String", "WString", "FixedDecimal") and f.size < 1]:
            raise ValueError(f"a size is needed for: {', '.join(odd)}")
        self.convert = [f.name for f in self.fields if f.type == "SpatialObj"] if spatial_mode(o.get("spatial")) != "raw" else []
        compression = o.get("blockcompression", "lzf").lower()
        if compression not in ("lzf", "none"):
            raise ValueError(f"unknown blockCompression {compression!r}")
        self.compress, self.narrow = compression == "lzf", o.get("narrowencoding", "utf-8").lower()
        if self.narrow not in ("utf-8", "latin-1"):
            raise ValueError(f"unknown narrowEncoding {self.narrow!r}")

    def _prepared(self, b: pa.RecordBatch) -> pa.RecordBatch:
        if not self.convert:
            return b
        return pa.RecordBatch.from_arrays([converted(c, wkb_to_shp) if n in self.convert else c for n, c in zip(b.schema.names, b.columns)], names=b.schema.names)

    def write(self, iterator):
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return Written(None, 0)  # a task without rows leaves no file

        def all_():
            yield self._prepared(first)
            for b in iterator:
                yield self._prepared(b)

        path = f"{self.path}/_{self.job}-{uuid.uuid4().hex}.tmp"
        try:
            return Written(path, write_file(path, self.fields, all_(), self.compress, self.narrow))
        except BaseException:
            files.delete(path)
            raise

    def _named(self, messages, label: str, old: list[str] = ()) -> None:
        """The task's files take the place of the old ones, all at once."""
        done = [m.path for m in messages if m is not None and m.path]
        if not done:
            path = f"{self.path}/_{self.job}-empty.tmp"
            write_file(path, self.fields, [])
            done = [path]
        files.commit(self.path, list(old), [(p, f"{self.path}/part-{label}-{k:05d}.yxdb") for k, p in enumerate(done)])

    def _dropped(self, messages) -> None:
        for m in messages:
            if m is not None and m.path:
                files.delete(m.path)


class YxdbWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        old = [p for p, _ in files.listed(self.path)] if self.overwrite and files.exists(self.path) else []
        self._named(messages, self.job, old)
        with files.created(f"{self.path}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        self._dropped(messages)


class YxdbStreamWriter(_Writer, DataSourceStreamArrowWriter):
    """Files carry their epoch's number; an epoch that is committed again replaces its files."""

    def commit(self, messages, batchId: int) -> None:
        label = f"epoch{batchId:010d}"
        old = [p for p, _ in files.listed(self.path) if f"/part-{label}-" in p] if files.exists(self.path) else []
        # names of its own for each attempt, so that old and new files never share one
        self._named(messages, f"{label}-{self.job}-{uuid.uuid4().hex[:6]}", old)

    def abort(self, messages, batchId: int) -> None:
        self._dropped(messages)


class YxdbStreamReader(DataSourceStreamReader):
    """New files below a directory, in the order they came. An offset is the last file's (time, name)."""

    def __init__(self, options: dict, schema: T.StructType):
        self.batch = YxdbReader(options, schema)

    def _found(self) -> list[tuple[int, str]]:
        from pyarrow import fs  # noqa: F401

        out = []
        for p, _ in files.listed(self.batch.options.path):
            f, q = files._fs(p)
            out.append((f.get_file_info(q).mtime_ns or 0, p))
        return sorted(out)

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        found = self._found()
        return {"time": found[-1][0], "name": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        lo, hi = (start["time"], start["name"]), (end["time"], end["name"])
        return [s for key in self._found() if lo < key <= hi for s in plan(read_header(key[1]), self.batch.options.split_bytes)]

    def read(self, partition):
        yield from self.batch.read(partition)

    def commit(self, end: dict) -> None:
        pass


class YxdbDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "yxdb"

    def schema(self) -> T.StructType:
        o = ReadOptions.of(self.options)
        out = schema_of(list(first_header(o.path).fields))
        return out.add(INDEX, T.LongType()) if o.record_index else out

    def reader(self, schema: T.StructType) -> YxdbReader:
        return YxdbReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> YxdbWriter:
        return YxdbWriter(dict(self.options), schema, overwrite)

    def streamReader(self, schema: T.StructType) -> YxdbStreamReader:
        return YxdbStreamReader(dict(self.options), schema)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> YxdbStreamWriter:
        return YxdbStreamWriter(dict(self.options), schema, overwrite)
