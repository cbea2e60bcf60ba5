"""The 17 field types of a YXDB table and what they are in Spark and Arrow."""

from __future__ import annotations

import dataclasses

import pyarrow as pa
from pyspark.sql import types as T

# Fixed values of the format: type names as they stand in the metadata, and bytes a field takes in a record's fixed part, with its null mark.
WIDTHS = {"Bool": 1, "Byte": 2, "Int16": 3, "Int32": 5, "Int64": 9, "Float": 5, "Double": 9, "Date": 11, "Time": 9, "DateTime": 20, "V_String": 4, "V_WString": 4, "Blob": 4, "SpatialObj": 4}
SIZED = ("FixedDecimal", "String", "WString")
KINDS = (*WIDTHS, *SIZED)
VARIABLE = ("V_String", "V_WString", "Blob", "SpatialObj")
TEXT = ("String", "WString", "V_String", "V_WString")
SPARK = {
    "Bool": T.BooleanType(), "Byte": T.ShortType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(), "Float": T.FloatType(), "Double": T.DoubleType(),
    "String": T.StringType(), "WString": T.StringType(), "V_String": T.StringType(), "V_WString": T.StringType(),
    "Date": T.DateType(), "Time": T.TimeType(6), "DateTime": T.TimestampNTZType(), "Blob": T.BinaryType(), "SpatialObj": T.BinaryType(),
}
ARROW = {
    "Bool": pa.bool_(), "Byte": pa.int16(), "Int16": pa.int16(), "Int32": pa.int32(), "Int64": pa.int64(), "Float": pa.float32(), "Double": pa.float64(),
    "String": pa.string(), "WString": pa.string(), "V_String": pa.string(), "V_WString": pa.string(),
    "Date": pa.date32(), "Time": pa.time64("ns"), "DateTime": pa.timestamp("us"), "Blob": pa.binary(), "SpatialObj": pa.binary(),
}


@dataclasses.dataclass(frozen=True)
class FieldInfo:
    """Name, type, size and scale of a column of a file."""

    name: str
    type: str
    size: int = 0
    scale: int = 0

    def __repr__(self) -> str:
        rest = "".join(f", {k}={v}" for k, v in (("size", self.size), ("scale", self.scale)) if v)
        return f"FieldInfo(name={self.name!r}, type={self.type!r}{rest})"

    @property
    def width(self) -> int:
        if self.type in WIDTHS:
            return WIDTHS[self.type]
        return (2 * self.size if self.type == "WString" else self.size) + 1

    @property
    def decimal(self) -> tuple[int, int]:
        """Precision and scale of a FixedDecimal: its text also holds a sign and, with a scale, a point."""
        precision = 19 if self.size <= 1 else min(38, self.size - 1 - (self.scale > 0))
        return max(1, precision, min(38, self.scale)), min(38, self.scale)

    @property
    def spark(self) -> T.DataType:
        return T.DecimalType(*self.decimal) if self.type == "FixedDecimal" else SPARK[self.type]

    @property
    def arrow(self) -> pa.DataType:
        return pa.decimal128(*self.decimal) if self.type == "FixedDecimal" else ARROW[self.type]

    def struct_field(self) -> T.StructField:
        return T.StructField(self.name, self.spark, True, {"yxdb.type": self.type, "yxdb.size": self.size, "yxdb.scale": self.scale})


def schema_of(fields: list[FieldInfo]) -> T.StructType:
    return T.StructType([f.struct_field() for f in fields])


def field_for(column: T.StructField, spatial: tuple[str, ...] = ()) -> FieldInfo:
    """What a column is written as, before text widths are known (size 0). Metadata from a read decides where it fits the type."""
    name, kind, meta = column.name, column.dataType, column.metadata or {}
    if not name:
        raise ValueError("a column has an empty name")
    if name in spatial:
        if not isinstance(kind, T.BinaryType):
            raise ValueError(f"spatial column {name!r} is not binary")
        return FieldInfo(name, "SpatialObj")
    if (known := meta.get("yxdb.type")) in KINDS:
        f = FieldInfo(name, known, int(meta.get("yxdb.size", 0)), int(meta.get("yxdb.scale", 0)))
        if f.spark == kind:
            return f
    plain = {T.BooleanType: "Bool", T.ByteType: "Int16", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64", T.FloatType: "Float", T.DoubleType: "Double", T.DateType: "Date", T.TimestampType: "DateTime", T.TimestampNTZType: "DateTime", T.TimeType: "Time", T.BinaryType: "Blob"}
    for t, known in plain.items():
        if isinstance(kind, t):
            return FieldInfo(name, known)
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return FieldInfo(name, "V_WString")
    if isinstance(kind, T.DecimalType):
        return FieldInfo(name, "FixedDecimal", kind.precision + 1 + (kind.scale > 0), kind.scale)
    if isinstance(kind, T.NullType):
        raise TypeError(f"column {name!r} has no type (all null); cast it first")
    raise TypeError(f"column {name!r}: {kind.simpleString()} has no counterpart in a YXDB table")


def overridden(field: FieldInfo, how: dict) -> FieldInfo:
    """A field by an override {type, size, scale}."""
    if "type" not in how:
        raise ValueError(f"override of {field.name!r} lacks 'type'")
    if how["type"] not in KINDS:
        raise ValueError(f"override of {field.name!r}: unknown type {how['type']!r}; known: {', '.join(KINDS)}")
    return FieldInfo(field.name, how["type"], int(how.get("size", 0)), int(how.get("scale", 0)))
