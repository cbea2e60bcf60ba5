"""Filters that a scan applies itself: comparisons of a column with literals, all of which have to hold, as in Spark (a null never passes a comparison).

They are options of the read and not pushed by the optimizer: what a Python source is told by ``pushFilters`` belongs, in Spark 4.1, to all scans of
one DataFrame, so that a query without a filter gets the rows of the query before it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

COMPARED = {"=": pc.equal, "==": pc.equal, "!=": pc.not_equal, "<": pc.less, "<=": pc.less_equal, ">": pc.greater, ">=": pc.greater_equal}
TEXTUAL = {"starts with": pc.starts_with, "ends with": pc.ends_with, "contains": pc.match_substring}
PRESENT = {"is null": pc.is_null, "is not null": pc.is_valid}
BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def parse(text: str | None) -> list[tuple]:
    """(column, operator, value) of each filter, from a JSON list of lists."""
    return [(f[0], f[1].lower(), f[2] if len(f) > 2 else None) for f in json.loads(text or "[]")]


def _fits(value, kind: T.DataType) -> bool:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and not math.isnan(value)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if type(kind) in BITS:
        return isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << BITS[type(kind)] - 1
    return isinstance(kind, T.StringType) and isinstance(value, str)


def check(found: list[tuple], kinds: dict[str, T.DataType]) -> None:
    for name, op, value in found:
        if name not in kinds:
            raise ValueError(f"filter on an unknown column: {name}")
        if op in PRESENT:
            continue
        if op in TEXTUAL and not isinstance(kinds[name], T.StringType) or op not in TEXTUAL and op not in COMPARED and op != "in":
            raise ValueError(f"no filter {op!r} on {name} ({kinds[name].simpleString()})")
        if not all(_fits(v, kinds[name]) for v in (value if op == "in" else [value])):
            raise ValueError(f"filter on {name} ({kinds[name].simpleString()}): {value!r} is no value of that type")


def _values(column: pa.Array, op: str, value):
    """True, false or null for each value."""
    if op in PRESENT:
        return PRESENT[op](column)
    if op == "in":
        return pc.if_else(pc.is_valid(column), pc.is_in(column, value_set=pa.array(value, column.type)), None)
    if op in TEXTUAL:
        return TEXTUAL[op](column, value)
    if pa.types.is_float32(column.type):
        column = column.cast(pa.float64())  # Spark compares a float with a literal so
    found = COMPARED[op](column, pa.scalar(value, column.type))
    # Spark has NaN above all numbers
    return pc.or_(found, pc.is_nan(column)) if pa.types.is_floating(column.type) and op in (">", ">=") else found


def test(f: tuple) -> tuple[str, Callable[[pa.Array], np.ndarray]]:
    """The column and the function from its array to a mask."""
    name, op, value = f
    return name, lambda column: np.asarray(pc.fill_null(_values(column, op, value), False).to_numpy(zero_copy_only=False), dtype=bool)
