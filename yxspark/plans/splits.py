"""Partitions of a scan: by the record-block index where it can be trusted, by record arithmetic, by E2 block, or the whole file."""

from __future__ import annotations

import dataclasses
import struct

from pyspark.sql.datasource import InputPartition

from ..codec.files import opened
from ..codec.header import INDEXED, Header


@dataclasses.dataclass
class Split(InputPartition):
    """Bytes [start, end) of a file, with so many records (None: unknown) of which the first has this number; limit: no more rows than that."""

    path: str
    start: int
    end: int
    records: int | None
    first: int | None
    limit: int | None = None
    shape: tuple | None = None  # E2: how integers and dates are coded in this file


def block_index(f, h: Header) -> list[int] | None:
    """The index, if what it says holds: it begins at the data, ascends, has the right number of entries, and each is a block's start."""
    if not h.data_start < h.block_index or h.block_index + 4 > h.file_size:
        return None
    f.seek(h.block_index)
    (n,) = struct.unpack("<I", f.read(4))
    if n != max(1, -(-(h.records or 0) // INDEXED)) or h.block_index + 4 + 8 * n > h.file_size:
        return None
    found = list(struct.unpack(f"<{n}q", f.read(8 * n)))
    ok = found[0] == h.data_start and all(a < b for a, b in zip(found, found[1:])) and found[-1] <= h.block_index
    return found if ok and _are_block_starts(f, h, found) else None


def _are_block_starts(f, h: Header, found: list[int], probes: int = 2) -> bool:
    """Whether from each entry the block headers lead on, and those of the first stretch lead to the second entry."""
    for at in found:
        for _ in range(probes):
            if at == h.block_index:
                break
            f.seek(at)
            (mark,) = struct.unpack("<I", f.read(4))
            at += 4 + (mark & 0x7FFFFFFF)
            if at > h.block_index:
                return False
    if len(found) > 1:
        at = found[0]
        while at < found[1]:
            f.seek(at)
            at += 4 + (struct.unpack("<I", f.read(4))[0] & 0x7FFFFFFF)
        return at == found[1]
    return True


def _records_start(f, h: Header, found: list[int]) -> bool:
    """Whether each stretch begins with a record: the first blocks' records fit them."""
    from ..codec.e1_decode import blocks, looks_like_records

    if not h.variable or len(found) < 2:
        return True
    for at, end in zip(found, [*found[1:], h.block_index]):
        f.seek(at)
        first = next(blocks(f.read, at, end), b"")
        if first and not looks_like_records(first, h.fixed):
            return False
    return True


def plan(h: Header, target: int = 32 << 20) -> list[Split]:
    """Splits of about `target` bytes on disk."""
    if h.layout == "E2":
        from ..codec.e2 import plan_blocks

        return plan_blocks(h, target)
    whole = [Split(h.path, h.data_start, h.data_end, h.records, 0)]
    if not h.records:
        return whole if h.records is None else []
    if not h.compression:
        if h.variable or h.data_end - h.data_start != h.records * h.fixed:
            return whole
        step = max(1, target // h.fixed)
        return [Split(h.path, h.data_start + i * h.fixed, h.data_start + min(i + step, h.records) * h.fixed, min(step, h.records - i), i) for i in range(0, h.records, step)]
    if h.spatial_index or h.records <= INDEXED:
        return whole
    with opened(h.path) as f:
        found = block_index(f, h)
        if found is None or not _records_start(f, h, found):
            return whole
    out, k = [], 0
    bounds = [*found, h.block_index]
    while k < len(found):
        j = k + 1
        while j < len(found) and bounds[j] - bounds[k] < target:
            j += 1
        out.append(Split(h.path, bounds[k], bounds[j], min(j * INDEXED, h.records) - k * INDEXED, k * INDEXED))
        k = j
    return out


def limited(splits: list[Split], rows: int) -> list[Split]:
    """As many splits as `rows` rows need, the last with a limit."""
    out = []
    for s in splits:
        if rows <= 0:
            break
        out.append(dataclasses.replace(s, limit=rows) if s.records is None or s.records > rows else s)
        if s.records is None:
            break  # how many rows it has isn't known: reading goes on only where it is
        rows -= s.records
    return out
