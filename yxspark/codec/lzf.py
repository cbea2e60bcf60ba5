"""LZF blocks. A control byte below 32 starts a run of that many + 1 literals; others a copy of earlier output.

Snappy's elements say the same things as LZF's: runs of literals, and copies from some distance back. So a block is rewritten from one into the other by
array operations over its elements, and the bytes themselves are moved by Arrow's compiled Snappy codec. Only the walk from element to
element is a loop, and that goes sixteen elements at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FAR, LONGEST, LITERALS = 8192, 264, 32
MOST = 1 << 29
#: Bytes that an LZF element takes, by its control byte.
_LZF_STEP = np.array([c + 2 if c < 32 else 3 if c >= 224 else 2 for c in range(256)], dtype=np.int32)
#: The same of Snappy's; 0 where the length of a run of literals follows in bytes of its own.
_SNAPPY_STEP = np.array([(c >> 2) + 2 if c & 3 == 0 and c >> 2 < 60 else (0, 2, 3, 5)[c & 3] for c in range(256)], dtype=np.int32)
#: Bytes of output of a Snappy element, where its control byte tells them.
_SNAPPY_LENGTH = np.array([(c >> 2 & 7) + 4 if c & 3 == 1 else (c >> 2) + 1 for c in range(256)], dtype=np.int64)
#: The longest copy of one Snappy element.
_PART = 64


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of counts (2, 3): owners (0, 0, 1, 1, 1) and places (0, 1, 0, 1, 2)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def _walk(step: np.ndarray, start: int) -> tuple[np.ndarray, bool]:
    """Places of the elements from start on, where step holds the size of an element that would begin at each place; and whether the last ends at the end."""
    n = len(step)
    far = np.empty(n + 2, dtype=np.int32)
    np.minimum(np.arange(n, dtype=np.int32) + step, n + 1, out=far[:n])
    far[n:] = n, n + 1  # the end, and what lies beyond it
    one = far
    for _ in range(4):
        far = far[far]
    i, every = start, []
    while i < n:
        every.append(i)
        i = int(far[i])
    places = np.empty((len(every), 16), dtype=np.int32)
    at = np.array(every, dtype=np.int32)
    for k in range(16):
        places[:, k] = at
        at = one[at]
    places = places.ravel()
    return places[places < n].astype(np.int64), i == n


def decompress(data: bytes, limit: int = MOST) -> bytes:
    """The plain bytes; ValueError on anything that isn't a whole stream."""
    if not len(data):
        return b""
    raw = np.frombuffer(data, dtype=np.uint8)
    at, whole = _walk(_LZF_STEP[raw], 0)
    if not whole:
        raise ValueError("LZF: the stream ends within " + ("literals" if raw[at[-1]] < 32 else "a copy"))
    c = raw[at].astype(np.int64)
    copy, length = np.flatnonzero(c >= 32), c + 1
    d, where = c[copy], at[copy]
    long_ = np.flatnonzero(d >= 224)
    one = raw[where + 1].astype(np.int64)
    low, n = one.copy(), (d >> 5) + 2
    n[long_] += one[long_]
    low[long_] = raw[where[long_] + 2]
    length[copy] = n
    back = ((d & 31) << 8 | low) + 1
    stop = np.cumsum(length)
    if int(stop[-1]) > limit:
        raise ValueError("LZF: more output than a block may hold")
    if (back > (stop - length)[copy]).any():
        raise ValueError("LZF: a copy from before the start")
    size, tag, n1 = length + 1, c << 2, n - 1
    size[copy], tag[copy] = 3, n1 << 2 | 2
    more = np.flatnonzero(n > _PART)
    parts = -(-n[more] // _PART)
    size[copy[more]] = 3 * parts
    head = _varint(int(stop[-1]))
    to = np.cumsum(size) - size + len(head)
    out = np.empty(len(head) + int(size.sum()), dtype=np.uint8)
    out[: len(head)] = np.frombuffer(head, dtype=np.uint8)
    # literals are what is left of the source beside its elements' heads, and of the output beside its own
    given, taken = np.ones(len(raw), dtype=bool), np.ones(len(out), dtype=bool)
    given[at], given[where + 1], given[where[long_] + 2] = False, False, False
    p = to[copy]
    taken[: len(head)], taken[to], taken[p + 1], taken[p + 2] = False, False, False, False
    out[to], out[p + 1], out[p + 2] = tag, back & 255, back >> 8
    if len(more):
        owner, k = _spread(parts)
        p, back = to[copy[more]][owner] + 3 * k, back[more][owner]
        out[p] = np.minimum(n[more][owner] - k * _PART, _PART) - 1 << 2 | 2
        out[p + 1], out[p + 2] = back & 255, back >> 8
        taken[p], taken[p + 1], taken[p + 2] = False, False, False
    out[taken] = raw[given]
    return pa.decompress(pa.py_buffer(out), decompressed_size=int(stop[-1]), codec="snappy", asbytes=True)


def _copies(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of the copies that Snappy finds, as far as LZF can say them; pieces of one copy together."""
    packed = pa.compress(data, codec="snappy", asbytes=True)
    raw = np.frombuffer(packed + bytes(4), dtype=np.uint8)
    step = _SNAPPY_STEP[raw[: len(packed)]]
    far = np.flatnonzero(step == 0)  # a length of literals follows, in up to four bytes
    extra = (raw[far] >> 2).astype(np.int64) - 59
    sizes = sum(np.where(extra > k, raw[far + 1 + k].astype(np.int64), 0) << 8 * k for k in range(4)) + 1
    step[far] = np.minimum(1 + extra + sizes, len(packed))
    at, _ = _walk(step, next(k for k, b in enumerate(packed) if b < 128) + 1)
    tag = raw[at]
    length = _SNAPPY_LENGTH[tag]
    far = np.flatnonzero((tag & 3 == 0) & (tag >= 240))
    length[far] = step[at[far]] - (tag[far] >> 2).astype(np.int64) + 58
    start = np.cumsum(length) - length
    ok = np.flatnonzero((tag & 3) % 3)  # Snappy's blocks are too short for copies of the fourth kind
    start, length, at, c = start[ok], length[ok], at[ok] + 1, tag[ok].astype(np.int64)
    one, two = raw[at].astype(np.int64), raw[at + 1].astype(np.int64)
    back = np.where(c & 3 == 1, (c >> 5) << 8 | one, one | two << 8)
    if len(start):
        fresh = np.append(True, (start[1:] != start[:-1] + length[:-1]) | (back[1:] != back[:-1]))
        first = np.flatnonzero(fresh)
        start, length, back = start[first], np.add.reduceat(length, first), back[first]
        near = (back <= FAR) & (length >= 3)
        start, length, back = start[near], length[near], back[near]
    return start, length, back


def compress(data: bytes) -> bytes | None:
    """A shorter stream, or None where there's none."""
    data = bytes(data)
    n = len(data)
    if n <= 4:
        return None
    start, length, back = _copies(data)
    # runs of literals between the copies, and after the last
    lit = np.append(0, start + length)
    run = np.append(start, n) - lit
    lit_parts = -(-run // LITERALS)
    copy_parts = np.append(-(-length // LONGEST), 0)
    length, back = np.append(length, 0), np.append(back, 1)
    # the parts of one copy have about equal lengths, so none is too short
    owner, k = _spread(copy_parts)
    share, more = length[owner] // copy_parts[owner], length[owner] % copy_parts[owner]
    part = share + (k < more)
    width = np.where(part - 2 < 7, 2, 3)
    copy_size = np.bincount(owner, width, len(run)).astype(np.int64)
    size = run + lit_parts + copy_size
    total = int(size.sum())
    if total >= n:
        return None
    to = np.cumsum(size) - size
    out, raw = np.empty(total, dtype=np.uint8), np.frombuffer(data, dtype=np.uint8)
    # literals are what no copy covers, and in the output what is no element's head
    edge = np.zeros(n + 1, dtype=np.int8)
    edge[start], taken = 1, np.ones(total, dtype=bool)
    edge[start + length[:-1]] -= 1
    given = np.cumsum(edge[:n], dtype=np.int8) == 0
    o, j = _spread(lit_parts)
    p = to[o] + j * (LITERALS + 1)
    out[p] = np.minimum(run[o] - j * LITERALS, LITERALS) - 1
    taken[p] = False
    before = np.cumsum(width) - width
    p = to[owner] + (run + lit_parts)[owner] + before - (np.cumsum(copy_size) - copy_size)[owner]
    far, short = back[owner] - 1, width == 2
    out[p] = np.where(short, part - 2, 7) << 5 | far >> 8
    out[p[~short] + 1] = part[~short] - 9
    out[p + width - 1] = far & 255
    taken[p], taken[p + 1], taken[p + width - 1] = False, False, False
    out[taken] = raw[given]
    return out.tobytes()
