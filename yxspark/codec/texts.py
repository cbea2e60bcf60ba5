"""Cells of text, numbers in text and times in text, a column at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DAY_NS = 86_400_000_000_000


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


#: Stretches longer than this are moved one by one, shorter ones by arrays of places, which take many bytes for each byte moved.
LONG = 128


def moved(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """out[to : to + length] = data[start : start + length], for each of the stretches."""
    long_ = np.flatnonzero(length > LONG)
    for a, b, n in zip(to[long_].tolist(), start[long_].tolist(), length[long_].tolist()):
        out[a : a + n] = data[b : b + n]
    if len(long_):
        short = np.flatnonzero((length <= LONG) & (length > 0))
        to, start, length = to[short], start[short], length[short]
    off = offsets_of(length)
    if off[-1]:
        place = np.arange(off[-1])
        out[np.repeat(to - off[:-1], length) + place] = data[np.repeat(start - off[:-1], length) + place]


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches [start, start + length) of data, one after the other."""
    off = offsets_of(length)
    if len(start) and (start[1:] == start[:-1] + length[:-1]).all():
        return data[start[0] : start[0] + off[-1]]
    out = np.empty(off[-1], dtype=np.uint8)
    moved(out, off[:-1], data, start, length)
    return out


def _mask(valid: np.ndarray):
    return pa.array(valid).buffers()[1] if not valid.all() else None


def arrow_bytes(data: np.ndarray, off: np.ndarray, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    if off[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch holds more than 2 GB of one column; lower batchSize")
    return pa.Array.from_buffers(kind, len(valid), [_mask(valid), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def utf8(data: np.ndarray, off: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Text of UTF-8 bytes; what isn't UTF-8 becomes U+FFFD."""
    if not len(data) or data.max() < 128:
        return arrow_bytes(data, off, valid, pa.string())
    out = arrow_bytes(data, off, valid, pa.string())
    try:
        out.validate(full=True)
        return out
    except pa.ArrowInvalid:
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") if v else None for a, b, v in zip(off[:-1], off[1:], valid)], pa.string())


def _lone(text: bytes) -> str:
    """UTF-16 with surrogates: one that has no partner becomes U+FFFD; a high one takes the unit after it along."""
    u, out, i = np.frombuffer(text, dtype="<u2").tolist(), [], 0
    while i < len(u):
        c = u[i]
        i += 1
        if 0xD800 <= c < 0xDC00:
            low = u[i] if i < len(u) else 0
            i += 1
            out.append(chr(0x10000 + ((c - 0xD800) << 10) + low - 0xDC00) if 0xDC00 <= low < 0xE000 else "�")
        else:
            out.append("�" if 0xDC00 <= c < 0xE000 else chr(c))
    return "".join(out)


def utf16(data: np.ndarray, off: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Text of UTF-16 (little-endian) bytes."""
    if (off % 2).any():  # half a unit at an end is dropped
        length = np.diff(off) & ~1
        data, off = gather(data, off[:-1], length), offsets_of(length)
    units = data.view("<u2") if data.flags.c_contiguous else np.ascontiguousarray(data).view("<u2")
    if not len(units) or units.max() < 128:
        return arrow_bytes(units.astype(np.uint8), off // 2, valid, pa.string())
    if not ((units >= 0xD800) & (units < 0xE000)).any():
        more = np.zeros(len(units) + 1, dtype=np.int32)  # bytes beyond one, of all units before each
        np.cumsum((units >= 0x80).view(np.uint8) + (units >= 0x800).view(np.uint8), dtype=np.int32, out=more[1:])
        whole = units.tobytes().decode("utf-16-le").encode()
        return arrow_bytes(np.frombuffer(whole, dtype=np.uint8), off // 2 + more[off // 2], valid, pa.string())
    raw = data.tobytes()

    def text(part: bytes) -> str:
        try:
            return part.decode("utf-16-le")
        except UnicodeDecodeError:
            return _lone(part)

    return pa.array([text(raw[a:b]) if v else None for a, b, v in zip(off[:-1].tolist(), off[1:].tolist(), valid.tolist())], pa.string())


def until_nul(cells: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-width text up to its first NUL: bytes and offsets. cells: (rows, bytes)."""
    n, width = cells.shape
    zero = cells == 0 if unit == 1 else (cells[:, 0::2] == 0) & (cells[:, 1::2] == 0)
    length = np.where(zero.any(axis=1), zero.argmax(axis=1), width // unit) * unit if width else np.zeros(n, np.int64)
    flat = np.ascontiguousarray(cells).ravel()
    return gather(flat, np.arange(n) * width, length), offsets_of(length)


def _digits(cells: np.ndarray, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The number that the digits at these places make, and whether they are digits."""
    d = cells[:, places].astype(np.int64) - 48
    return d @ (10 ** np.arange(len(places) - 1, -1, -1)), ((d >= 0) & (d <= 9)).all(axis=1)


def _days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = (month >= 1) & (month <= 12) & (day >= 1) & (year >= 1)
    y, m = np.where(ok, year, 1970), np.where(ok, month, 1)
    first = ((y - 1970) * 12 + m - 1).astype("datetime64[M]")
    length = ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype(np.int64)
    return first.astype("datetime64[D]").astype(np.int64) + np.where(ok, day, 1) - 1, ok & (day <= length)


def dates(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970, and which cells are dates. What has other than digits where digits belong, or no such day, is none."""
    (y, a), (m, b), (d, c) = (_digits(cells, p) for p in ([0, 1, 2, 3], [5, 6], [8, 9]))
    days, ok = _days(y, m, d)
    return days, ok & a & b & c


def seconds(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (h, a), (m, b), (s, c) = (_digits(cells, p) for p in ([0, 1], [3, 4], [6, 7]))
    return h * 3600 + m * 60 + s, a & b & c & (h < 24) & (m < 60) & (s < 60)


def text_of_dates(days: np.ndarray) -> np.ndarray:
    """(rows, 10) bytes YYYY-MM-DD."""
    if not len(days):
        return np.empty((0, 10), np.uint8)
    date = days.astype("datetime64[D]")
    month = date.astype("datetime64[M]")
    day, month = (date - month.astype("datetime64[D]")).astype(np.int64) + 1, month.astype(np.int64) + 1970 * 12
    year = month // 12
    if year.min() < 0 or year.max() > 9999:
        return np.frombuffer(b"".join(np.datetime_as_string(date).astype("S10").tolist()), dtype=np.uint8).reshape(-1, 10)
    out = np.full((len(days), 10), 45, dtype=np.uint8)
    for at, value in ((0, year // 100), (2, year % 100), (5, month % 12 + 1), (8, day)):
        out[:, at], out[:, at + 1] = 48 + value // 10, 48 + value % 10
    return out


def text_of_seconds(s: np.ndarray) -> np.ndarray:
    """(rows, 8) bytes HH:MM:SS."""
    out = np.full((len(s), 8), 58, dtype=np.uint8)
    for at, value in ((0, s // 3600), (3, s // 60 % 60), (6, s % 60)):
        out[:, at], out[:, at + 1] = 48 + value // 10, 48 + value % 10
    return out


def unscaled(text: str, scale: int) -> int:
    """Digits of a decimal text as an integer of `scale` places; further places are cut off, other characters skipped."""
    text = text.strip()
    negative = text.startswith("-")
    whole, _, part = text.partition(".")
    digits = lambda t: "".join(c for c in t if "0" <= c <= "9")
    n = int(digits(whole) or 0) * 10**scale + int((digits(part)[:scale].ljust(scale, "0")) or 0)
    return -n if negative else n


def decimals(values: list[str | None], precision: int, scale: int) -> pa.Array:
    import decimal

    with decimal.localcontext() as c:
        c.prec = 76
        made = [None if v is None else decimal.Decimal(unscaled(v, scale)).scaleb(-scale) for v in values]
    top = 10**precision
    return pa.array([None if x is None or abs(int(x.scaleb(scale))) >= top else x for x in made], pa.decimal128(precision, scale))
