"""Exact token ids of whole texts with a public BPE file.

A pre-token of the vocabulary never spans white space, so a text's ids are the ids of its white-space separated chunks, one after the
other. Three ways lead to them, from fast to slow:

* Texts of Latin-1 letters, digits and common marks (most are) are taken together: array operations put them in lower case, cut them into pre-tokens, and
  mark the last letter of each by its capital, which stands for "this letter, at the end" in the table of a compiled byte-pair merger. Each
  distinct pre-token is merged once, and its ids go to all its places.
* Other texts go chunk by chunk. Chunks repeat, so each worker keeps the ids of those seen lately (at most ``CACHE`` of them, then it starts afresh).
* Chunks with special-token strings, unusual case rules or letters beyond Latin-1 go through the file's complete pipeline.

All merge with the file's own merges; tests hold them against the library.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from array import array

import numpy as np

from .common import release, span_hashes

CACHE = 200_000
#: Letters of a text that are encoded together.
PART = 1 << 20
_SPACE = re.compile("[ \t\n\x0b\x0c\r]")
_loaded: dict[str, "Encoder"] = {}
#: Letters the short way takes; a word's last byte stands for "this letter, at the end" in the merger.
LETTERS = string.ascii_lowercase + "".join(chr(c) for c in range(0xDF, 0xFF) if chr(c).isalpha())
#: Marks that the fast way takes (a quote starts contractions, so it isn't among them), and the control bytes for the last one of a run.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]_{|}"
CONTROLS = bytes([*range(0, 9), *range(14, 32), 127])
PLAIN = frozenset(LETTERS + LETTERS.upper().replace("SS", ""))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str | None = None) -> "Encoder":
    """The worker's encoder of this file, made once."""
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = Encoder(path)
        release()  # what reading the file took
    return _loaded[path]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Chunks(dict):
    """Ids of white-space separated chunks, as bytes; computes what it lacks."""

    def __init__(self, of: "Encoder"):
        self.of = of

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.of.chunk(chunk)
        if len(self) >= CACHE:
            self.clear()
        self[chunk] = ids
        return ids


class Encoder:
    """``encode(texts)`` gives one little-endian uint32 array of ids a text."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.full = Tokenizer.from_file(path)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        suffix = spec["model"].get("end_of_word_suffix")
        self.fast = None
        # the short way is for files of this shape only; others take the complete pipeline for each chunk
        if kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and suffix:
            self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
            self._marker(spec["model"]["vocab"], suffix)
        self.cache = _Chunks(self)
        self.marks: dict[str, bytes] = {}

    def _marker(self, vocab: dict[str, int], suffix: str) -> None:
        """Tables of the fast way: kinds of bytes (0 other, 1 letter, 2 mark, 3 digit, 4 white space), last bytes, and the merger."""
        import tiktoken

        kind, last = np.zeros(256, dtype=np.uint8), np.zeros(256, dtype=np.uint8)
        kind[[*range(97, 123), 0xC3]], kind[[*MARKS.encode()]], kind[48:58], kind[[9, 10, 11, 12, 13, 32]] = 1, 2, 3, 4
        second = [0x9F, *(c for c in range(0xA0, 0xBF) if c != 0xB7)]  # of two-byte small letters
        for c in [*range(97, 123), *second]:
            last[c] = c - 32
        last[0x9F] = 0x97
        for c, to in zip(MARKS.encode(), CONTROLS):
            last[c] = to
        last[48:58] = np.arange(48, 58)
        self.kind, self.lasts, self.second = kind, last, np.isin(np.arange(256), second)
        byte = {c: b for b, c in _byte_letters().items()}
        letters, marks, digits = {*range(97, 123), 0xC3, *second}, set(MARKS.encode()), set(range(48, 58))
        ranks, top = {}, max(vocab.values()) + 1
        for w, i in vocab.items():
            end = w.endswith(suffix)
            raw = bytes(byte[c] for c in (w[: -len(suffix)] if end else w) if c in byte)
            if not raw or not (set(raw) <= letters or set(raw) <= marks or end and len(raw) == 1 and raw[0] in digits) or end and not (last[raw[-1]] or raw[-1] == MARKS.encode()[0]):
                continue
            ranks[raw[:-1] + bytes([last[raw[-1]]]) if end else raw] = i
        self.final = np.zeros(top + 256, dtype=bool)
        self.final[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        for b in range(256):
            ranks.setdefault(bytes([b]), top + b)
        controls = "".join(f"\\x{c:02x}" for c in CONTROLS)
        pattern = "[a-z\u00df-\u00f6\u00f8-\u00fe]*[A-Z\u00c0-\u00de]|[0-9]|[" + "".join("\\" + c for c in MARKS) + f"]*[{controls}]"
        self.fast = tiktoken.Encoding("marked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.fast._core_bpe.encode_single_piece
        self.fast._mergeable_ranks = {}  # the compiled merger has its own

    def _fast(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids by the fast way; None for a text with what it doesn't take. Each distinct pre-token of all texts is merged once."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).copy()
        if not len(data):
            return [np.empty(0, "<u4") for _ in texts]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        lead = np.zeros(len(data), dtype=bool)  # after a two-byte letter's first byte
        lead[1:] = data[:-1] == 0xC3
        upper = (data >= 65) & (data <= 90) | lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        data[upper] += 32
        kind = self.kind[data]
        kind[lead] = self.second[data[lead]]
        special = kind == 0
        special[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # <| may begin a special token
        bad = np.flatnonzero(special)
        hard = np.zeros(len(texts), dtype=bool)
        hard[np.searchsorted(off, bad, side="right") - 1] = True
        if hard.any():
            kind[np.repeat(hard, np.diff(off))] = 4
        change = np.ones(len(data) + 1, dtype=bool)
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
        change |= edge
        start = np.flatnonzero(change[:-1] & (kind != 4))
        end = np.flatnonzero(change[1:] & (kind != 4)) + 1
        data[end - 1] = self.lasts[data[end - 1]]
        _, at, which = np.unique(span_hashes(data, start, end, 91), return_index=True, return_inverse=True)
        whole = data.tobytes()
        made = self.fast.encode_to_numpy(b" ".join([whole[i:j] for i, j in zip(start[at].tolist(), end[at].tolist())]).decode("utf-8"), disallowed_special=()).astype("<u4")
        stops = np.flatnonzero(self.final[made]) + 1
        if len(stops) != len(at):
            return [None] * len(texts)
        begin = np.concatenate([[0], stops[:-1]])
        size = (stops - begin)[which]
        to = np.concatenate([[0], np.cumsum(size)])
        ids = made[np.repeat(begin[which] - to[:-1], size) + np.arange(to[-1])]
        cuts = to[np.searchsorted(start, off)].tolist()
        return [None if h else ids[i:j] for h, i, j in zip(hard.tolist(), cuts[:-1], cuts[1:])]

    def word(self, w: str) -> bytes:
        """Ids of one pre-token of LETTERS."""
        raw = w.encode()
        return array("I", self.piece(raw[:-1] + bytes((int(self.lasts[raw[-1]]),)))).tobytes()

    def _all(self, s: str) -> bytes:
        return array("I", self.full.encode(s, add_special_tokens=False).ids).tobytes()

    def mark(self, w: str) -> bytes:
        if w not in self.marks:
            if len(self.marks) >= CACHE // 10:
                self.marks.clear()
            self.marks[w] = self._all(w)
        return self.marks[w]

    def chunk(self, chunk: bytes) -> bytes:
        s = chunk.decode("utf-8", "surrogatepass")
        if self.fast is None:
            return self._all(s)
        if s.isascii() and s.isalpha() or PLAIN.issuperset(s):
            return self.word(s.lower())
        if s[-1] in ",." and s[:-1].isalpha() and PLAIN.issuperset(s[:-1]):
            return self.word(s[:-1].lower()) + self.mark(s[-1])
        if "<|" in s or not s.isascii() and (max(s) > "ÿ" or not s.replace("­", "x").isprintable()) or not s.isprintable():
            return self._all(s)
        # Latin-1 only: already composed, and lower case letter by letter
        out = []
        for w in self.pattern.findall(s.lower()):
            if PLAIN.issuperset(w):
                out.append(self.word(w))
            else:
                out.append(self.mark(w))
        return b"".join(out)

    def _chunked(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.cache.__getitem__, (text or "").encode("utf-8", "surrogatepass").split())), dtype="<u4")

    def _short(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.fast is None:
            return [self._chunked(t) for t in texts]
        return [self._chunked(t) if f is None else f for t, f in zip(texts, self._fast(texts))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Texts of more than PART letters go part by part, cut at white space, so that what they need doesn't grow with their length."""
        out = self._short([t if t is None or len(t) <= PART else "" for t in texts])
        for i, t in enumerate(texts):
            if t is not None and len(t) > PART:
                out[i] = np.concatenate([self._short([p])[0] for p in parts(t)])
        return out


def parts(text: str, size: int | None = None):
    """The text in parts of about `size` letters that begin with white space."""
    size, a = size or PART, 0
    while a < len(text):
        m = _SPACE.search(text, a + size)
        b = m.start() if m else len(text)
        yield text[a:b]
        a = b


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
