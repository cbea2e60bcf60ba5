"""Removal of repeated word windows, found by recompression.

Documents are sequences of symbols, words at first. A level of recompression names maximal runs of equal symbols, then pairs of a left and a right symbol
(the side is a bit of the symbol's name). A name is 128 bits, put together from the names of what the symbol is made of by two independent
scramblings; so all workers give one name to one expansion, without a dictionary, and equal stretches of text get equal symbols except near their ends.

* Long repeats (``shared_symbols``). The first LEVELS_FIRST levels are named while texts are read. Then Spark rounds go on: a round counts every name over
  the whole corpus and finds its earliest place; symbols that occur once are barriers from then on, shared ones are named LEVELS_ROUND levels further,
  until nothing shared has a shared neighbour. A shared symbol of WINDOW words or more that isn't the earliest of its name verifies
  all windows inside it as repeats at once.
* What is left (``repeats``): windows that no such symbol covers. Their earliest places are never covered, so these windows need only be
  held against each other. A low-level parse with known contexts (the span of words that the making of a symbol looked at; equal contexts make equal
  symbols) gives each window an anchor: the phrase of PHRASE words that begins at a symbol of the highest level that fits in the window with its
  context, of those the one of least name. Equal windows have equal anchors, and anchors are a small part of all places. Phrases that occur once drop out by a count
  over the corpus. Occurrences with the same surroundings (all words that windows with this anchor can cover) collapse; only
  where a phrase has several surroundings are single windows compared, one occurrence for each of the surroundings.
* Repeats go back to their documents, whose words they cover are removed.

Common symbols and phrases are counted with partial sums, and what joins with them are staged tables, so Spark can split the occurrences of one.
Equality is that of 128 bits at least: both halves start from hashes of the words that share nothing, and every step scrambles. Words themselves
aren't compared.

Edge cases: null texts have no words. Rows that repeat a doc_id come in the order of a hash of their texts, and equal ones one after the other in any order, so all but
one are removed like any copy. A null doc_id comes first. Documents shorter than the window lose nothing. An empty table gives an empty result.
Other columns pass through ``deduplicated`` untouched, whatever their names. A very long text is parsed
in stretches; beside these it needs about 60 bytes of memory a word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PORTION, Words, discard, mix, named, runs_of, slices, stage

WINDOW = 20
PHRASE = 8
#: Levels of the parse with contexts, which finds anchors.
LEVELS = 2
#: Levels named while texts are read (symbols of some ten words then), and further ones in each Spark round.
LEVELS_FIRST, LEVELS_ROUND = 9, 8
_SEEDS = (1, 2)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NULL = -(1 << 63)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a * _A + np.uint64(1)) + b * _B)


def _run(a: np.ndarray, times: np.ndarray) -> np.ndarray:
    return mix(mix(a * _B + np.uint64(2)) + times.astype(np.uint64) * _A)


def _right(name: np.ndarray, level: int) -> np.ndarray:
    """Which symbols are right ones at this level."""
    return (mix(name ^ np.uint64(1000 + level)) & np.uint64(1)).astype(bool)


#: Words that are parsed together where a text has more: bounds what a parse needs, however long a text is.
STRETCH = 1 << 18


class Part:
    """Some words of a batch, from place `a` on: all of them, or a stretch of one long document."""

    def __init__(self, words: Words, a: int, b: int, whole: bool):
        self.a, self.b = a, b
        self.first, self.doc = (words.first, words.doc) if whole else (np.array([0, b - a]), np.zeros(b - a, dtype=np.int64))


def parts_of(words: Words, overlap: int) -> list[Part]:
    """Parts that hold all runs of overlap + 1 words of a document between them, each run once as one of those that begin in the part."""
    n = len(words.start)
    if n <= 2 * STRETCH:
        return [Part(words, 0, n, True)]
    ends = words.first.tolist()
    return [Part(words, a, min(end, a + STRETCH + overlap), False) for begin, end in zip(ends[:-1], ends[1:]) for a in range(begin, end, STRETCH)]


# ---- recompression of long repeats --------------------------------------------------------------------------------


def compress(seq: np.ndarray, names: tuple[np.ndarray, np.ndarray], at: np.ndarray, length: np.ndarray, levels: range):
    """Some levels over sequences of symbols (in the order of seq and at): runs, then pairs, of symbols that follow each other without a gap."""
    for level in levels:
        for pairs in (False, True):
            n = len(at)
            if n < 2:
                return seq, names, at, length
            joined = (seq[1:] == seq[:-1]) & (at[:-1] + length[:-1] == at[1:])
            if pairs:
                right = _right(names[0], level)
                joined &= ~right[:-1] & right[1:]
            else:
                joined &= (names[0][1:] == names[0][:-1]) & (names[1][1:] == names[1][:-1])
            if not joined.any():
                continue
            begin = np.flatnonzero(np.append(True, ~joined))
            size = np.diff(np.append(begin, n))
            many = size > 1
            made = []
            for x in names:
                y = x[begin]
                y[many] = _pair(x[begin[many]], x[begin[many] + 1]) if pairs else _run(y[many], size[many])
                made.append(y)
            length = np.add.reduceat(length, begin)
            seq, names, at = seq[begin], tuple(made), at[begin]
    return seq, names, at, length


_STATE = "doc long, turn long, n1 array<long>, n2 array<long>, at array<int>, len array<int>"


def _lists(first: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def _state(doc: pa.Array, turn: pa.Array, n: int, seq, names, at, length) -> pa.RecordBatch:
    """A row for each sequence that has symbols."""
    first = np.searchsorted(seq, np.arange(n + 1))
    some = np.flatnonzero(np.diff(first))
    columns = [_lists(first, v, t).take(pa.array(some)) for v, t in ((names[0].view(np.int64), pa.int64()), (names[1].view(np.int64), pa.int64()), (at.astype(np.int32), pa.int32()), (length.astype(np.int32), pa.int32()))]
    return pa.RecordBatch.from_arrays([doc.take(pa.array(some)), turn.take(pa.array(some)), *columns], names=["doc", "turn", "n1", "n2", "at", "len"])


def _first_symbols(numbered: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            w = Words(b.column(2))
            long_ = np.repeat(w.count >= window, w.count)
            found = []
            hashes = [w.hashes(s) for s in _SEEDS]
            for part in parts_of(w, 0):
                some = np.flatnonzero(long_[part.a : part.b]) + part.a
                seq, names, at, length = compress(w.doc[some], tuple(h[some] for h in hashes), some - w.first[w.doc[some]], np.ones(len(some), np.int64), range(LEVELS_FIRST))
                found.append((seq, *names, at, length))
            seq, n1, n2, at, length = map(np.concatenate, zip(*found))
            yield _state(b.column(0), b.column(1), b.num_rows, seq, (n1, n2), at, length)

    return numbered.select("doc", "turn", "text").mapInArrow(run, _STATE)


def _further(found: DataFrame, level: int) -> DataFrame:
    """found: doc, turn, symbols (at, len, n1, n2; in order), all shared. Names them further; symbols without a neighbour are done."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            first = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            at, length, n1, n2 = (np.asarray(x) for x in lists.flatten().flatten())
            seq = np.repeat(np.arange(b.num_rows), np.diff(first))
            at, length = at.astype(np.int64), length.astype(np.int64)
            near = np.zeros(len(at), dtype=bool)
            follow = (seq[1:] == seq[:-1]) & (at[:-1] + length[:-1] == at[1:])
            near[1:] |= follow
            near[:-1] |= follow
            names = (n1.view(np.uint64)[near], n2.view(np.uint64)[near])
            yield _state(b.column(0), b.column(1), b.num_rows, *compress(seq[near], names, at[near], length[near], range(level, level + LEVELS_ROUND)))

    return found.mapInArrow(run, _STATE)


def shared_symbols(numbered: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, turn, lo, hi (first words of the first and last window) of stretches that also start earlier, verified by shared symbols. Staged."""
    state = stage(_first_symbols(numbered, window), "symbols")
    level, marks, staged = LEVELS_FIRST, None, []
    place = F.struct("doc", "turn", "at")
    while True:
        rows = state.select("doc", "turn", F.explode(F.arrays_zip("n1", "n2", "at", "len")).alias("s")).select("doc", "turn", "s.*")
        names = stage(rows.groupBy("n1", "n2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("n1", "n2", "first"), "names")
        shared = stage(rows.join(names, ["n1", "n2"]).withColumn("later", place != F.col("first")).drop("first"), "shared")
        discard(state, names)
        staged.append(shared)
        new = shared.where(F.col("later") & (F.col("len") >= window)).select("doc", "turn", F.col("at").alias("lo"), (F.col("at") + F.col("len") - window).alias("hi"))
        marks = new if marks is None else marks.unionByName(new)
        lists = shared.groupBy("doc", "turn").agg(F.sort_array(F.collect_list(F.struct("at", "len", "n1", "n2"))).alias("symbols"))
        state = stage(_further(lists, level), "symbols")
        level += LEVELS_ROUND
        if not state.limit(1).count():
            break
    out = stage(marks, "marks")
    discard(state, *staged)
    return out


# ---- the parse with contexts --------------------------------------------------------------------------------------


class Symbols:
    """One level of the parse of some documents: start and end in words, name, and the context [lo, hi) of each symbol."""

    def __init__(self, words: Words | Part, hashes: np.ndarray):
        n = len(hashes)
        self.words = words
        self.start, self.end = np.arange(n), np.arange(1, n + 1)
        self.lo, self.hi = self.start.copy(), self.end.copy()
        self.doc, self.name = words.doc, hashes

    def merged(self, first: np.ndarray, length: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> "Symbols":
        """The symbols first, first + 1, ... first + length - 1 become one, with the given names and contexts."""
        out = object.__new__(Symbols)
        out.words, out.name = self.words, name
        out.start, out.end = self.start[first], self.end[first + length - 1]
        out.lo, out.hi, out.doc = lo, hi, self.doc[first]
        return out

    def _context(self, first: np.ndarray, last: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        """The joint context of all symbols from `left` before first to `right` after last; a look beyond a document's end takes a place outside it in."""
        doc, n = self.doc[first], len(self.doc)
        begin, stop = self.words.first[doc], self.words.first[doc + 1]
        lo, hi = self.lo[first], self.hi[last]
        size = int((last - first).max(initial=0))
        for j in [*range(-left, 0), *range(1, size + right + 1)]:
            at = first + j
            used = at <= last + right
            inside = (at >= 0) & (at < n)
            at = np.clip(at, 0, n - 1)
            inside &= self.doc[at] == doc
            lo = np.where(used, np.minimum(lo, np.where(inside, self.lo[at], begin - 1 if j < 0 else lo)), lo)
            hi = np.where(used, np.maximum(hi, np.where(inside, self.hi[at], stop + 1 if j > 0 else hi)), hi)
        return lo, hi

    def runs(self) -> "Symbols":
        """Runs of exactly two or three equal symbols become one; longer ones stay, so that contexts are bounded."""
        n = len(self.name)
        if not n:
            return self
        head = np.ones(n, dtype=bool)
        head[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(head)
        length = np.diff(np.append(first, n))
        long_ = length > 3
        # a long run's symbols stand for themselves
        single = np.repeat(long_, length)
        keep = head | single
        begin = np.flatnonzero(keep)
        size = np.where(single[begin], 1, np.diff(np.append(begin, n)))
        # whether a run is one of two or three takes a look at three symbols either side, at most
        near = np.where(single[begin], 3, 1)
        lo, hi = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
        for k in (1, 3):
            at = near == k
            lo[at], hi[at] = self._context(begin[at], (begin + size - 1)[at], k, k)
        name, many = self.name[begin], size > 1
        name[many] = _run(name[many], size[many])
        return self.merged(begin, size, name, lo, hi)

    def pairs(self, level: int) -> "Symbols":
        """A left symbol and the right symbol after it become one."""
        n = len(self.name)
        if not n:
            return self
        right = _right(self.name, level)
        joins = np.zeros(n, dtype=bool)  # with the next
        joins[:-1] = ~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1])
        second = np.zeros(n, dtype=bool)
        second[1:] = joins[:-1]
        begin = np.flatnonzero(~second)
        size = 1 + joins[begin]
        # a pair looks at its two symbols; a left one that stays alone at the next, a right one at the one before
        left = np.where((size == 1) & right[begin], 1, 0)
        after = np.where((size == 1) & ~right[begin], 1, 0)
        lo, hi = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
        for a, b in ((0, 0), (1, 0), (0, 1)):
            at = (left == a) & (after == b)
            lo[at], hi[at] = self._context(begin[at], (begin + size - 1)[at], a, b)
        name, many = self.name[begin], size == 2
        name[many] = _pair(name[many], self.name[begin[many] + 1])
        return self.merged(begin, size, name, lo, hi)


def parse(words: Words | Part, hashes: np.ndarray, levels: int = LEVELS) -> list[Symbols]:
    out = [Symbols(words, hashes)]
    for k in range(levels):
        out.append(out[-1].runs().pairs(k))
    return out


def anchors(words: Words | Part, hashes: np.ndarray, window: int = WINDOW, phrase: int = PHRASE, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places (first words) and names of the phrases that are some window's anchor, and the first and last window of each that has it. known: windows that need none."""
    n = len(hashes)
    none = np.empty(0, np.int64)
    if n < window:
        return none, np.empty(0, np.uint64), none, none
    inside = np.flatnonzero(np.arange(n) + phrase <= words.first[words.doc + 1])
    name = np.zeros(n, np.uint64)
    name[inside] = runs_of(hashes, phrase, 31)[inside]
    where = np.full(n, -1, np.int64)
    todo = np.arange(n) + window <= words.first[words.doc + 1]
    if known is not None:
        todo &= ~known
    todo = np.flatnonzero(todo)
    none_yet = np.iinfo(np.uint64).max
    for s in reversed(parse(words, hashes)):  # from the highest level down, for windows without an anchor so far
        # the first and last window that each phrase fits
        key, first, last = np.full(n, none_yet, dtype=np.uint64), np.ones(n, np.int64), np.zeros(n, np.int64)
        at = s.start[s.start + phrase <= words.first[s.doc + 1]]
        ok = s.start + phrase <= words.first[s.doc + 1]
        key[at] = name[at]
        first[at] = (np.maximum(s.hi, s.start + phrase) - window)[ok]
        last[at] = np.minimum(s.lo, s.start)[ok]
        best, place = np.full(len(todo), none_yet, dtype=np.uint64), np.full(len(todo), -1, np.int64)
        for k in range(window - phrase + 1):  # a phrase that begins k words into the window; of equals the first
            p = todo + k
            better = (key[p] < best) & (first[p] <= todo) & (todo <= last[p])
            best[better] = key[p[better]]
            place[better] = p[better]
        where[todo] = place
        todo = todo[place < 0]
        if not len(todo):
            break
    windows = np.flatnonzero(where >= 0)
    place = where[windows]
    # windows with one anchor follow each other, but another anchor may stand between: first and last are the extremes
    found, inverse = np.unique(place, return_inverse=True)
    lo_w, hi_w = np.full(len(found), n, np.int64), np.full(len(found), -1, np.int64)
    np.minimum.at(lo_w, inverse, windows)
    np.maximum.at(hi_w, inverse, windows)
    return found, name[found], lo_w, hi_w


# ---- the corpus ---------------------------------------------------------------------------------------------------


def _numbered(docs: DataFrame, carried: list[str] = ()) -> DataFrame:
    """doc (doc_id, null as the least long), turn (0; rows that share a doc_id have ascending numbers by a hash of their text), text and row (the carried columns)."""
    rows = docs.select(F.coalesce(named("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), named("text").alias("text"), F.struct(F.lit(0).alias("_"), *map(named, carried)).alias("row"))
    again = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    if not again.limit(1).count():
        return rows.withColumn("turn", F.lit(0).cast("long"))
    again = stage(again, "again")
    some = rows.join(again, "doc", "left_semi").withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    # in order over all partitions, so ascending numbers follow it; a doc_id or a row that repeats very often is split
    some = some.repartitionByRange("doc", "hash", "tie").sortWithinPartitions("doc", "hash", "tie").withColumn("turn", F.monotonically_increasing_id() + 1).drop("hash", "tie")
    return rows.join(again, "doc", "left_anti").withColumn("turn", F.lit(0).cast("long")).unionByName(stage(some, "repeated-ids"))


def _taken(column: pa.Array, places: np.ndarray) -> pa.Array:
    return column.take(pa.array(places))


def _covered(n: int, base: np.ndarray, spans: pa.Array, beyond: int = 0) -> np.ndarray:
    """Which of n places lie in some span lo..hi + beyond of their document; base: the first place of each document."""
    first = np.asarray(spans.offsets)
    doc = np.repeat(np.arange(len(spans)), np.where(np.asarray(spans.is_valid()), np.diff(first), 0))
    if not len(doc):
        return np.zeros(n, dtype=bool)
    lo, hi = (np.asarray(x).astype(np.int64) for x in spans.flatten().flatten())
    edge = np.bincount(lo + base[doc], minlength=n + 1) - np.bincount(hi + beyond + 1 + base[doc], minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _anchors(texts: DataFrame, window: int) -> DataFrame:
    """texts: doc, turn, text, spans (windows known as repeats). name, a1, a2 (hashes of the surroundings), doc, turn, spot (the anchor's place << 20, + how far before it its first window begins << 10, + how far its last is from its first)."""

    def run(batches):
        for b in slices(batches):
            w = Words(b.column(2))
            h = [w.hashes(s) for s in _SEEDS]
            known = _covered(len(h[0]), w.first, b.column(3))
            for part in parts_of(w, window - 1):
                x = [y[part.a : part.b] for y in h]
                at, name, lo, hi = anchors(part, x[0], window, known=known[part.a : part.b])
                doc = w.doc[at + part.a] if len(at) else np.empty(0, np.int64)
                around = []
                for y, seed in zip(x, (41, 42)):
                    # the first and the last window cover all surroundings; where the phrase lies in them belongs to them
                    r = runs_of(y, window, seed)
                    around.append(_pair(r[lo], r[hi]) + ((at - lo) * 1024 + hi - lo).astype(np.uint64) * _A if len(at) else np.empty(0, np.uint64))
                spot = (at + part.a - w.first[doc] << 20) + (at - lo << 10) + (hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(y.view(np.int64)) for y in (name, *around)), _taken(b.column(0), doc), _taken(b.column(1), doc), pa.array(spot)],
                    names=["name", "a1", "a2", "doc", "turn", "spot"],
                )

    return texts.select("doc", "turn", "text", "spans").mapInArrow(run, "name long, a1 long, a2 long, doc long, turn long, spot long")


def _single_windows(texts: DataFrame, window: int) -> DataFrame:
    """texts: doc, turn, text, spans (of first and last windows): both hashes of each window."""

    def run(batches):
        for b in slices(batches):
            w = Words(b.column(2))
            h = [w.hashes(s) for s in _SEEDS]
            at = np.flatnonzero(_covered(len(h[0]), w.first, b.column(3)))
            doc = w.doc[at]
            values = [runs_of(x, window, seed)[at].view(np.int64) if len(at) else np.empty(0, np.int64) for x, seed in zip(h, (41, 42))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, values), _taken(b.column(0), doc), _taken(b.column(1), doc), pa.array((at - w.first[doc]).astype(np.int32))], names=["h1", "h2", "doc", "turn", "at"])

    return texts.select("doc", "turn", "text", "spans").mapInArrow(run, "h1 long, h2 long, doc long, turn long, at int")


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", "turn").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def repeats(numbered: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, turn, spans (lo, hi: first words of the first and last of some windows that also start earlier)."""
    marks = shared_symbols(numbered, window)
    found = stage(_anchors(numbered.join(_spans(marks), ["doc", "turn"], "left"), window), "anchors")
    # staged, so that the join deals out both sides anew and Spark can split a very common phrase
    shared = stage(found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "names")
    some = stage(found.join(shared, "name"), "shared")
    discard(found, shared)
    place = F.struct("doc", "turn", "spot")
    keys = ["name", "a1", "a2"]
    groups = stage(some.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last")), "groups")
    spot = lambda c: (F.shiftright(c, 20) - F.shiftright(c, 10) % 1024).cast("int")
    lo_hi = lambda c: (spot(c).alias("lo"), (spot(c) + c % 1024).cast("int").alias("hi"))
    # all but the earliest occurrence of equal surroundings
    later = some.join(groups.where("first != last").select(*keys, "first"), keys).where(place != F.col("first")).select("doc", "turn", *lo_hi(F.col("spot")))
    # phrases with several surroundings: single windows of the earliest of each
    mixed = stage(groups.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "mixed")
    ask = groups.join(mixed, "name").select("first.doc", "first.turn", *lo_hi(F.col("first.spot")))
    single = stage(_single_windows(numbered.join(_spans(ask), ["doc", "turn"]), window), "windows")
    at = F.struct("doc", "turn", "at")
    # staged like the names, for windows that are very common
    least = stage(single.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("final")).where("first != final").select("h1", "h2", "first"), "least")
    again = single.join(least, ["h1", "h2"]).where(at != F.col("first")).select("doc", "turn", F.col("at").alias("lo"), F.col("at").alias("hi"))
    out = stage(_spans(later.unionByName(again).unionByName(marks)), "repeats")
    discard(some, groups, mixed, single, least, marks)
    return out


def _kept(words: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words that stay, each with a space after it, and where each document's begin (one more at the end)."""
    size = np.where(gone, 0, words.end - words.start + 1)
    stop = np.cumsum(size)
    out = np.full(int(stop[-1]) if len(stop) else 0, 32, dtype=np.uint8)
    for a in range(0, len(size), PORTION):  # bounds the arrays over bytes
        some = np.flatnonzero(~gone[a : a + PORTION]) + a
        n = words.end[some] - words.start[some]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[within + np.repeat(stop[some] - size[some], n)] = words.data[within + np.repeat(words.start[some], n)]
    return out, np.append(0, stop)[words.first]


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    numbered = _numbered(docs)
    marked = numbered.join(repeats(numbered, window), ["doc", "turn"], "left").select("doc", "text", "spans")

    def run(batches):
        for b in slices(batches):
            w = Words(b.column(1))
            gone = _covered(len(w.start), w.first, b.column(2), window - 1)
            out, first = _kept(w, gone)
            digests = [hashlib.sha256(out[i : max(i, j - 1)].data).hexdigest() for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
            removed = np.bincount(w.doc, gone, b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.count.astype(np.int64)), pa.array(removed), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NULL, F.col("doc_id")))


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated windows taken out of text: words of a text that loses any are joined by one space, other texts stay as they are. n_chars follows, where there is one."""
    names = docs.columns
    carried = [c for c in names if c != "text"]
    numbered = _numbered(docs, carried)
    marked = numbered.join(repeats(numbered, window), ["doc", "turn"], "left")

    def run(batches):
        for b in slices(batches):
            w = Words(b.column(0))
            gone = _covered(len(w.start), w.first, b.column(1), window - 1)
            touched = np.bincount(w.doc, gone, b.num_rows) > 0
            texts, columns = b.column(0), dict(zip(carried, b.column(2).flatten()[1:]))
            if touched.any():
                out, first = _kept(w, gone)
                texts, old = texts.to_pylist(), columns["n_chars"].to_pylist() if "n_chars" in columns else None
                for i in np.flatnonzero(touched).tolist():
                    texts[i] = out[first[i] : max(first[i], first[i + 1] - 1)].tobytes().decode()
                    if old is not None:
                        old[i] = len(texts[i])
                if old is not None:
                    columns["n_chars"] = pa.array(old, columns["n_chars"].type)
                texts = pa.array(texts, b.column(0).type)
            yield pa.RecordBatch.from_arrays([texts if c == "text" else columns[c] for c in names], names=names)

    return marked.select("text", "spans", "row").mapInArrow(run, docs.schema)
