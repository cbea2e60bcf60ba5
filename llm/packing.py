"""Packing documents into token sequences: a grouping genetic algorithm on islands, and partition-local best-fit decreasing.

``pack_documents`` fixes what goes where for every piece of every document, in as few sequences as it can:

* A document's ids, with an end id, are cut into pieces only where they exceed a sequence. Whole-sequence pieces stand alone.
* All other pieces are dealt at random into districts of about DISTRICT pieces. Each district is evolved by ISLANDS islands, each a task
  with a population of its own, at first of pieces best-fitted in random orders: a solution is a set of bins; crossover injects whole
  well-filled bins of one parent into the other, removes the bins that hold any of their documents, and best-fits the displaced ones. An
  island that doesn't reach the lower bound gets its neighbour's elite and evolves again.
* Of each district's best solution the well-filled bins are final, at any rate the better half of its bins. The documents of the others are
  pooled over all districts, dealt again and evolved again, until one district is left; so slack doesn't add up over districts.

A task never sees more than a district, whatever the input's size. Texts are read once; later steps move 16 bytes a piece.

``pack_sequences`` writes the ids themselves: each task packs what it reads by best-fit decreasing, with a segment tree over free capacities to find
the tightest bin; badly filled bins are packed once more across tasks. Ids aren't shuffled but for those few. ``write_matrices`` makes binary
files of them: id matrices, segment starts, row lengths.

Edge cases: null texts are empty; an empty text is the end id alone. Repeated rows and repeated doc_ids are documents of their own, so their rows repeat in the
result at different places. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import discard, slices, stage

SIZE = 4096
END_ID = 1
DISTRICT = 2000
ISLANDS = 2
POPULATION = 6
GENERATIONS = 16
#: A bin of this share of the capacity is well filled.
WELL = 0.995
#: Tokens a task of pack_sequences packs at a time.
BUFFER = 8_000_000


# ---- tokens ----------------------------------------------------------------------------------------------------


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _with_end(encoded: np.ndarray, end_id: int) -> np.ndarray:
    return np.append(encoded, np.uint32(end_id)).astype("<u4")


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: uid (of its own), doc_id, piece, start, length, ids_crc32. Staged: texts are tokenised once."""

    def run(batches):
        from .tokens import encoder

        encode, uid = encoder(tokenizer).encode, _task() << 33
        for b in slices(batches, limit=4 << 20):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                ids = _with_end(ids, end_id)
                for k, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    rows.append((uid, doc, k, start, len(part), zlib.crc32(part.tobytes())))
                    uid += 1
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(plain.mapInArrow(run, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")


# ---- the grouping genetic algorithm ----------------------------------------------------------------------------


class Bins:
    """Open bins by free capacity; `fit` gives the tightest that takes a length, or a new one."""

    def __init__(self, size: int):
        self.size, self.free, self.held = size, [], []  # free: sorted (capacity, bin)

    def add(self, members: list[int], used: int) -> None:
        bisect.insort(self.free, (self.size - used, len(self.held)))
        self.held.append(list(members))

    def fit(self, item: int, length: int) -> None:
        i = bisect.bisect_left(self.free, (length, -1))
        if i == len(self.free):
            self.add([item], length)
        else:
            left, b = self.free.pop(i)
            self.held[b].append(item)
            bisect.insort(self.free, (left - length, b))


def best_fit(order, lengths: np.ndarray, size: int, kept: list[list[int]] = ()) -> list[list[int]]:
    bins = Bins(size)
    for members in kept:
        bins.add(members, int(lengths[members].sum()))
    for i in order:
        bins.fit(int(i), int(lengths[i]))
    return bins.held


def fitness(solution: list[list[int]], lengths: np.ndarray, size: int) -> tuple[int, float]:
    """Few bins first, then uneven ones: full bins beside one with much room."""
    fill = np.array([lengths[b].sum() for b in solution]) / size
    return -len(solution), float((fill**2).mean())


def crossover(giver, taker, lengths: np.ndarray, size: int, rng) -> list[list[int]]:
    fill = np.array([lengths[b].sum() for b in giver])
    good = np.flatnonzero(fill >= WELL * size)
    if not len(good):
        good = np.argsort(-fill)[: max(1, len(giver) // 4)]
    chosen = rng.choice(good, max(1, len(good) // 2), replace=False)
    injected = [giver[i] for i in chosen]
    inside = np.zeros(len(lengths), dtype=bool)
    inside[[i for b in injected for i in b]] = True
    kept, displaced = [], []
    for b in taker:
        if inside[b].any():
            displaced += [i for i in b if not inside[i]]
        else:
            kept.append(b)
    # the emptiest of the others give theirs up as well, which lets the tight ones be refilled
    kept.sort(key=lambda b: lengths[b].sum())
    gone = max(1, len(kept) // 20)
    displaced += [i for b in kept[:gone] for i in b]
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(displaced, lengths, size, injected + kept[gone:])


def evolve(lengths: np.ndarray, size: int, seed: int, elites: list[list[list[int]]] = (), generations: int = GENERATIONS) -> list[list[int]]:
    """The best solution of one island. Stops at the lower bound; never worse than best-fit decreasing."""
    bound = -(-int(lengths.sum()) // size)
    rng = np.random.default_rng(seed)
    population = [list(e) for e in elites]
    while len(population) < POPULATION:
        population.append(best_fit(rng.permutation(len(lengths)), lengths, size))
        if len(population[-1]) <= bound:
            return population[-1]
    score = [fitness(p, lengths, size) for p in population]
    for _ in range(generations):
        a, b = rng.choice(POPULATION, 2, replace=False)
        if score[a] < score[b]:
            a, b = b, a
        child = crossover(population[a], population[b], lengths, size, rng)
        worst = min(range(POPULATION), key=score.__getitem__)
        if (s := fitness(child, lengths, size)) > score[worst]:
            population[worst], score[worst] = child, s
        if len(child) <= bound:
            return child
    best = population[max(range(POPULATION), key=score.__getitem__)]
    # crossovers have the last word where they can; what they make is never worse than plain best-fit decreasing
    plain = best_fit(np.argsort(-lengths, kind="stable"), lengths, size)
    return plain if len(plain) < len(best) else best


_SOLVED = "district long, island int, uid long, length long, bin int, done boolean, bins int, bound int"


def _solution(part: pd.DataFrame, lengths: np.ndarray, bins: list[list[int]], size: int) -> pd.DataFrame:
    where = np.empty(len(lengths), dtype=np.int32)
    for k, b in enumerate(bins):
        where[b] = k
    fill = np.bincount(where, lengths, len(bins)).astype(np.int64)
    # the better half of the bins is done at any rate, so each level has fewer pieces than the one before
    done = (fill >= WELL * size) | (np.argsort(np.argsort(-fill, kind="stable")) < (len(bins) + 1) // 2)
    return pd.DataFrame({"district": part["district"].iloc[0], "island": part["island"].iloc[0], "uid": part["uid"].to_numpy(), "length": lengths, "bin": where, "done": done[where], "bins": np.int32(len(bins)), "bound": np.int32(-(-int(lengths.sum()) // size))})


def _first_epoch(size: int, level: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("uid")
        lengths = part["length"].to_numpy()
        seed = [level, int(part["district"].iloc[0]), int(part["island"].iloc[0])]
        return _solution(part, lengths, evolve(lengths, size, seed), size)

    return run


def _second_epoch(size: int, level: int):
    """Rows of one island: its own solution (origin 0) and its neighbour's (origin 1)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part["origin"] == 0].sort_values("uid")
        lengths = own["length"].to_numpy()
        elites = []
        for o in (0, 1):
            some = part[part["origin"] == o].sort_values("uid")
            if len(some) == len(own):
                order = np.argsort(some["bin"].to_numpy(), kind="stable")
                stops = np.cumsum(np.bincount(some["bin"].to_numpy()))[:-1]
                elites.append([x.tolist() for x in np.split(order, stops)])
        seed = [level, int(own["district"].iloc[0]), int(own["island"].iloc[0]), 2]
        return _solution(own, lengths, evolve(lengths, size, seed, elites), size)

    return run


def place(lengths: DataFrame, size: int = SIZE, district: int = DISTRICT) -> DataFrame:
    """uid, sequence_id, offset of every row of lengths (uid, unique; length of 1 to size)."""
    whole = lengths.where(F.col("length") == size).select(F.col("uid").alias("sequence_id"), "uid", F.lit(0).cast("long").alias("offset"))
    rest, fixed, level = lengths.where(F.col("length") < size).select("uid", "length"), [], 1
    least = int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        count = rest.count()
        n = max(1, -(-count // district))
        # few bytes, but much work: dealt out by number, or they would be put together into few tasks
        parts = min(n * ISLANDS, max(least, n * ISLANDS // 32))
        dealt = rest.withColumn("district", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n)))
        islands = dealt.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))))
        epoch = stage(islands.repartition(parts, "district", "island").groupBy("district", "island").applyInPandas(_first_epoch(size, level), _SOLVED), "epoch")
        # elite migration where no island has reached the bound
        open_ = epoch.groupBy("district").agg((F.min("bins") > F.max("bound")).alias("open")).where("open").select("district")
        parted = epoch.join(open_, "district", "left_semi").withColumn("origin", F.explode(F.array(F.lit(0), F.lit(1))))
        moved = parted.withColumn("island", F.pmod(F.col("island") + F.col("origin"), F.lit(ISLANDS)))
        again = moved.repartition(parts, "district", "island").groupBy("district", "island").applyInPandas(_second_epoch(size, level), _SOLVED)
        all_ = stage(epoch.join(open_, "district", "left_anti").unionByName(again), "evolved")
        best = all_.groupBy("district").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
        solved = all_.join(best, ["district", "island"])
        last = n == 1
        done = F.lit(True) if last else F.col("done")
        # a number of its own for every bin, apart from those of whole pieces (which are uids)
        number = F.lit(-(level << 56)) - F.col("district") * (1 << 20) - F.col("bin") - 1
        fixed.append(stage(solved.where(done).select(number.alias("sequence_id"), "uid", "length"), "fixed"))
        if last:
            break
        rest = stage(solved.where(~done).select("uid", "length"), "rest")
        discard(epoch, all_)
        level += 1
    found = fixed[0]
    for f in fixed[1:]:
        found = found.unionByName(f)
    order = W.partitionBy("sequence_id").orderBy("uid").rowsBetween(W.unboundedPreceding, -1)
    return found.select("sequence_id", "uid", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset")).unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    found = pieces(docs, tokenizer, size, end_id)
    return found.join(place(found.select("uid", "length"), size), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# ---- best-fit decreasing with a segment tree ----------------------------------------------------------------------


class CapacityTree:
    """Bins by free capacity 0..size; a segment tree of counts finds the least capacity of at least so much."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def push(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def pop(self, capacity: int) -> int:
        i = capacity + self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.bins[capacity].pop()

    def least(self, wanted: int) -> int:
        """The least capacity >= wanted that some bin has; -1 if none."""
        count, i = self.count, wanted + self.leaves
        if count[i]:
            return wanted
        while i > 1:
            if not i & 1 and count[i + 1]:  # a right neighbour that holds bins
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    tree, bins = CapacityTree(size), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        capacity = tree.least(n)
        if capacity < 0:
            capacity, b = size, len(bins)
            bins.append([i])
        else:
            b = tree.pop(capacity)
            bins[b].append(i)
        tree.push(capacity - n, b)
    return bins


SEQUENCE = T.StructType(
    [
        T.StructField("sequence_id", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("input_ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("position_resets", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("pieces", T.ArrayType(T.IntegerType())),
    ]
)


def _sequence(number: int, members: list[tuple]) -> tuple:
    """members: (doc_id, piece, ids)."""
    cu = np.cumsum([0, *(len(m[2]) for m in members)]).tolist()
    return number, cu[-1], b"".join(m[2].tobytes() for m in members), cu, cu[:-1], [m[0] for m in members], [m[1] for m in members]


def _batch(rows: list[tuple], done: bool | None = None) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
    columns = list(zip(*rows)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=SEQUENCE.names)


def id_type(tokenizer: str | None) -> str:
    """Two bytes an id where the vocabulary allows it."""
    from .tokens import encoder

    return "<u2" if encoder(tokenizer).full.get_vocab_size() < 1 << 16 else "<u4"


def pack_sequences(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, well: float = 0.98) -> DataFrame:
    """One row a sequence: the row of the id matrix (input_ids, without padding; 2 or 4 bytes an id), cumulative segment lengths, where positions start again, and whose pieces they are."""
    kind = id_type(tokenizer)

    def chunks(rows: list[tuple]):
        for i in range(0, len(rows), 256):
            yield _batch(rows[i : i + 256])

    def run(batches):
        from .tokens import encoder

        encode, number = encoder(tokenizer).encode, _task() << 33
        held: list[tuple] = []
        tokens = 0

        def flush():
            nonlocal number
            rows = []
            for b in best_fit_decreasing(np.array([len(m[2]) for m in held], dtype=np.int64), size) if held else ():
                s = _sequence(number, [held[i] for i in b])
                number += 1
                rows.append(s if s[1] >= well * size else (-s[0] - 1, *s[1:]))  # below zero: not well filled
            held.clear()
            return chunks(rows)

        for b in slices(batches, limit=4 << 20):
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                ids = _with_end(ids, end_id).astype(kind)
                held += [(doc, k, ids[s : s + size]) for k, s in enumerate(range(0, len(ids), size))]
                tokens += len(ids)
            if tokens >= BUFFER:
                yield from flush()
                tokens = 0
        yield from flush()

    first = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SEQUENCE), "sequences")
    loose = first.where("sequence_id < 0")
    parts = max(1, -(-(loose.agg(F.sum("n_tokens")).first()[0] or 0) // BUFFER))

    def again(part: pd.DataFrame) -> pd.DataFrame:
        members = []
        for cu, raw, whose, which in zip(part["cu_seqlens"], part["input_ids"], part["doc_ids"], part["pieces"]):
            ids = np.frombuffer(raw, dtype=kind)
            members += [(whose[i], which[i], ids[cu[i] : cu[i + 1]]) for i in range(len(whose))]
        order = sorted(range(len(members)), key=lambda i: (members[i][0] if members[i][0] is not None else -1, members[i][1]))
        members = [members[i] for i in order]
        numbers = sorted(part["sequence_id"].tolist())
        bins = best_fit_decreasing(np.array([len(m[2]) for m in members], dtype=np.int64), size)
        if len(bins) > len(numbers):  # no gain: what was packed stays
            return part
        return pd.DataFrame([_sequence(numbers[k], [members[i] for i in b]) for k, b in enumerate(bins)], columns=SEQUENCE.names)

    packed = loose.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(parts))).applyInPandas(again, SEQUENCE)
    return first.where("sequence_id >= 0").unionByName(packed)


# ---- binary files -------------------------------------------------------------------------------------------------

#: Little-endian heads of the files: what they are, bytes an id, ids a row, rows.
MAGIC = b"PACKIDS1"


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_matrices(sequences: DataFrame, path: str, size: int = SIZE, pad: int = 0) -> DataFrame:
    """Writes the rows of pack_sequences as binary files below path, one a task; returns file, rows, tokens of each.

    part-N.ids: MAGIC, uint32 bytes an id, uint32 size, uint64 rows, then the matrix of ids row by row, rows filled up with `pad`. part-N.segments: MAGIC, uint64
    rows, uint64 segments, then uint64 places of each row's first segment (one more at the end), uint32 starts of the segments in their rows (where positions start again),
    uint32 lengths of the rows. A task that runs twice writes the same names; files get them when they are whole.
    """

    def run(batches):
        import struct
        import uuid

        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        width = max(2, -(-len(rows[0]["input_ids"]) // rows[0]["n_tokens"]))
        matrix = np.full((len(rows), size), pad, dtype=f"<u{width}")
        for i, r in enumerate(rows):
            matrix[i, : r["n_tokens"]] = np.frombuffer(r["input_ids"], dtype=matrix.dtype)
        first = np.cumsum([0, *(len(r["position_resets"]) for r in rows)]).astype("<u8")
        resets = np.array([x for r in rows for x in r["position_resets"]], dtype="<u4")
        store, at = _store(path)
        store.create_dir(at, recursive=True)
        name = f"part-{_task():05d}"
        parts = {"ids": (struct.pack("<IIQ", width, size, len(rows)), matrix), "segments": (struct.pack("<QQ", len(rows), len(resets)), first, resets, np.array([r["n_tokens"] for r in rows], dtype="<u4"))}
        for kind, (head, *arrays) in parts.items():
            hidden = f"{at}/_{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as out:
                out.write(MAGIC + head)
                for x in arrays:
                    out.write(np.ascontiguousarray(x).data)
            store.move(hidden, f"{at}/{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.ids"]), pa.array([len(rows)]), pa.array([sum(r["n_tokens"] for r in rows)])], names=["file", "rows", "tokens"])

    return stage(sequences.mapInArrow(run, "file string, rows long, tokens long"), "files")


def read_matrix(path: str, name: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of one file (part-N.ids): the matrix, the segment starts of each row, and the lengths of the rows."""
    import struct

    store, at = _store(path)

    def content(kind: str) -> bytes:
        with store.open_input_stream(f"{at}/{name.removesuffix('.ids')}.{kind}") as f:
            raw = f.read()
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name}: not a file of packed ids")
        return raw[len(MAGIC) :]

    ids, segments = content("ids"), content("segments")
    width, size, rows = struct.unpack_from("<IIQ", ids)
    matrix = np.frombuffer(ids, dtype=f"<u{width}", offset=16).reshape(rows, size)
    n, count = struct.unpack_from("<QQ", segments)
    first = np.frombuffer(segments, dtype="<u8", count=n + 1, offset=16).astype(np.int64)
    resets = np.frombuffer(segments, dtype="<u4", count=count, offset=24 + 8 * n)
    return matrix, np.split(resets, first[1:-1]), np.frombuffer(segments, dtype="<u4", count=n, offset=24 + 8 * n + 4 * count)
