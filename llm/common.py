"""What the operators share: staging tables, slices of Arrow batches, words and their hashes as arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python takes at most so many bytes of text at a time.
SLICE = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark is local (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="stages-")
        found = _own[app]
    return found.rstrip("/")


def stage(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, safe from lost executors. Its shuffle files go as soon as it is written."""
    spark = spark or df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def tuned(spark: SparkSession) -> SparkSession:
    """Batches small enough that long texts fit a worker: a text beyond the bound comes alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def named(column: str):
    """A column by its plain name, whatever marks that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def crc_mod(doc_id, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % n


def texts_of(column: pa.Array) -> pa.Array:
    """Null texts become empty; offsets of 32 bits."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of batches with at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.nan_to_num(np.array(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Give memory that a task needed back: workers are kept for later tasks, of other operators as well."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---- words -----------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser that MurmurHash3 made known)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def salted(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes looked at together where a text is cut into words: bounds the arrays over bytes, however long a text is.
STRETCH = 1 << 20
#: Words hashed together, and the size from which a word is hashed by itself.
PORTION, LONG_WORD = 1 << 17, 64


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the spans start..end of data, eight bytes at a time, each scrambled into what came before."""
    import xxhash

    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = np.empty(len(start), dtype=np.uint64)
    salt = salted(1, seed)[0]
    for a in range(0, len(start), PORTION):
        s, left = start[a : a + PORTION].astype(np.int64), (end[a : a + PORTION] - start[a : a + PORTION]).astype(np.int64)
        h = mix(left.astype(np.uint64) ^ salt)
        long_ = np.flatnonzero(left > LONG_WORD)
        live = np.flatnonzero((left > 0) & (left <= LONG_WORD))
        while len(live):
            rest = left[live]
            word = eight[s[live]]
            short = rest < 8
            word[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
            h[live] = mix(h[live] * np.uint64(0x9E3779B97F4A7C15) ^ word)
            s[live] += 8
            left[live] -= 8
            live = live[rest > 8]
        for i in long_.tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[start[a + i] : end[a + i]].tobytes(), seed & 0xFFFFFFFF)
        out[a : a + PORTION] = h
    return out


def runs_of(values: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of all runs of `size` values, put together from those of runs of 1, 2, 4, ... values; each step scrambles."""
    odd = salted(2, seed) | np.uint64(1)
    n, out, done, power, width = len(values), None, 0, values, 1
    while True:
        if size & width:
            part = power[done : done + max(0, n - size + 1)]
            out = mix(part + odd[1]) if out is None else mix(out * odd[0] + part)
            done += width
        if done == size or n < size:
            return out if out is not None and n >= size else np.empty(0, dtype=np.uint64)
        power = mix(power[: len(power) - width] * odd[0] + power[width:])
        width *= 2


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some texts: byte spans, document of each, and where a document's words begin."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts_of(texts)
        n = len(texts)
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
        self.off = off - off[0]
        self.data = _LOWER[raw] if lower else raw
        starts, ends = [], []
        for a in range(0, len(raw), STRETCH):
            some = raw[max(0, a - 1) : a + STRETCH + 1]  # with a byte either side
            solid = np.zeros(len(some) + (a == 0) + (a + STRETCH >= len(raw)), dtype=bool)
            solid[(a == 0) : (a == 0) + len(some)] = ~((some == 32) | ((some >= 9) & (some <= 13)))
            # a document's edge parts words
            edge = np.zeros(len(solid) - 1, dtype=bool)
            edge[self.off[np.searchsorted(self.off, a) : np.searchsorted(self.off, min(a + STRETCH, len(raw)), side="right")] - a] = True
            inside = solid[1:-1]
            starts.append(np.flatnonzero(inside & (~solid[:-2] | edge[:-1])) + a)
            ends.append(np.flatnonzero(inside & (~solid[2:] | edge[1:])) + a + 1)
        self.start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.empty(0, np.int64)
        self.first = np.searchsorted(self.start, self.off)  # of each document, and the total at the end
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)

    def hashes(self, seed: int = 1) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, seed)

    def raw(self, i: int) -> list[bytes]:
        """Words of document i."""
        return self.data[self.off[i] : self.off[i + 1]].tobytes().split()


def windows(words: Words, values: np.ndarray, size: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of `size` words within one document."""
    start = np.arange(max(0, len(values) - size + 1))
    hashed = runs_of(values, size, seed)
    if len(start):
        inside = words.doc[start] == words.doc[start + size - 1]
        start, hashed = start[inside], hashed[inside]
    return start, hashed
