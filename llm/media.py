"""Media columns: payloads kept as 8-bit samples in WAV form, cut by content, stored once a chunk, rebuilt from ordered chunk lists.

A rolling gear hash (of the last 32 bytes) cuts where its top bits are zero, so that equal stretches of different payloads become equal chunks.
The store is a table with one row for each distinct chunk digest, bucketed by digest: chunks come together by digest, what
the store has is left out by an anti-join, and reading joins each distinct media's chunk list with the store, without moving the store.
Chunks are compressed with a dictionary trained on a bounded sample of whole chunks of all texts: each task offers its TASK_SAMPLE chunks of least
digest, and the SAMPLE least of these are taken, so what is stored doesn't depend on the order of rows. The store
keeps the dictionary as a row of its own. A medium is rebuilt once however many documents share it, and its digest is verified before features are computed.

The list entries of a very common chunk would meet in one task. A chunk with more than HOT entries is copied once for each HOT of them, and
its entries are dealt to the copies; all other entries join the store by its buckets, without moving it.

Edge cases: a null text is an empty one; its payload is 64 zero bytes. Repeated rows and repeated doc_ids get a row each; null
doc_ids stay. A text is one medium, of at most 2 GB; its task holds it a few times over. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CLEANUP, discard, salted, slices, stage, texts_of

LEAST, MASK_BITS, MOST = 1024, 12, 16384
#: Chunks that a task offers and that are taken to train the dictionary of so many bytes (from LEAST_SAMPLE on).
TASK_SAMPLE, SAMPLE, LEAST_SAMPLE, DICTIONARY = 64, 2048, 100, 112_640
#: List entries that one copy of a chunk serves.
HOT = 100_000
#: The digest of the store's dictionary row; digests of chunks have 16 bytes.
DICTIONARY_KEY = b"dictionary"
LEVEL = 9
RATE = 8000
UNIT = 64
_GEAR = (salted(256, 77) >> np.uint64(32)).astype(np.uint32)


def header(n: int) -> bytes:
    """Of a WAV file with n samples of 8 bits, one channel."""
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)


def samples(media: bytes) -> bytes:
    """The samples of a WAV file, checked against its header."""
    n = struct.unpack("<I", media[40:44])[0]
    if media[:44] != header(n) or len(media) != 44 + n:
        raise ValueError("not a medium of this form")
    return media[44:]


def wrap(text: bytes) -> bytes:
    padded = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return header(padded) + text + bytes(padded - len(text))


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(media)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(media, dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16):  # the sum over 32 bytes, each shifted by its age
        older = np.zeros_like(h)
        older[k:] = h[:-k]
        h = h + (older << np.uint32(k))
    at = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, start = [], 0
    while n - start > LEAST:
        i = np.searchsorted(at, start + LEAST)
        end = min(int(at[i]) if i < len(at) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def digest(x: bytes) -> bytes:
    return hashlib.sha256(x).digest()[:16]


def manifests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (sha256 of the stored form), list (digests of its chunks, in order); and rows with a null media whose sample are a task's chunks of least digest."""
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary(), "list": pa.list_(pa.binary()), "sample": pa.list_(pa.binary())}

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    def run(batches):
        least: dict[bytes, bytes] = {}
        top = b"\xff" * 16
        for b in slices(batches):
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)).cast(pa.binary()).to_pylist()):
                medium = wrap(t)
                digests = []
                for c in chunks(medium):
                    digests.append(digest(c))
                    if digests[-1] < top:
                        least[digests[-1]] = c
                        if len(least) > 2 * TASK_SAMPLE:
                            least = {k: least[k] for k in sorted(least)[:TASK_SAMPLE]}
                            top = max(least)
                rows.append((doc, len(t), hashlib.sha256(medium).digest(), digests, None))
            yield made(rows)
        if least:
            yield made([(None, None, None, None, [least[k] for k in sorted(least)[:TASK_SAMPLE]])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary, list array<binary>, sample array<binary>")


def trained(found: DataFrame) -> bytes:
    """A compression dictionary from the samples in manifests; empty where there is too little to learn from."""
    import zstandard

    rows = found.where("sample is not null").select(F.explode("sample").alias("chunk")).distinct().orderBy(F.sha2("chunk", 256)).limit(SAMPLE).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY, [bytes(r["chunk"]) for r in rows]).as_bytes() if len(rows) >= LEAST_SAMPLE else b""
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


def payload_chunks(docs: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """digest, bytes (compressed) of every chunk; a task leaves out what it gave lately."""

    def run(batches):
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=LEVEL, **_dictionary(dictionary)), set()
        for b in slices(batches):
            keys, values = [], []
            for t in texts_of(b.column(0)).cast(pa.binary()).to_pylist():
                for c in chunks(wrap(t)):
                    if (d := digest(c)) not in seen:
                        seen.add(d)
                        keys.append(d)
                        values.append(pack.compress(c))
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["digest", "bytes"])

    return docs.select("text").mapInArrow(run, "digest binary, bytes binary")


class Store:
    """A bucketed table of chunks."""

    def __init__(self, spark, name: str | None = None):
        self.spark, self.name = spark, name or f"chunks_{uuid.uuid4().hex}"

    def add(self, found: DataFrame) -> None:
        spark, n = self.spark, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        new = found.dropDuplicates(["digest"])
        if spark.catalog.tableExists(self.name):
            new = new.join(spark.table(self.name).select("digest"), "digest", "left_anti")
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            new.write.format("parquet").mode("append").option("compression", "none").bucketBy(n, "digest").saveAsTable(self.name)
        finally:
            spark.conf.set(CLEANUP, before)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def dictionary(self) -> bytes:
        row = self.table().where(F.col("digest") == F.lit(bytearray(DICTIONARY_KEY))).select("bytes").first()
        return bytes(row["bytes"]) if row else b""

    def ingest(self, docs: DataFrame, listed: DataFrame) -> None:
        """Adds the chunks of all texts, with the store's dictionary or, for the first time, one trained on the samples of their manifests."""
        if self.spark.catalog.tableExists(self.name):
            self.add(payload_chunks(docs, self.dictionary()))
            return
        own = trained(listed)
        found = payload_chunks(docs, own)
        if own:
            found = found.unionByName(self.spark.createDataFrame([(bytearray(DICTIONARY_KEY), bytearray(own))], "digest binary, bytes binary"))
        self.add(found)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def feature(sound: np.ndarray) -> str:
    """Root mean square, rate of zero crossings, peak, and entropy in bits a sample."""
    x = sound.astype(np.int16) - 128
    p = np.bincount(sound, minlength=256) / len(sound)
    p = p[p > 0]
    crossings = np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)) / max(1, len(x) - 1)
    return f"rms={np.sqrt(np.mean(x.astype(float) ** 2)):.4f} zcr={crossings:.4f} peak={int(np.abs(x).max())} entropy={max(0.0, -(p * np.log2(p)).sum()):.4f}"


def rebuilt(lists: DataFrame, store: Store, hot: int = HOT) -> DataFrame:
    """Of each distinct medium in lists (media, list), read back from the store and verified: its measures."""
    entries = lists.groupBy("media").agg(F.first("list").alias("list")).select("media", F.posexplode("list").alias("seq", "digest"))
    entries = stage(entries, "entries")
    common = stage(entries.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("digest", F.ceil(F.col("n") / hot).cast("int").alias("copies")), "common")
    rest = entries.join(common, "digest", "left_anti").join(store.table().hint("merge"), "digest")
    salted_ = entries.join(common, "digest").withColumn("copy", F.pmod(F.xxhash64("media", "seq"), F.col("copies")).cast("int")).drop("copies")
    copied = store.table().join(common, "digest").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    parts = rest.unionByName(salted_.join(copied, ["digest", "copy"]).drop("copy"))
    dictionary = store.dictionary()
    whole = parts.groupBy("media").agg(F.sort_array(F.collect_list(F.struct("seq", "bytes"))).alias("parts"))

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor(**_dictionary(dictionary))
        for b in batches:
            rows = []
            for key, found in zip(b.column(0).to_pylist(), b.column(1)):
                medium = b"".join(unpack.decompress(p["bytes"].as_py()) for p in found)
                if hashlib.sha256(medium).digest() != key:
                    raise ValueError("a medium that was read back differs from what was stored")
                payload = samples(medium)
                rows.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(medium), feature(np.frombuffer(payload, dtype=np.uint8)), len(found)))
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()))], names=["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature", "n_chunks"])

    return whole.mapInArrow(run, "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string, n_chunks int")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every document's text as a medium, read it back, and report it by document."""
    listed = stage(manifests(docs), "manifests")
    lists = listed.where("media is not null").drop("sample")
    store = Store(docs.sparkSession)
    try:
        store.ingest(docs, listed)
        measured = stage(rebuilt(lists, store), "measured")
    finally:
        store.drop()
    out = lists.select("doc_id", "n_bytes", "media").join(measured, "media")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature", "n_chunks")
