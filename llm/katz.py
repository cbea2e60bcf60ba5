"""Katz backoff scoring of order ORDER: Good-Turing discounted counts, exactly normalised backoff weights, evaluated recursively for every token.

The corpus is read once into batches: each batch keeps its own vocabulary and its tokens as places in it. What a batch needs to know of
the corpus it asks for, with its own training counts, every distinct key once and in one row a bucket of the key space; a bucket's task adds
up what all batches sent and answers each in the order of its question. The answers are tables by bucket in the shared folder.

1. Words: counts, and a number for each word, small for common ones; from then on numbers stand for words, in ascending order, and are packed tightly.
2. For each order k from 2 on, n-grams by a hash of their history: the batch also sends the count of the n-gram one word shorter, which it has by now.
   The bucket counts, and for each history adds up how many continuations were seen 1..K times, how many had a shorter n-gram seen 1..K times,
   the sum of the larger such counts, and the sum of all counts.
3. N-grams of very common histories (from HOT on, or with a document's start) go by a hash of the whole n-gram instead; their buckets make partial sums, which a last round adds up
   by history for the batches that have it. Batches ask for these sums together with their longest n-grams.

Batches with numbers, and the answers that they need again, are tables of the warehouse dealt by batch: joins read them in place, only new answers are shuffled.
So no table is broadcast, nothing about the vocabulary or the histories reaches the driver but K + 4 sums an order, which Spark adds up; a common n-gram is one entry a
batch, and a very common history is spread over all buckets.

P(w|h) is d(c(hw)) c(hw) / c(h) where hw was seen, else alpha(h) P(w|h') with h' one word shorter (P(w|h') itself where h was never seen); P(w) is
d(c(w)) c(w) / N, and all words that training lacks are one unknown word with the mass that discounting leaves. alpha(h) = (1 - sum of P(w|h)
over seen w) / (1 - sum of P(w|h') over the same w), so each history's probabilities sum to one. The sums are whole numbers of n-grams by
their counts, so they are exact. Discounts are Good-Turing up to counts of K where the counts of counts allow it, for fewer counts or absolute discounts
where they don't; a history without discounted n-grams keeps 1 / (c(h) + 1) for unseen words. A document begins with ORDER - 1 start marks.

Edge cases: null texts are empty; an empty text is its end token. A null doc_id counts as training. Repeated rows are documents of their own. Without training
documents every word is unknown and has probability one. An empty table gives an empty result. Other columns are ignored. A very long text is
a batch of its own and needs about 300 bytes of memory a word.
"""

from __future__ import annotations

import dataclasses
import uuid
import zlib
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CLEANUP, Words, discard, mix, release, salted, slices, stage

END = int(salted(1, 404)[0])
ORDER = 3
K = 5
#: Entries of a bucket, about.
BUCKET = 1_000_000
BATCH = 4 << 20
#: Histories that occur so often in training are very common.
HOT = 1 << 21
#: Numbers of a document's start, and of what stands before histories that are shorter than the longest; words begin at FIRST.
START, SHORT, FIRST = 0, 1, 2


# ---- discounts ---------------------------------------------------------------------------------------------------


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for counts r = 0..K from n[r], the number of types with count r (up to K + 1). d of larger counts is 1."""
    n = np.asarray(n, dtype=float)
    for k in range(K, 0, -1):
        if (n[1 : k + 2] > 0).all():
            r = np.arange(1, k + 1)
            a = (k + 1) * n[k + 1] / n[1]
            if a < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
                if ((d > 0) & (d < 1)).all():
                    return np.concatenate([[1.0], d, np.ones(K - k)])
    r = np.arange(1, K + 1)
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return np.concatenate([[1.0], (r - off) / r])


@dataclasses.dataclass
class Unigrams:
    tokens: int
    types: int
    d: np.ndarray
    n: np.ndarray

    def __post_init__(self):
        self.left = float((self.n[1 : K + 1] * np.arange(1, K + 1) * (1 - self.d[1 : K + 1])).sum()) / max(1, self.tokens)
        self.total = self.tokens
        if self.left <= 0:  # nothing was discounted
            self.left, self.total = 1 / (self.tokens + 1), self.tokens + 1

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probability of one word with count c; of the unknown word where c is 0."""
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c / self.total, self.left)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def _d(n: np.ndarray) -> np.ndarray:
    return np.append(discounts(n), 1.0)  # the last for all counts above K


# ---- batches ------------------------------------------------------------------------------------------------------


def held_out(doc_id, folds: int = 10) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, first all lowest bytes, then the next ones, as far as there are any; compressed."""
    import zstandard

    flat = np.ascontiguousarray(x).astype(np.uint64).ravel()
    planes = max(1, (int(flat.max()).bit_length() + 7) // 8) if len(flat) else 1
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes())


def _unpacked(x) -> np.ndarray:
    import zstandard

    x = bytes(x)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), dtype=np.uint8).reshape(x[0], -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, : x[0]] = raw.T
    return out.view(np.uint64).ravel().view(np.int64)


def _joined(blobs) -> np.ndarray:
    return np.concatenate([_unpacked(b) for b in blobs]) if len(blobs) else np.empty(0, np.int64)


_BATCH = "batch long, docs array<long>, first binary, vocab binary, tokens binary, n_vocab long, n_tokens long"


def batches_of(docs: DataFrame) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in slices(batches, limit=BATCH):
            # hashed in small slices, which bounds the arrays over bytes; every document ends with its end token
            parts, counts = [], [np.zeros(1, np.int64)]
            for some in slices([b]):
                w = Words(some.column(1), lower=True)
                parts.append(np.insert(w.hashes(), w.first[1:], np.uint64(END)))
                counts.append(w.count + 1)
            h, first = np.concatenate(parts), np.cumsum(np.concatenate(counts))
            vocab, tokens = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([_packed(x)], pa.binary()) for x in (first, vocab, tokens)), pa.array([len(vocab)]), pa.array([len(h)])],
                names=["batch", "docs", "first", "vocab", "tokens", "n_vocab", "n_tokens"],
            )
            number += 1

    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BATCH), "batches")


def _unique(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct code a place that has it, and for each place the number of its code."""
    _, at, inverse = np.unique(code, return_index=True, return_inverse=True)
    return at, inverse


class Batch:
    """Tokens of some documents, as places in `ids` (numbers of words) and `counts`; and the distinct n-grams and histories of each order among them."""

    def __init__(self, row: dict, order: int):
        self.docs, self.first, self.tokens = row["docs"], _unpacked(row["first"]), _unpacked(row["tokens"])
        self.ids, self.counts, self.order = np.append(np.cumsum(_unpacked(row["ids"])), START), _unpacked(row["counts"]), order
        # places of the words before each token; a document's start is the last entry of ids
        self.before = {0: self.tokens}
        place = np.arange(len(self.tokens)) - np.repeat(self.first[:-1], np.diff(self.first))
        for j in range(1, order):
            x = np.full(len(self.tokens), len(self.ids) - 1)
            x[j:] = self.tokens[:-j]
            x[place < j] = len(self.ids) - 1
            self.before[j] = x

    @cached_property
    def training(self) -> np.ndarray:
        """Of each token, whether its document teaches."""
        return np.repeat([not held_out(d) for d in self.docs], np.diff(self.first))

    @cached_property
    def histories(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By order k: a token for each distinct history of k - 1 words, and each token's history."""
        out, n = {}, len(self.ids)
        for k in range(2, self.order + 1):
            longer = self.before[k - 1]
            out[k] = _unique(longer if k == 2 else longer * len(out[k - 1][0]) + out[k - 1][1])
        return out

    @cached_property
    def grams(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By order k: a token for each distinct n-gram that ends with it, and each token's n-gram."""
        return {k: _unique(self.histories[k][1] * len(self.ids) + self.tokens) for k in range(2, self.order + 1)}

    def words(self, tokens: np.ndarray, k: int, last: int = 0) -> np.ndarray:
        """Numbers of the k - 1 words before the tokens, and with last = 1 of the tokens themselves; a row a word."""
        return np.stack([self.ids[self.before[j][tokens]] for j in range(k - 1, -last, -1)])


def _key(words: np.ndarray) -> np.ndarray:
    """A hash of each column."""
    h = np.full(words.shape[1], len(words), dtype=np.uint64)
    for row in words:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64))
    return h


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _by_bucket(at: np.ndarray, buckets: int) -> np.ndarray:
    """The order by bucket; within a bucket as before, so that neighbours share words and pack well."""
    return np.argsort(at.astype(np.min_scalar_type(buckets)), kind="stable")


def _cuts(at: np.ndarray):
    """(bucket, from, to) of those that have keys, from the ascending buckets of the keys."""
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
    return zip(at[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(at)])


def _rows(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def _steps(words: np.ndarray) -> np.ndarray:
    """Words whose first row ascends, with its steps instead."""
    return np.concatenate([np.diff(words[:1], prepend=0), words[1:]])


def _from_steps(x, rows: int) -> np.ndarray:
    words = _unpacked(x).reshape(rows, -1)
    words[0] = np.cumsum(words[0])
    return words


def _sums(total: np.ndarray) -> list[int]:
    """Of the counts of a bucket's distinct keys: their sum, how many aren't zero, and how many are 0, 1, ..., K + 1."""
    return [int(total.sum()), int((total > 0).sum()), *np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2].tolist()]


def _added(answers: DataFrame) -> np.ndarray:
    """The sums of all buckets, added by Spark."""
    row = answers.where("sums is not null").agg(*(F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(K + 4))).first()
    return np.array(row, dtype=np.int64)


def _gathered(answers: DataFrame, name: str, *columns: str) -> DataFrame:
    """A row for each batch with its answers in the order of the buckets."""
    return answers.where("batch >= 0").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", *columns))).alias(name)).hint("merge")


def dealt(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """df as a table of the warehouse dealt by batch: joins by batch read it without a shuffle."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.format("parquet").option("compression", "none").bucketBy(buckets, "batch").saveAsTable(name)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.table(name)


# ---- words --------------------------------------------------------------------------------------------------------


def word_answers(batches: DataFrame, buckets: int) -> DataFrame:
    """batch, bucket, counts and ids of the batch's words in this bucket; and a row with the bucket's sums."""
    kinds = {"bucket": pa.int64(), "batch": pa.int64(), "keys": pa.binary(), "n": pa.binary()}

    def ask(found):
        for b in found:
            for row in b.to_pylist():
                vocab, first = _unpacked(row["vocab"]).view(np.uint64), _unpacked(row["first"])
                teaches = np.repeat([not held_out(d) for d in row["docs"]], np.diff(first))
                n = np.bincount(_unpacked(row["tokens"])[teaches], minlength=len(vocab))
                yield _rows([(k, row["batch"], _packed(vocab[i:j]), _packed(n[i:j])) for k, i, j in _cuts(bucket_of(vocab, buckets))], kinds)
        release()

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpacked(x) for x in part["keys"]]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, _joined(part["n"].tolist())).astype(np.int64)
        rank = np.empty(len(total), dtype=np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        bucket = int(part["bucket"].iloc[0])
        ids = rank * buckets + bucket + FIRST
        stops = np.cumsum([len(k) for k in keys])[:-1]
        rows = [(b, bucket, _packed(total[p]), _packed(ids[p]), None) for b, p in zip(part["batch"], np.split(inverse, stops))]
        return pd.DataFrame([*rows, (-1, bucket, None, None, _sums(total))], columns=["batch", "bucket", "counts", "ids", "sums"])

    asked = batches.select("batch", "docs", "first", "vocab", "tokens").mapInArrow(ask, "bucket long, batch long, keys binary, n binary")
    return stage(asked.groupBy("bucket").applyInPandas(answer, "batch long, bucket long, counts binary, ids binary, sums array<long>"), "words")


_NUMBERED = "batch long, docs array<long>, first binary, tokens binary, ids binary, counts binary"


def numbered(batches: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Batches with the numbers (as steps, ascending) and counts of their words instead of hashes. Dealt by batch."""

    def run(found):
        for b in found:
            for row in b.to_pylist():
                got = row["words"]
                ids, tokens = _joined([g["ids"] for g in got]), _unpacked(row["tokens"])
                order = np.argsort(ids)
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                packed = (_packed(place[tokens]), _packed(np.diff(ids[order], prepend=0)), _packed(_joined([g["counts"] for g in got])[order]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["batch"]]), pa.array([row["docs"]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (row["first"], *packed))],
                    names=["batch", "docs", "first", "tokens", "ids", "counts"],
                )

    return dealt(batches.select("batch", "docs", "first", "tokens").join(_gathered(answers, "words", "ids", "counts"), "batch").mapInArrow(run, _NUMBERED), "numbered", buckets)


# ---- n-grams ------------------------------------------------------------------------------------------------------


@dataclasses.dataclass
class Question:
    """What a batch asks about order k: its histories that aren't very common, by bucket, with their n-grams; and the n-grams of the others, by theirs."""

    histories: np.ndarray
    many: np.ndarray
    grams: np.ndarray
    buckets: np.ndarray
    common: np.ndarray
    common_histories: np.ndarray
    common_buckets: np.ndarray


def _question(x: Batch, k: int, shorter: np.ndarray, buckets: int, hot: int) -> Question:
    """shorter: counts of the n-grams of order k - 1, of words where k is 2. A history is very common from `hot` on, or where it has a document's start in it."""
    h_at, h_of = x.histories[k]
    g_at = x.grams[k][0]
    start = np.zeros(len(h_at), dtype=bool)
    for j in range(1, k):
        start |= x.before[j][h_at] == len(x.ids) - 1
    last = np.maximum(h_at - 1, 0)  # a history without a start is the n-gram that ends with the token before
    seen = shorter[x.tokens[last] if k == 2 else x.grams[k - 1][1][last]]
    common = start | (seen >= hot)
    own = h_of[g_at]  # ascending
    begin = np.searchsorted(own, np.arange(len(h_at) + 1))
    rest = np.flatnonzero(~common)
    at = bucket_of(_key(x.words(h_at[rest], k)), buckets)
    order = _by_bucket(at, buckets)
    rest, at = rest[order], at[order]
    many = np.diff(begin)[rest]
    grams = np.repeat(begin[rest] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    much = np.flatnonzero(common[own])
    common_at = bucket_of(_key(x.words(g_at[much], k, 1)), buckets)
    order = _by_bucket(common_at, buckets)
    return Question(rest, many, grams, at, much[order], np.flatnonzero(common), common_at[order])


def _known(x: Batch, row: dict, upto: int, buckets: int, hot: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], dict[int, Question]]:
    """By order up to `upto`: counts of the n-grams, sums of the histories (those of very common ones are still missing), and what was asked."""
    counts, sums, asked, shorter = {}, {}, {}, x.counts
    for k in range(2, upto + 1):
        q = asked[k] = _question(x, k, shorter, buckets, hot)
        got = row[f"grams{k}"]
        counts[k] = np.zeros(len(x.grams[k][0]), dtype=np.int64)
        counts[k][q.grams] = _joined([g["counts"] for g in got if not g["common"]])
        counts[k][q.common] = _joined([g["counts"] for g in got if g["common"]])
        sums[k] = np.zeros((2 * K + 2, len(x.histories[k][0])), dtype=np.int64)
        blocks = [_unpacked(g["history"]).reshape(2 * K + 2, -1) for g in got if not g["common"]]
        if blocks:
            sums[k][:, q.histories] = np.concatenate(blocks, axis=1)
        shorter = counts[k]
    return counts, sums, asked


def _history_sums(own: np.ndarray, histories: int, total: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each history: how many n-grams have a count of 1..K, how many a shorter one with a count of 1..K, the sum of the larger such counts, the sum of all counts."""
    each = lambda x, weight=None: np.bincount(own[x], weight, histories).astype(np.int64)
    return np.stack([*(each(total == r) for r in range(1, K + 1)), *(each(low == r) for r in range(1, K + 1)), each(low > K, low[low > K]), each(slice(None), total)])


def gram_answers(state: DataFrame, k: int, order: int, buckets: int, history_buckets: int, hot: int) -> DataFrame:
    """batch, bucket, common, counts of the batch's n-grams of order k and sums of its histories in this bucket; a row with the bucket's sums; and partial sums of very common histories, by their bucket (batch -2).
    With the longest n-grams come the very common histories of all orders that each batch has, by their bucket; those rows have no counts."""
    kinds = {"bucket": pa.int64(), "batch": pa.int64(), "common": pa.bool_(), "words": pa.binary(), "many": pa.binary(), "last": pa.binary(), "n": pa.binary(), "low": pa.binary()}

    def ask(found):
        for b in found:
            for row in b.to_pylist():
                x = Batch(row, k)
                counts, _, asked = _known(x, row, k - 1, buckets, hot)
                shorter = x.counts if k == 2 else counts[k - 1]
                q = asked[k] = _question(x, k, shorter, buckets, hot)
                h_at, (g_at, g_of) = x.histories[k][0], x.grams[k]
                n = np.bincount(g_of[x.training], minlength=len(g_at))
                low = shorter[x.tokens[g_at] if k == 2 else x.grams[k - 1][1][g_at]]
                stops = np.append(0, np.cumsum(q.many))
                rows = []
                for bucket, i, j in _cuts(q.buckets):
                    p = q.grams[stops[i] : stops[j]]
                    rows.append((bucket, row["batch"], False, _packed(_steps(x.words(h_at[q.histories[i:j]], k))), _packed(q.many[i:j]), _packed(x.ids[x.tokens[g_at[p]]]), _packed(n[p]), _packed(low[p])))
                    if len(rows) >= 64:
                        yield _rows(rows, kinds)
                        rows = []
                for bucket, i, j in _cuts(q.common_buckets):
                    p = q.common[i:j]
                    rows.append((bucket, row["batch"], True, _packed(x.words(g_at[p], k, 1)), None, None, _packed(n[p]), _packed(low[p])))
                    if len(rows) >= 64:
                        yield _rows(rows, kinds)
                        rows = []
                if k == order:  # buckets of histories count down from -1
                    words = _common_histories(x, asked)
                    key = _key(words)
                    place = np.argsort(key, kind="stable")
                    rows += [(-1 - h, row["batch"], True, _packed(words[:, place[i:j]]), None, None, None, None) for h, i, j in _cuts(bucket_of(key[place], history_buckets))]
                yield _rows(rows, kinds)
        release()

    columns = ["batch", "bucket", "common", "counts", "history", "sums", "histories", "partial"]

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        bucket, rows, whole = int(part["bucket"].iloc[0]), [], np.zeros(K + 4, dtype=np.int64)
        if bucket < 0:
            return pd.DataFrame([(b, -1 - bucket, None, None, None, None, w, None) for b, w in zip(part["batch"], part["words"])], columns=columns)
        for common, some in part.groupby("common"):
            words = [_unpacked(w).reshape(k, -1) if common else _from_steps(w, k - 1) for w in some["words"]]
            if not common:
                hkeys, many = np.concatenate([_key(w) for w in words]), _joined(some["many"].tolist())
                histories, place = np.unique(hkeys, return_inverse=True)
                # an n-gram is its history's hash and its word
                keys = mix(np.repeat(hkeys, many) * np.uint64(0x9E3779B97F4A7C15) + _joined(some["last"].tolist()).astype(np.uint64))
                stops = np.cumsum([w.shape[1] for w in words])[:-1]
                ends = np.append(0, np.cumsum(many))[np.append(0, np.cumsum([w.shape[1] for w in words]))][1:-1]
            else:
                whole_words = np.concatenate(words, axis=1)
                keys, ends = _key(whole_words), np.cumsum([w.shape[1] for w in words])[:-1]
            at, inverse = _unique(keys)
            total = np.bincount(inverse, _joined(some["n"].tolist()), len(at)).astype(np.int64)
            low = _joined(some["low"].tolist())[at]
            whole += _sums(total)
            seen = np.flatnonzero(total)
            counts = [_packed(total[p]) for p in np.split(inverse, ends)]
            if not common:
                sums = _history_sums(np.repeat(place, many)[at[seen]], len(histories), total[seen], low[seen])
                rows += [(b, bucket, False, c, _packed(sums[:, p]), None, None, None) for b, c, p in zip(some["batch"], counts, np.split(place, stops))]
                continue
            rows += [(b, bucket, True, c, None, None, None, None) for b, c in zip(some["batch"], counts)]
            before = whole_words[:-1, at[seen]]
            before = np.concatenate([np.full((order - k, len(seen)), SHORT, dtype=np.int64), before])
            hkeys = _key(before)
            which, own = _unique(hkeys)
            sums = _history_sums(own, len(which), total[seen], low[seen])
            for h, i, j in _cuts(bucket_of(hkeys[which], history_buckets)):
                rows.append((-2, h, True, None, None, None, _packed(before[:, which[i:j]]), _packed(sums[:, i:j])))
        rows.append((-1, bucket, None, None, None, whole.tolist(), None, None))
        return pd.DataFrame(rows, columns=columns)

    asked = state.mapInArrow(ask, "bucket long, batch long, common boolean, words binary, many binary, last binary, n binary, low binary")
    return stage(asked.groupBy("bucket").applyInPandas(answer, "batch long, bucket long, common boolean, counts binary, history binary, sums array<long>, histories binary, partial binary"), f"grams{k}")


# ---- very common histories ------------------------------------------------------------------------------------------


def _common_histories(x: Batch, asked: dict[int, Question]) -> np.ndarray:
    """Their words, order by order; short ones begin with SHORT."""
    out = []
    for k, q in asked.items():
        words = x.words(x.histories[k][0][q.common_histories], k)
        out.append(np.concatenate([np.full((x.order - k, words.shape[1]), SHORT, dtype=np.int64), words]))
    return np.concatenate(out, axis=1)


def history_answers(asked: list[DataFrame], order: int) -> DataFrame:
    """batch, bucket, sums of the batch's very common histories in this bucket."""

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        asks = part[part["batch"] >= 0]
        some = part[part["batch"] < 0]
        keys = [_key(_unpacked(w).reshape(order - 1, -1)) for w in (*asks["histories"], *some["histories"])]
        known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sizes = np.cumsum([len(k) for k in keys])[:-1]
        places = np.split(inverse, sizes)
        sums = np.zeros((2 * K + 2, len(known)), dtype=np.int64)
        if len(some):
            whole = np.concatenate([_unpacked(p).reshape(2 * K + 2, -1) for p in some["partial"]], axis=1)
            at = np.concatenate(places[len(asks) :])
            for i, row in enumerate(whole):
                sums[i] = np.bincount(at, row, len(known)).astype(np.int64)
        return pd.DataFrame({"batch": asks["batch"], "bucket": part["bucket"].iloc[0], "history": [_packed(sums[:, p]) for p in places[: len(asks)]]})

    return stage(reduce(DataFrame.unionByName, asked).groupBy("bucket").applyInPandas(answer, "batch long, bucket long, history binary"), "histories")


# ---- scores -------------------------------------------------------------------------------------------------------

_SCORES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _log_probabilities(x: Batch, row: dict, uni: Unigrams, d: dict[int, np.ndarray], buckets: int, hot: int) -> np.ndarray:
    """log10 P of every token."""
    counts, all_sums, asked = _known(x, row, x.order, buckets, hot)
    words = _common_histories(x, asked)
    common = np.zeros((2 * K + 2, words.shape[1]), dtype=np.int64)
    blocks = [_unpacked(g["history"]).reshape(2 * K + 2, -1) for g in row["histories"]]
    if blocks:
        common[:, np.argsort(_key(words), kind="stable")] = np.concatenate(blocks, axis=1)
    p, lower_total, r, begin = uni.p(x.counts)[x.tokens], None, np.arange(1, K + 1), 0  # of each token, by the orders so far
    for k in range(2, x.order + 1):
        h_at, h_of = x.histories[k]
        much = asked[k].common_histories
        all_sums[k][:, much] = common[:, begin : begin + len(much)]
        begin += len(much)
        few, low, big, c = np.split(all_sums[k], [K, 2 * K, 2 * K + 1])
        big, c = big[0], c[0]
        left = ((r * (1 - d[k][1 : K + 1]))[:, None] * few).sum(0)
        plain = left <= 1e-12 * np.maximum(c, 1)
        total = np.where(plain, c + 1.0, c)
        left = np.where(plain, 1.0, left) / np.maximum(total, 1)
        # what the shorter history gives to the words seen after this one
        shorter = uni.total if k == 2 else lower_total[x.histories[k - 1][1][h_at]]
        mass = ((r * d[k - 1][1 : K + 1])[:, None] * low).sum(0) + big
        alpha = np.where(c > 0, left / np.maximum(1 - mass / np.maximum(shorter, 1), 1e-15), 1.0)
        g_at, g_of = x.grams[k]
        n = counts[k]
        own = h_of[g_at]
        p = np.where(n > 0, d[k][np.minimum(n, K + 1)] * n / np.maximum(total[own], 1), alpha[own] * p[g_at])[g_of]
        lower_total = total
    with np.errstate(divide="ignore"):
        return np.log10(p)


def _word_columns(docs: list, first: np.ndarray, c: np.ndarray, uni: Unigrams) -> list:
    """doc_id, held_out, n_tokens, n_known, train_tokens and base_score of documents; c: the count of each token's word."""
    m = len(docs)
    of = np.repeat(np.arange(m), np.diff(first))
    return [docs, [held_out(i) for i in docs], np.diff(first), np.bincount(of, c > 0, m).astype(np.int64), np.full(m, uni.tokens), np.bincount(of, uni.base(c), m)]


def _words(docs: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame, Unigrams, int, int]:
    """Batches, the answers about their words, the sums of these, the number of tokens, and that of partitions."""
    batches = batches_of(docs)
    entries, tokens = batches.agg(F.coalesce(F.sum("n_vocab"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = word_answers(batches, max(least, -(-entries // bucket)))
    sums = _added(answers)
    return batches, answers, Unigrams(int(sums[0]), int(sums[1]), _d(sums[2:]), sums[2:]), tokens, least


def word_counts(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The columns of score_documents that words alone tell, without n-grams: all but the score."""
    batches, answers, uni, _, _ = _words(docs, bucket)
    kinds = {k: t for k, t in _SCORES.items() if k != "score"}

    def run(found):
        for b in found:
            for row in b.to_pylist():
                counts = _joined([g["counts"] for g in row["words"]])
                columns = _word_columns(row["docs"], _unpacked(row["first"]), counts[_unpacked(row["tokens"])], uni)
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(columns, kinds.values())], names=list(kinds))
        release()

    whole = batches.select("batch", "docs", "first", "tokens").join(_gathered(answers, "words", "counts"), "batch")
    return whole.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double")


def score_documents(docs: DataFrame, order: int = ORDER, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    batches, answers1, uni, tokens, least = _words(docs, bucket)
    d = {1: uni.d}
    state = numbered(batches, answers1, least)
    discard(batches, answers1)
    asked, buckets = [], max(2 * least, -(-tokens // bucket))
    for k in range(2, order + 1):
        answers = gram_answers(state, k, order, buckets, least, hot)
        d[k] = _d(_added(answers)[2:])
        known, histories = _gathered(answers.where("counts is not null"), f"grams{k}", "common", "counts", "history"), answers.where("histories is not null").select("bucket", "batch", "histories", "partial")
        if k < order:
            # written one by one, so that never more than one table of answers and one shuffle are there beside the batches
            asked.append(stage(histories, "partial"))
            known = dealt(known, f"grams{k}", least).hint("merge")
            discard(answers)
        state = state.join(known, "batch")
    sums = history_answers([*asked, histories], order)
    discard(*asked)
    whole = state.join(_gathered(sums, "histories", "history"), "batch")

    def run(found):
        for b in found:
            for row in b.to_pylist():
                x = Batch(row, order)
                log = _log_probabilities(x, row, uni, d, buckets, hot)
                columns = _word_columns(x.docs, x.first, x.counts[x.tokens], uni)
                docs_ = np.repeat(np.arange(len(x.docs)), np.diff(x.first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, t) for a, t in zip((*columns, np.bincount(docs_, log, len(x.docs))), _SCORES.values())],
                    names=list(_SCORES),
                )
        release()

    return whole.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
