"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics of a text (byte classes, word lengths, distinct words) are standardised and mapped to D cosines of random projections, whose inner
products approximate a Gaussian kernel. Each partition sums its share of the normal equations, and the sums meet by row of the matrix, so
the driver gets one D x D matrix whatever the number of labels. A part of the training labels isn't fitted but
calibrates: scores go to 4,096 bins, and pooling adjacent violators makes their label rates monotone.

Edge cases: null texts count as empty, and empty texts get a score like any other. Repeated rows get a row each; a doc_id labelled twice counts
twice. Null or missing labels teach nothing. Without a training label every score is 0.5, with labels of one class it is that class.
Labels, language, source and doc_id never enter a score. Columns that the input has besides doc_id and text pass through `keep` untouched.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STRETCH, Words, crc_mod, discard, mix, slices, stage

D = 256
BINS = 4096
RIDGE = 1e-3
#: Bytes by class: lower, upper, digit, space, newline, stops, commas, exclamations, bars, odd symbols, brackets and quotes, control, beyond ASCII.
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".", ",;:", "!?", "|", "*#$%&@~^+=<>\\/_", "()[]{}'\"-`")
_CLASS = np.full(256, len(_KINDS), dtype=np.int64)
_CLASS[128:] = len(_KINDS) + 1
for _i, _k in enumerate(_KINDS):
    _CLASS[[ord(c) for c in _k]] = _i
N_CLASS = len(_KINDS) + 2
N_STATS = N_CLASS + 7


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of N_STATS numbers a text."""
    w = Words(texts)
    n = len(w.off) - 1
    size = np.diff(w.off)
    kinds = np.zeros(n * N_CLASS, dtype=np.int64)
    for a in range(0, len(w.data), STRETCH):  # the arrays over bytes are bounded, however long a text is
        part = np.diff(np.clip(w.off, a, a + STRETCH))
        some = np.flatnonzero(part)
        kinds += np.bincount(np.repeat(some * N_CLASS, part[some]) + _CLASS[w.data[a : a + STRETCH]], minlength=n * N_CLASS)
    kinds = kinds.reshape(n, N_CLASS)
    length = (w.end - w.start).astype(float)
    count = np.maximum(w.count, 1)
    mean = np.bincount(w.doc, length, n) / count
    spread = np.sqrt(np.maximum(np.bincount(w.doc, length**2, n) / count - mean**2, 0))
    keys = np.sort(mix(w.hashes()) & ~np.uint64(0xFFFFF) | w.doc.astype(np.uint64))
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[fresh] & np.uint64(0xFFFFF)).astype(np.int64), minlength=n) / count
    last = _CLASS[w.data[w.end - 1]] if len(w.end) else np.empty(0, int)
    odd = np.bincount(w.doc, (last >= 7) & (last <= 9), n) / count
    capital = np.bincount(w.doc, _CLASS[w.data[w.start]] == 1, n) / count if len(w.start) else np.zeros(n)
    return np.column_stack([np.log1p(size), np.log1p(w.count), mean, spread, distinct, odd, capital, np.sqrt(kinds / np.maximum(size, 1)[:, None])])


@dataclasses.dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # of 1 + D features; None: no labels of both classes
    knots: np.ndarray  # raw scores and what they are calibrated to
    rates: np.ndarray
    seed: int = 5

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        rng = np.random.default_rng(self.seed)
        width = np.sqrt(x.shape[1]) * 1.5
        z = np.cos(x @ (rng.standard_normal((x.shape[1], D)) / width) + rng.uniform(0, 2 * np.pi, D)) * np.sqrt(2 / D)
        return np.column_stack([np.ones(len(x)), z])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights if self.weights is not None else np.zeros(len(stats))

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        # a trace of the raw score keeps the order within a flat step
        return np.clip(0.999 * np.interp(raw, self.knots, self.rates) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def isotonic(at: np.ndarray, good: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending places: the centres of the pools and their rates."""
    pools: list[list[float]] = []  # sum of good, of all, of place * all
    for x, g, n in zip(at, good, all_):
        pools.append([g, n, x * n])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: staged, so that texts are read once for learning and scoring."""

    def run(batches):
        for b in slices(batches):
            x = statistics(b.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATS), pa.array(x.ravel()))], names=["doc_id", "x"])

    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>"), "statistics")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, N_STATS)


def _sums(rows: DataFrame, make, width: int) -> dict[int, np.ndarray]:
    """make(x, y) gives a matrix of `width` columns for a batch; each partition sums its own, the sums meet row by row."""

    def partial(batches):
        total = None
        for b in batches:
            if b.num_rows:
                m = make(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(float))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * width), pa.array(total.ravel()))], names=["i", "v"])

    def add(key, part):
        total = np.zeros(width)
        for v in part["v"]:
            total += v
        part = part.iloc[:1].copy()
        part["v"] = [total]
        return part

    return {r["i"]: np.array(r["v"]) for r in rows.select("x", "y").mapInArrow(partial, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>").collect()}


def fit(stats: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> Model:
    """Learn from labels whose crc32(doc_id) modulo folds isn't held_fold; one of the other folds calibrates."""
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"), crc_mod("doc_id", folds).alias("fold")).where(F.col("fold") != held_fold)
    rows = stage(stats.join(known, "doc_id").select("x", "y", "fold"), "training")
    spare = (held_fold + 1) % folds
    first = _sums(rows, lambda x, y: np.array([np.append(x.sum(0), len(x)), np.append((x**2).sum(0), y.sum())]), N_STATS + 1)
    if not first:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), None, np.zeros(1), np.full(1, 0.5))
    n, good = first[0][-1], first[1][-1]
    mean = first[0][:-1] / n
    model = Model(mean, np.sqrt(np.maximum(first[1][:-1] / n - mean**2, 1e-8)), None, np.zeros(1), np.full(1, good / n))
    if 0 < good < n:

        def normal(x, y):
            z = model.features(x)
            return np.column_stack([z.T @ z, z.T @ y])

        sums = _sums(rows.where(F.col("fold") != spare), normal, D + 2)
        if sums:
            a = np.array([sums[i] for i in range(D + 1)])
            solved = dataclasses.replace(model, weights=np.linalg.solve(a[:, :-1] + RIDGE * max(a[0, 0], 1) * np.eye(D + 1) / D, a[:, -1]))

            def bins(x, y):
                at = np.clip((solved.raw(x) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
                return np.array([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS).astype(float)])

            got = _sums(rows.where(F.col("fold") == spare), bins, BINS) or _sums(rows, bins, BINS)
            used = np.flatnonzero(got[1])
            knots, rates = isotonic((used + 0.5) / BINS * 2 - 0.5, got[0][used], got[1][used])
            model = dataclasses.replace(solved, knots=knots, rates=rates)
    discard(rows)
    return model


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of staged statistics."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores `least` or more."""
    def run(batches):
        for b in slices(batches):
            # scores go through the same single precision as staged statistics, so both ways agree
            ok = model.score(statistics(b.column(b.schema.get_field_index("text"))).astype(np.float32).astype(float)) >= least
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
