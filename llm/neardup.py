"""Near-duplicate documents by DartMinHash signatures of word shingles, banded joining, and exact verification.

* A document is the set of its runs of five words (its shorter text as a whole, if it has fewer). Documents with equal sets
  collapse to the least doc_id at once.
* DartMinHash: each element owns a plane of weight x rank. It's cut into cells of area one, each of which gets a Poisson(1) number of
  darts, thrown by hashes of the element and the cell; so equal elements throw equal darts in every document. A dart counts if it lands
  under the element's weight. Each dart is hashed to one of K coordinates; a coordinate keeps its dart of least rank. About K log K
  darts are looked at, however many elements there are.
* Bands of ROWS coordinates are hashed to keys. Documents that share a key are candidates: every document of a bucket is held
  against one member of it, the least; so a bucket of n documents gives n - 1 pairs, not n^2. Pairs are made distinct over all bands
  and verified exactly: the Jaccard similarity of the shingle sets is THRESHOLD or more.
* Documents of buckets that hold several components after that are joined exactly by the rarest of their shingles (``across``), without a bound on candidates.
* Links become classes by label propagation with pointer jumping; each step is a table in the shared folder.

Edge cases: null texts are empty. Texts without words are copies of each other. Rows that repeat a doc_id give a row each, in the class of their own
text; different classes of one doc_id may so have one class_id. A null doc_id is a document of its own that never has links (class_id null). An empty table gives
an empty result. Other columns are ignored, or pass through ``first_of_each``, whatever their names. A very long text needs about 100 bytes of memory a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, mix, named, runs_of, slices, stage, windows

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: Documents signed at a time: each throws some 850 darts.
PORTION = 200
#: Links that one file of labels stands for.
LINKS = 200_000
#: Longs of a set's sketch.
SKETCH = 8
#: Cells of DartMinHash that are looked at together.
THROWN = 1 << 18
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all documents, distinct and ascending within each, and where each document's begin (one more at the end)."""
    w = Words(texts)
    n = len(w.off) - 1
    h = w.hashes()
    start, value = windows(w, h, SHINGLE)
    doc = w.doc[start]
    short = np.flatnonzero((w.count < SHINGLE) & (w.count > 0))
    for k in range(1, SHINGLE):
        of = short[w.count[short] == k]
        doc = np.append(doc, of)
        value = np.append(value, runs_of(h, k, 2)[w.first[of]] if len(of) else of.astype(np.uint64))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[fresh], value[fresh]
    return value, np.searchsorted(doc, np.arange(n + 1))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_minhash(elements: np.ndarray, first: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures of k darts for each set of weighted elements (weight 1 where none are given); 0 for empty sets.

    Weights lie in layers [2^v - 1, 2^(v+1) - 1); cell q of layer v spans ranks q / 2^v to (q + 1) / 2^v, so every cell has area one.
    """
    n = len(first) - 1
    out = np.zeros((n, k), dtype=np.uint64)
    weight = np.ones(len(elements)) if weights is None else weights
    doc = np.repeat(np.arange(n), np.diff(first))
    total = np.bincount(doc, weight, n)
    open_ = np.flatnonzero(total > 0)
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)  # ranks up to which darts are thrown
    while len(open_):
        chosen = np.isin(doc, open_) if len(open_) < n else np.ones(len(doc), dtype=bool)
        e, d, w = elements[chosen], doc[chosen], weight[chosen]
        best = np.full(n * k, np.inf)
        for v in range(int(np.log2(1 + w.max())) + 1):
            layer = np.flatnonzero(w > 2.0**v - 1)
            all_cells = np.ceil(reach[d[layer]] * 2.0**v).astype(np.int64)
            # cells that are thrown together: bounds the arrays, however large a set is
            bounds = np.searchsorted(np.cumsum(all_cells), np.arange(THROWN, int(all_cells.sum()) + THROWN, THROWN), side="left")
            for i, j in zip(np.append(0, bounds[:-1] + 1), bounds + 1):
                in_layer, cells = layer[i:j], all_cells[i:j]
                which = np.repeat(in_layer, cells)
                q = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
                seed = mix(e[which] ^ mix(q.astype(np.uint64) * np.uint64(64) + np.uint64(v)))
                many = np.searchsorted(_POISSON, _unit(seed), side="right")
                at = np.repeat(np.arange(len(which)), many)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                dart = mix(seed[at] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                rank = (q[at] + _unit(mix(dart ^ np.uint64(0xA5A5A5A5)))) / 2.0**v
                own = which[at]
                ok = rank <= reach[d[own]]
                if weights is not None:
                    ok &= 2.0**v - 1 + _unit(mix(dart ^ np.uint64(0x5C5C5C5C))) * 2.0**v <= w[own]
                rank, dart, slot = rank[ok], dart[ok], d[own[ok]] * k + (mix(dart[ok] ^ np.uint64(0x3C3C)) % np.uint64(k)).astype(np.int64)
                order = np.lexsort((rank, slot))
                slot, rank, dart = slot[order], rank[order], dart[order]
                head = np.ones(len(slot), dtype=bool)
                head[1:] = slot[1:] != slot[:-1]
                slot, rank, dart = slot[head], rank[head], dart[head]
                less = rank < best[slot]
                best[slot[less]] = rank[less]
                out.reshape(-1)[slot[less]] = dart[less]
        filled = (best < np.inf).reshape(n, k).sum(1)
        open_ = open_[filled[open_] < k]  # a coordinate without a dart: look further
        reach[open_] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    n = len(signatures)
    s = signatures.reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, i])
    return key.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text, which tells rows that share a doc_id apart), same (a digest of the shingle set), n, keys (one a band), staged."""

    def run(batches):
        for b in (c.slice(i, PORTION) for c in slices(batches) for i in range(0, c.num_rows, PORTION)):
            elements, first = shingles(b.column(1))
            n = len(first) - 1
            keys = band_keys(dart_minhash(elements, first, BANDS * ROWS), BANDS, ROWS)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(0x77)))])
            other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(0x99)))])
            same = np.column_stack([sums[first[1:]] - sums[first[:-1]], other[first[1:]] - other[first[:-1]]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([x.tobytes() for x in same], pa.binary()), pa.array(np.diff(first).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))],
                names=["doc_id", "mark", "same", "n", "keys"],
            )

    return stage(docs.select("doc_id", "text", "mark").mapInArrow(run, "doc_id long, mark long, same binary, n int, keys array<long>"), "signatures")


def parities(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SKETCH longs for each set: each element turns over one of their bits."""
    n, bits = len(first) - 1, 64 * SKETCH
    doc = np.repeat(np.arange(n), np.diff(first))
    odd = np.bincount(doc * bits + (mix(elements ^ np.uint64(0x55)) % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, SKETCH)


def sets(docs: DataFrame) -> DataFrame:
    """tid, set (the sorted shingle hashes as bytes) and sketch (parities) of docs (tid, text)."""

    def run(batches):
        for b in (c.slice(i, PORTION) for c in slices(batches) for i in range(0, c.num_rows, PORTION)):
            elements, first = shingles(b.column(1))
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * SKETCH), pa.array(parities(elements, first).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([elements[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary()), sketch], names=["tid", "set", "sketch"])

    return docs.select("tid", "text").mapInArrow(run, "tid long, set binary, sketch array<long>")


def verified(pairs: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of threshold or more."""
    left = known.select(F.col("tid").alias("a"), F.col("set").alias("sa"))
    right = known.select(F.col("tid").alias("b"), F.col("set").alias("sb"))

    def run(batches):
        for x in batches:
            ok = []
            for p, q in zip(x.column(2), x.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (p, q))
                small, large = sorted((p, q), key=len)
                if len(small) < threshold * len(large):
                    ok.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                ok.append(both >= threshold * (len(p) + len(q) - both))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """id, label (the least id of its component) of every id in links (a, b). Staged."""
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    parts = 1 + both.count() // LINKS  # what few links make isn't written in a file a shuffle partition
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("label")).withColumnRenamed("a", "id").coalesce(parts), "labels")
    for _ in range(limit):
        # the least label among neighbours, then the label's own label
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = stage(step.join(jump, "label").select("id", F.least("label", "further").alias("label"), "old").coalesce(parts), "labels")
        discard(labels)
        labels = new
        if not labels.where("label != old").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    discard(both)
    return labels.select("id", "label")


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with the label of each text, its own number where it has no link."""
    return members.join(labels.withColumnRenamed("id", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))


def across(texts: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs (a, b), a > b, of texts (tid, label) of different labels that may have a similarity of threshold or more: none that has is left out.

    A prefix-filter join. Shingles have one order for all texts: first those that only texts of one label have, which no pair asked for can share, then
    the rarest. Sets of x and y (x not the larger) with that similarity share c >= t/(1+t) (|x| + |y|) shingles, so their first common one has
    c - 1 others behind it in both: it's in the first |x| - 2t/(1+t) |x| + 1 of x and the first |y| - t |y| + 1 of y. Of what the join finds, sketches leave
    out most that is below the threshold: each element that only one of both sets has turns over one bit, so where more bits differ than
    |x| + |y| - 2c, the sets share too few. So a family of texts that are somewhat alike doesn't give all its pairs.
    """
    # sets are 8-byte hashes one after the other
    size = (F.length("set") / 8).cast("int")
    sets_ = texts.join(known, "tid")
    cells = stage(sets_.select("tid", "label", size.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(F.col("set"), i * 8 + 1, F.lit(8)))).alias("shingle")), "shingles")
    by_label = cells.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c"))
    shared = stage(by_label.groupBy("shingle").agg(F.sum("c").alias("f"), F.max_by("label", "c").alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels"), "shared")
    own = cells.join(shared, "shingle").groupBy("tid", "label", "n").agg(F.array_sort(F.collect_list(F.struct("f", "shingle", "main"))).alias("common"))
    t = threshold
    least = lambda x: F.ceil(x - 1e-6)
    # places from the front, those of one label before them
    own = own.join(known.select("tid", *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH))), "tid")
    sketch = [f"s{i}" for i in range(SKETCH)]
    own = own.withColumn("before", F.col("n") - F.size("common")).withColumn("take", F.col("n") - least(F.col("n") * t) + 1 - F.col("before")).where("take > 0")
    entries = own.select("tid", "label", "n", "before", *sketch, F.posexplode(F.slice("common", F.lit(1), F.col("take").cast("int"))).alias("at", "x"))
    entries = stage(entries.select("tid", "label", "n", *sketch, F.col("x.shingle").alias("shingle"), (F.col("x.main") == F.col("label")).alias("main"), (F.col("n") - F.col("before") - F.col("at")).cast("int").alias("left")), "prefixes")
    discard(cells, shared)
    x = entries.where(F.col("left") >= least(F.col("n") * (2 * t / (1 + t)))).select("shingle", *(F.col(c).alias("x_" + c) for c in ("tid", "label", "n", "main", "left", *sketch)))
    y = entries.select("shingle", *(F.col(c).alias("y_" + c) for c in ("tid", "label", "n", "main", "left", *sketch)))
    both, shared_least = F.col("x_n") + F.col("y_n"), least((F.col("x_n") + F.col("y_n")) * (t / (1 + t)))
    differ = sum((F.bit_count(F.col("x_" + c).bitwiseXOR(F.col("y_" + c))) for c in sketch), F.lit(0))
    fits = (F.struct("x_n", "x_tid") < F.struct("y_n", "y_tid")) & (F.col("x_label") != F.col("y_label")) & (F.col("x_n") >= F.col("y_n") * t - 1e-6) & (F.least("x_left", "y_left") >= shared_least) & (differ <= both - 2 * shared_least)
    # texts of a shingle's main label, which may be very many, aren't held against each other
    pairs = x.where("not x_main").join(y, "shingle").where(fits).unionByName(x.where("x_main").join(y.where("not y_main"), "shingle").where(fits))
    return pairs.select(F.greatest("x_tid", "y_tid").alias("a"), F.least("x_tid", "y_tid").alias("b")).distinct()


def linked(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs (doc_id, text, mark), and of every distinct text: same, text_id (the least doc_id that has it), mark, class_id, label (one for each class). Both staged."""
    found = signed(docs)
    texts = found.where("doc_id is not null").groupBy("same").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    # distinct texts have numbers of their own, as one doc_id may have several
    texts = stage(texts.select(F.monotonically_increasing_id().alias("tid"), "same", F.col("rep.doc_id").alias("text_id"), "rep.mark", "n", "keys"), "distinct")
    members = texts.where("n > 0").select("tid", F.posexplode("keys").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.min("tid").alias("rep")).where("m > 1")
    members = stage(members.join(buckets, ["band", "key"]), "members")
    needed = texts.join(members.select("tid").distinct(), "tid").select("tid", F.col("text_id").alias("doc_id"), "mark")
    # rows that repeat a text under one doc_id are one
    known = stage(sets(docs.join(needed, ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(F.first("tid").alias("tid"), F.first("text").alias("text"))), "sets")
    tried = stage(members.where("tid != rep").select(F.col("tid").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = stage(verified(tried, known, threshold), "verified")
    labels = components(links)
    # what buckets of several components still hide is found by the join, which needs no bound
    at = labelled(members.where("m > 2"), labels)
    split = at.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    open_ = stage(at.join(split, ["band", "key"]).select("tid", "label").distinct(), "open")
    more = stage(across(open_, known, threshold).join(tried, ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        labels = components(links.unionByName(stage(verified(more, known, threshold), "verified")))
    whole = labelled(texts.select("tid", "same", "text_id", "mark"), labels)
    classes = stage(whole.groupBy("label").agg(F.min("text_id").alias("class_id")), "classes")
    # staged, so that the joins with it can be split where very many documents share a text
    return found, stage(whole.join(classes, "label").select("same", "text_id", "mark", "class_id", "label"), "classes")


def _marked(docs: DataFrame, *more) -> DataFrame:
    return docs.select(named("doc_id").cast("long").alias("doc_id"), named("text").alias("text"), F.xxhash64(F.coalesce(named("text"), F.lit(""))).alias("mark"), *more)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of those linked to it, directly or over others), text_id (the least doc_id with the same shingles)."""
    found, texts = linked(_marked(docs), threshold)
    out = found.where("doc_id is not null").select("doc_id", "same").join(texts, "same").select("doc_id", "class_id", "text_id")
    return out.unionByName(found.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("text_id")))


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class, the one of the least doc_id, with all columns as they are; rows without a doc_id all stay."""
    _, texts = linked(_marked(docs), threshold)
    stay = texts.groupBy("label").agg(F.min(F.struct("text_id", "mark")).alias("rep")).select(F.col("rep.text_id").alias("doc_id"), "rep.mark")
    rows = _marked(docs, F.struct(*map(named, docs.columns)).alias("row")).drop("text")
    one = rows.join(stay, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    return one.select("row.*").unionByName(rows.where("doc_id is null").select("row.*"))
