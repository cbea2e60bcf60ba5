"""Canonical exact digests of documents: Unicode normalisation (NFKC), case and white-space folding, then two 64-bit xxhashes.

Documents with equal digests share a bucket, and inside it canonical bytes are compared: only equal bytes make a class. DataFrame operations
only: normalisation is ICU's, which ships with Spark, called as a SQL function; a text goes through it once.

``fingerprints`` gives doc_id, fingerprint, class_id. ``edited_report`` holds each document against its successor by doc_id and an edited
text. The successor of every id comes from a radix hierarchy of windows, each over a bounded range of ids.

Edge cases: null texts are empty. An empty text has a fingerprint like any other, so empty texts are copies of each other. Rows that repeat a
doc_id keep a row each, in the class of their own text; they have the same next document, and where the next doc_id is repeated, its least text counts.
A null doc_id sorts before all others, as one more id; a class of such rows alone has a null class_id. The only document of a table is its own successor.
A text is one value of a row, of at most 2 GB. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, named, stage

NULL = -(1 << 63)
#: Bits of an id that each level of the hierarchy takes: a window never holds more than 2^20 entries.
LEVELS = (10, 14, 20)


def canonical(text: Column) -> Column:
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.trim(F.regexp_replace(F.lower(F.upper(composed)), r"[\s\x{85}\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits: xxhash64 from two starting points, as 32 hex digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0") for seed in ("a", "b"))))


def successors(ids: DataFrame) -> DataFrame:
    """doc_id (distinct, not null) and next_id: the next larger id, after the largest the smallest."""
    level = ids.select("doc_id").distinct().withColumns({"low": F.col("doc_id"), "key": F.col("doc_id")})
    levels = []
    for bits in LEVELS:
        level = level.select("key", "low", F.shiftright("key", bits).alias("up"))
        levels.append(level.withColumn("next", F.lead("low").over(W.partitionBy("up").orderBy("key"))))
        level = level.groupBy("up").agg(F.min("low").alias("low")).withColumnRenamed("up", "key")
    # what is left of 64 bits makes at most 2^20 rows: one window in order
    top = level.select("key", "low", F.coalesce(F.lead("low").over(W.orderBy("key")), F.first("low").over(W.orderBy("key"))).alias("next"))
    for lower in reversed(levels):
        top = lower.join(top.select(F.col("key").alias("up"), F.col("next").alias("beyond")), "up").select("key", "low", F.coalesce("next", "beyond").alias("next"))
    return top.select(F.col("key").alias("doc_id"), F.col("next").alias("next_id"))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, and mark, a hash of the text that tells rows with one doc_id apart."""
    rows = docs.select(named("doc_id").cast("long").alias("doc_id"), F.coalesce(named("text"), F.lit("")).alias("text"))
    return rows.withColumn("mark", F.xxhash64("text"))


def canonical_texts(rows: DataFrame) -> DataFrame:
    """doc_id, mark, n_chars, canon, fingerprint, key (a third hash; with the fingerprint it names a canonical text). Staged: texts are normalised once."""
    canon = rows.select("doc_id", "mark", F.length("text").cast("long").alias("n_chars"), canonical(F.col("text")).alias("canon"))
    return stage(canon.withColumns({"fingerprint": digest(F.col("canon")), "key": F.xxhash64(F.lit("c"), "canon")}), "canonical")


def classes(texts: DataFrame) -> DataFrame:
    """fingerprint, key and class_id (the least doc_id) of every distinct canonical text of texts (doc_id, canon, fingerprint, key).

    Within equal fingerprints the bytes are compared, as parts of the grouping key; copies collapse before the shuffle.
    """
    return texts.groupBy("fingerprint", "canon", "key").agg(F.min("doc_id").alias("class_id")).select("fingerprint", "key", "class_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, class_id of every document."""
    texts = canonical_texts(texts_of(docs))
    # staged, so that both sides of the join are dealt out anew and Spark can split a text that very many documents share
    names = stage(classes(texts), "classes")
    return texts.select("doc_id", "fingerprint", "key").join(names, ["fingerprint", "key"]).select("doc_id", "fingerprint", "class_id")


def edited_report(docs: DataFrame) -> DataFrame:
    """Each document, its edited text (the last quarter replaced by the start of the next document) and the likeness of fingerprints."""
    rows = texts_of(docs)
    canon = canonical_texts(rows)
    names = stage(classes(canon), "classes")
    prints = canon.select("doc_id", "mark", "n_chars", "fingerprint", "key").distinct().join(names, ["fingerprint", "key"])
    # a null id gets a place before all others
    prints = stage(prints.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL))), "prints")
    discard(canon, names)
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL)))
    ids = stage(prints.groupBy("doc_id").agg(F.min("mark").alias("mark"), F.count(F.lit(1)).alias("n"), F.max(F.floor(F.col("n_chars") / 4)).alias("k")), "ids")
    again = stage(ids.where("n > 1").select("doc_id"), "again")
    # of an id with several texts the least counts as the next document
    least = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "mark")).alias("least")).select("doc_id", F.col("least.mark").alias("least"))
    ids = ids.join(least, "doc_id", "left").select("doc_id", F.coalesce("least", "mark").alias("chosen"), "k")
    # of each next document the prefix that the one before needs, and its fingerprint
    wants = ids.select(F.col("doc_id").alias("before"), "k").join(successors(ids).withColumnRenamed("doc_id", "before"), "before")
    of_next = ids.join(prints, (ids.doc_id == prints.doc_id) & (ids.chosen == prints.mark)).select(ids.doc_id.alias("next_id"), "chosen", F.col("fingerprint").alias("next_print"), F.col("key").alias("next_key"))
    wants = stage(wants.join(of_next, "next_id").select(F.col("next_id").alias("doc_id"), "before", "k", "chosen", "next_print", "next_key"), "wants")
    heads = rows.join(wants, "doc_id").where(F.col("mark") == F.col("chosen"))
    heads = heads.select(F.col("before").alias("doc_id"), F.substring("text", F.lit(1), F.col("k").cast("int")).alias("head"), "next_print", "next_key")
    heads = stage(heads.distinct(), "heads")  # rows that repeat are one next document
    length = F.length("text")
    k = F.floor(length / 4).cast("int")
    out = rows.join(heads, "doc_id").select("doc_id", "mark", F.concat(F.substring("text", F.lit(1), length - k), F.substring("head", F.lit(1), k)).alias("edited"), "next_print", "next_key")
    out = out.withColumn("edited_canon", canonical(F.col("edited")))
    out = out.select("doc_id", "mark", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("edited_canon")).alias("edited_fingerprint"), F.xxhash64(F.lit("c"), "edited_canon").alias("edited_key"), "next_print", "next_key")
    same = lambda a, b: ((F.col("fingerprint") == F.col(a)) & (F.col("key") == F.col(b))).cast("double")
    return out.join(prints, ["doc_id", "mark"]).select(
        F.when(F.col("doc_id") != NULL, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        same("edited_fingerprint", "edited_key").alias("near_edited"), same("next_print", "next_key").alias("near_next"), "class_id",
    )
