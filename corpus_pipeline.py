"""A corpus pipeline: quality filter, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of documents.

Edge cases, as the operators define them: null texts are empty. Each row stands for itself, also where rows share a doc_id or have none: a row goes if it is of
poor quality or a near copy of a row that stays, and rows without a doc_id are never near copies. Without labels nothing is rejected and the mix is even. Extra
columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from llm import mixing, neardup, packing, quality, substrings
from llm.common import table, tuned, work_dir


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier scores 0.3 or more."""
    tuned(spark)
    stats = quality.document_statistics(docs)
    return quality.keep(docs, quality.fit(stats, table(spark, sf_dir, "labels")), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the least doc_id of every class; rows without an id all stay."""
    tuned(spark)
    return neardup.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every window of 20 words that also starts earlier."""
    tuned(spark)
    return substrings.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the targets of clean, low and toxic tokens ask for."""
    return mixing.mixed(docs, mixing.labelled_domains(table(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence of 4096 tokens."""
    tuned(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("substrings", repeated_passages), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs


#: No stage before packing can be told in SQL (a fitted classifier, signatures, a fitted mix): tests hold them against brute force.
ORACLE_SQL = None
