"""Streams: new files of a directory as a source, a file a task and epoch as a sink."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.reading import session
from ..types import schema_of


def read_stream(path, like=None, *, spark: SparkSession | None = None, **options) -> DataFrame:
    """Files that arrive below path. The columns are those of what lies there, or of the file `like`."""
    from ..sources.yxdb import headers

    spark = session(spark)
    return spark.readStream.format("yxdb").schema(schema_of(list(headers(os.fspath(like or path))[0].fields))).options(**options).load(os.fspath(path))


def write_stream(df: DataFrame, path, checkpoint, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Appends each epoch's rows below path."""
    session(df.sparkSession)
    return df.writeStream.format("yxdb").options(**options).option("checkpointLocation", os.fspath(checkpoint)).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(os.fspath(path))
