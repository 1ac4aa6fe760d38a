"""Streaming intake: documents that land in a folder, merged once each.

An addition to what a batch load does; the merge is the same upsert.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.sources.tables import latest


def texts(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """(archivo, texto, modified) of new files, as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archivo"), F.make_valid_utf8(F.col("content").cast("string")).alias("texto"), F.col("modificationTime").alias("modified"))


def merge_stream(stream: DataFrame, key: str, order: str, merge: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Start a query that hands each batch's last row per key to merge."""
    writer = stream.writeStream.foreachBatch(lambda df, n: merge(latest(df, (key,), order), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
