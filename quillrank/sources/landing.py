"""Landing of uploaded files: bytes go from task to storage, never through the driver.

Files are rows of a bucketed table (archivo, content). A batch is read on the
executors, and what it accepts is written by them beside the table; the table's next
snapshot then takes all of it at once. A batch that fails leaves the table as it
was, and one that is tried again puts the same rows under the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.sources import files, pdf
from quillrank.sources.bucketed import Table
from quillrank.sources.staging import written

SCHEMA = "archivo string, content binary"


def none(spark: SparkSession) -> DataFrame:
    """No files, to create a table with."""
    return spark.createDataFrame([], SCHEMA)


def land(uploads: DataFrame, table: Table, parser: Callable[[bytes], list[str]] = pdf.pages) -> DataFrame:
    """Store uploads (archivo, content) under the last part of their names and say
    what became of each: (archivo, status), 400 for what is no PDF by name, 422 for
    what has no text or cannot be read, else 200. A name that is refused keeps the
    file it had; of a name that comes twice one file is stored, the same each time."""
    named = uploads.select(F.element_at(F.split(F.replace("archivo", F.lit("\\"), F.lit("/")), "/"), -1).alias("archivo"), "content")
    kept = written(named.withColumn("__row", F.struct(F.sha2("content", 256).alias("h"), F.length("content").alias("n"))))
    # Texts are told by name and bytes, so that contents are not joined.
    said = files.pdf_texts(kept.select(F.struct("archivo", "__row").alias("archivo"), "content"), parser)
    said = written(said.select("archivo.archivo", "archivo.__row", files.upload_status(F.col("archivo.archivo"), F.col("texto")).alias("status")))
    good = said.where("status = 200").select("archivo", "__row").distinct()
    one = good.groupBy("archivo").agg(F.max("__row").alias("__row"))
    table.merge(kept.join(one, ["archivo", "__row"], "left_semi").select("archivo", "content"))
    return said.select("archivo", "status")
