"""Shared-folder tables, size-checked broadcasts and small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes by Spark's estimate (of files, as they are compressed), that
#: may be broadcast: both are checked.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where driver
    and tasks are one process may it be absent, for a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillrank-"))
    return sc.getCheckpointDir().rstrip("/")


def _mine(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillrank-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    found = sc._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(sc._jsc.hadoopConfiguration()).delete(found, True)


class Scratch:
    """Tables made within a scope, by path."""

    def __init__(self):
        self.made: dict[str, SparkSession] = {}

    def keep(self, table: DataFrame) -> DataFrame:
        """Leave a table that written() made to the scope outside."""
        spark = self.made.pop(table._shared_path)
        if _SCOPES[:-1]:
            _SCOPES[-2].made[table._shared_path] = spark
        return table


_SCOPES: list[Scratch] = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """A scope: at its end the tables that written() made within are deleted,
    unless kept. What is returned from it must not read the others."""
    _SCOPES.append(Scratch())
    try:
        yield _SCOPES[-1]
    finally:
        for path, spark in _SCOPES.pop().made.items():
            _delete(spark, path)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and return a reader over it.

    The reader has no lineage, so a lost executor only costs its own tasks.
    """
    spark = df.sparkSession
    path = f"{_mine(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    if _SCOPES:
        _SCOPES[-1].made[path] = spark
    return out


def discard(table: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    path = table._shared_path
    for scope in _SCOPES:
        scope.made.pop(path, None)
    _delete(table.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete every table that written() made in this application."""
    _delete(spark, _mine(spark))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only where the counted rows, and the bytes they take,
    stay within the limits."""
    if rows > limit or df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
