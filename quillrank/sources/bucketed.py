"""Stored tables that a merge rewrites only where it changes them.

Rows lie in buckets by a hash of their key. A merge reads the buckets that new
rows fall into, writes these anew beside the old ones, and leaves all other files
as they are. What a table holds is said by a snapshot, a small file that names the
folder of each bucket; snapshots are numbered, and the highest is the table. A new
one is written aside and renamed to its number, which fails if another writer has
taken it: the merge is then done again over that one. So a reader sees a table
before or after a merge, never between, and a failed merge leaves the table alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillrank.sources import tables
from quillrank.sources.staging import delete, file_system, scratch, written

BUCKETS = 64
#: Times that a merge is done again over a snapshot of another writer.
RETRIES = 20


class Conflict(RuntimeError):
    """Another writer has taken the number of a snapshot."""


@dataclass(frozen=True)
class Snapshot:
    """number; how many buckets; the folder of each bucket with rows; the highest
    id given (0 if the table has none); the columns."""

    number: int
    buckets: int
    folders: dict[int, str]
    top: int
    schema: StructType


def _bucket(keys: tuple[str, ...], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


class Table:
    """A table of tables.POLICY at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.keys, self.keep = tables.POLICY[name]

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> Table:
        """Store first rows, one for each key and with their ids. Buckets should
        be so many that one task can write one."""
        folders, top = self._write(rows, buckets), 0
        if "id" in rows.columns:
            top = self._rows(folders.values(), rows.schema).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        self._commit(Snapshot(0, buckets, folders, top, rows.schema))
        return self

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The last one, or one by its number."""
        fs, folder = file_system(self.spark, f"{self.path}/snapshots")
        if number is None:
            number = max((int(f.getPath().getName()[:-5]) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")), default=None)
            if number is None:
                raise FileNotFoundError(self.path)
        said = json.loads(self.spark.read.text(f"{self.path}/snapshots/{number:012d}.json", wholetext=True).first()[0])
        return Snapshot(number, said["buckets"], {int(b): f for b, f in said["folders"].items()}, said["top"], StructType.fromJson(said["schema"]))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the last snapshot, or of an earlier one."""
        at = self.snapshot(number)
        return self._rows(at.folders.values(), at.schema)

    def merge(self, new: DataFrame) -> Snapshot:
        """Merge new rows by the table's policy, as tables.save does."""
        with scratch():
            one = tables.one_each(new, self.keys)
            one = written(one)  # read again by every try
            for _ in range(RETRIES):
                try:
                    return self._merge(one, self.snapshot())
                except Conflict:
                    continue
        raise Conflict(f"{self.path} changes too often")

    def vacuum(self) -> None:
        """Delete the files that only earlier snapshots name, and these snapshots.
        Nothing may read or merge them meanwhile."""
        at = self.snapshot()
        fs, data = file_system(self.spark, f"{self.path}/data")
        used = set(at.folders.values())
        for made in [f.getPath().getName() for f in fs.listStatus(data)]:
            _, folder = file_system(self.spark, f"{self.path}/data/{made}")
            for own in [f.getPath().getName() for f in fs.listStatus(folder)]:
                if f"{self.path}/data/{made}/{own}" not in used:
                    delete(self.spark, f"{self.path}/data/{made}/{own}")
        for i in range(at.number):
            delete(self.spark, f"{self.path}/snapshots/{i:012d}.json")

    def _merge(self, one: DataFrame, at: Snapshot) -> Snapshot:
        held = one.withColumn("__bucket", _bucket(self.keys, at.buckets))
        touched = sorted(r[0] for r in held.select("__bucket").distinct().collect())  # at most at.buckets
        if not touched:
            return at
        old = self._rows([at.folders[b] for b in touched if b in at.folders], at.schema)
        merged, top = tables.upsert(old, one, self.keys, self.keep), at.top
        if "id" in merged.columns:
            merged = written(merged)
            top += merged.where("id is null").count()
            merged = tables.with_new_ids(merged, self.keys[0], at.top)
        folders = {**at.folders, **self._write(merged, at.buckets)}
        new = Snapshot(at.number + 1, at.buckets, folders, top, at.schema)
        try:
            self._commit(new)
        except Conflict:
            for f in {f for b, f in folders.items() if at.folders.get(b) != f}:
                delete(self.spark, f)
            raise
        return new

    def _rows(self, folders, schema: StructType) -> DataFrame:
        folders = list(folders)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, buckets: int) -> dict[int, str]:
        """Write each bucket by one task; the folder of each that has rows."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        held = rows.withColumn("__bucket", _bucket(self.keys, buckets))
        held.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
        fs, found = file_system(self.spark, folder)
        names = [f.getPath().getName() for f in fs.listStatus(found)]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("__bucket=")}

    def _commit(self, new: Snapshot) -> None:
        said = json.dumps({"buckets": new.buckets, "folders": new.folders, "top": new.top, "schema": new.schema.jsonValue()})
        fs, part = file_system(self.spark, f"{self.path}/snapshots/.{uuid.uuid4().hex}.part")
        _, final = file_system(self.spark, f"{self.path}/snapshots/{new.number:012d}.json")
        out = fs.create(part, False)
        try:
            out.write(bytearray(said.encode()))
            out.close()
            _rename_new(self.spark, part, final)
        finally:
            fs.delete(part, False)


def _rename_new(spark: SparkSession, part, final) -> None:
    """Rename unless the name is taken, in one step of the file system."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        context.rename(part, final, options)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e) or "already exists" in str(e):
            raise Conflict(str(final)) from e
        raise
