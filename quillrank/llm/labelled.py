"""Label folds and bounded training samples, shared by the classifiers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm import textnum as tn
from quillrank.llm.store import written


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; null ids count as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, rows: tuple[int, int], learn, schema: str) -> tuple[pa.Table, np.ndarray, list[int], float]:
    """Features of at most ``rows`` training documents of label 0 and 1: the ones
    first in an order by hash, so reruns agree. An id that repeats is learned from
    once, by its least text, and its label is the greatest. Whole texts of any
    length become features where they lie: learn(text array) gives the columns of
    schema, which are all that is collected. Second, the order of the rows by id (the
    table is left as it came, to spare a copy), third, the labels in that order.
    Last, how far the log odds of label 1 among all labels lie above those of the
    sample. Only ids travel to the documents; bounded by rows, they are broadcast."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(fold(F.col("doc_id"), mod) != held).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    own = [known.where(F.col("y") == y).orderBy(*order).limit(rows[y]).select(F.col("doc_id").cast("long").alias("doc_id"), "y") for y in (0, 1)]
    ids = written(own[0].unionAll(own[1]))
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    one = wanted.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            found = learn(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *found.values()], ["doc_id", "y", *found])

    got = one.select("doc_id", "y", "text").mapInArrow(tn.trimmed(run), f"doc_id long, y int, {schema}").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    y = got.column("y").to_numpy()[order].tolist()
    all_n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    own_n = {v: y.count(v) for v in (0, 1)}
    shift = 0.0
    if all(own_n.values()):
        shift = math.log(all_n[1] / all_n[0]) - math.log(own_n[1] / own_n[0])
    return got.drop_columns(["doc_id", "y"]), order, y, shift

