"""Chunks and their vectors stored by candidate.

Vectors are made once, when a text comes in. The index is a table bucketed by
cand_id, so that a join on it shuffles the ranking's rows only: chunks and vectors,
which are most of the data, stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.vectors import dot

BUCKETS = 64


def store(parts: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Store parts (cand_id, pos, chunk, vec) as a table of the catalog at a path
    that all executors share; its rows."""
    held = parts.select("cand_id", "pos", "chunk", "vec").repartition(buckets, "cand_id")
    held.write.bucketBy(buckets, "cand_id").sortBy("cand_id", "pos").option("path", path).format("parquet").mode("overwrite").saveAsTable(table)
    return parts.sparkSession.table(table)


def explained(ranked: DataFrame, offers: DataFrame, index: DataFrame) -> DataFrame:
    """ranked (offer_id, cand_id, ...) with extracto: the chunk of the candidate
    that is closest to the offer (offer_id, v), the first on ties, and '' without
    any. Chunks of a pair are compared where the join has put them together."""
    pairs = ranked.select("offer_id", "cand_id").join(offers.select("offer_id", F.col("v").alias("o")), "offer_id")
    met = index.join(pairs, "cand_id").select("cand_id", "offer_id", "pos", "chunk", dot(F.col("vec"), F.col("o")).alias("s"))
    best = met.groupBy("cand_id", "offer_id").agg(F.max_by("chunk", F.struct("s", -F.col("pos"))).alias("extracto"))
    return ranked.join(best, ["cand_id", "offer_id"], "left").withColumn("extracto", F.coalesce("extracto", F.lit("")))
