"""Connected components by alternating star contraction, all distributed.

Each round lets every node point at the smallest label it can see, then takes
labels of labels; rounds are written to the shared folder, so lineage stays
short. Star centres with many members pass through partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.store import discard, written


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component), the smallest node reachable.

    Every node with an edge to another is returned, the smallest included. Large-star and small-star steps
    alternate until every node points straight at its smallest one.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        # Large star: larger neighbours of a node join its smallest neighbour.
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _smallest(both.unionAll(both.select("a", F.col("a").alias("b"))))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Small star: a node and its smaller neighbours join the smallest of them.
        large = written(large.distinct())
        low = _smallest(large)
        small = large.join(low, "a")
        small = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(low.select("a", F.col("low").alias("b")))
        new = written(small.distinct())
        last, mark = mark, new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            roots = new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
        discard(now)
        discard(large)
        now = new
