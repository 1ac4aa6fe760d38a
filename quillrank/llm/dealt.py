"""Joins whose hot keys are dealt over several tasks.

A key of the joined tables gives as many rows as its rows on one side times those
on the other. Keys that give more than PART rows are found by counts that combine
before the shuffle; the rows of the first table are dealt into parts by a hash of
the whole row, and the second one's rows are copied to each of their key's parts. Rows
of hot keys that the second table lacks go nowhere. The first table is read twice.
The least number of rows of a hot key rises with the whole, so that there are at
most MOST of them: their table, of two numbers each, may always be broadcast.

Cases: null keys meet nothing; equal rows of the first table stay in one part; keys
are counted by a 64-bit hash, so a collision only deals a key into more parts; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.store import written

#: Rows that a key gives before it is dealt, and most keys that are.
PART, MOST = 1 << 18, 100_000


def hot_keys(many: DataFrame, few: DataFrame, key: str, part: int) -> DataFrame | None:
    """(_key, _parts): hashes of the hot keys, and into how many parts each goes;
    0 where few has no such key."""
    counted = lambda t, n: t.where(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("_key")).agg(F.count("*").alias(n))
    both = counted(many, "n").join(counted(few, "l"), "_key", "left")
    gives = F.col("n").cast("double") * F.coalesce("l", F.lit(1))
    hot = written(both.select("_key", "n", "l", gives.alias("gives")).where(F.col("gives") > part))
    total = hot.agg(F.sum("gives")).first()[0]
    if total is None:
        return None
    least = max(float(part), total / MOST)
    dealt = F.when(F.col("l").isNull(), 0).otherwise(F.least(F.ceil(F.col("gives") / least), F.col("n"))).cast("int")
    return hot.where(F.col("gives") > least).select("_key", dealt.alias("_parts"))


def join(many: DataFrame, few: DataFrame, key: str, part: int | None = None) -> DataFrame:
    """The inner join of both on key."""
    hot = hot_keys(many, few, key, part or PART)
    if hot is None:
        return many.join(few, key)
    parts = F.greatest(F.coalesce("_parts", F.lit(1)), F.lit(1))
    marked = lambda t: t.withColumn("_key", F.xxhash64(key)).join(F.broadcast(hot), "_key", "left")
    left = marked(many).where("_parts is null or _parts > 0").withColumn("_part", F.pmod(F.xxhash64(*many.columns), parts).cast("int"))
    right = marked(few).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("_key", "_parts").join(right.drop("_key", "_parts"), [key, "_part"]).drop("_part")
