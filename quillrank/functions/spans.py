"""Places of pattern matches in a text, in linear time and JVM only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are summed up together: an array that grows by one element is
#: copied each time, so the growing ones are kept short.
BLOCK = 256
_FOUND = "array<struct<start:int,match:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(lengths, state, step, lambda acc: acc["out"])


def matches(text: Column, pattern: str) -> Column:
    """struct(start, match) of all matches, leftmost and apart; start counts
    code points from 0. What split() leaves between them gives their places."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pair = lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))
    pairs = let(hits, lambda h: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(h)), h, pair))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        one = F.array(F.struct(start.alias("start"), x["hit"].alias("match")))
        return F.struct((start + F.length(x["hit"])).alias("at"), F.concat(acc["out"], one).alias("out"))

    def placed(blocks):
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"])))
        state = lambda at: F.struct(at.alias("at"), F.array().cast(_FOUND).alias("out"))
        return F.flatten(F.zip_with(blocks, sums_before(lengths), lambda b, at: F.aggregate(b, state(at), step, lambda acc: acc["out"])))

    last = lambda p: F.floor((F.size(p) - 1) / BLOCK).cast("int")
    blocks = let(pairs, lambda p: F.transform(F.sequence(F.lit(0), last(p)), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK))))
    return F.when(text.rlike(pattern), let(blocks, placed)).otherwise(F.array().cast(_FOUND))
