"""Chunks that fit a model's window by the model's own subword tokens.

A vocabulary file gives the counts. Tokens of a joined text do not add up: a word
behind a blank is another token than the same word at the start. But a tokenizer
that splits before blanks gives a text the tokens of its first unit and, of each
further one, those of the unit behind a blank. So every unit is counted twice, as
the head of a chunk and as its tail, and the packing is a running sum: linear in
the text, where counting each joined text anew is not. ``counter`` refuses a
vocabulary for which this does not hold.

Units are counted by one call of the library for each Arrow batch; what splits,
packs and joins texts are expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.spans import let
from quillrank.operators import chunks

#: Bytes of a vocabulary file that are sent to every task, at most.
MOST_BYTES = 64 << 20
#: Units that the library encodes at a time.
AT_ONCE = 1024
_SIZES = "array<struct<head:int,tail:int>>"
#: Joined and apart, these must have the same number of tokens.
_PROBES = ("one", "Two.", "it's", "3,14", "ñandú-é", "(x)", "日本", "a  b\tc", "…", "'s", "́x")


class Counter(NamedTuple):
    """A vocabulary as its file tells it, and the name workers keep it under."""

    name: str
    sent: object

    def tokenizer(self):
        def load():
            from tokenizers import Tokenizer

            found = Tokenizer.from_str(self.sent.value)
            found.encode_special_tokens = True  # their strings in a text are ordinary text
            return found

        return chunks.loaded(self.name, load)

    def count(self, texts: list[str]) -> list[int]:
        known, out = self.tokenizer(), []
        for i in range(0, len(texts), AT_ONCE):
            out += [len(e.ids) for e in known.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
        return out


def counter(spark: SparkSession, path: str) -> Counter:
    """The counter of a vocabulary file in any store that Spark reads."""
    file = spark.read.format("binaryFile").load(path).select("length", "content")
    if file.agg(F.sum("length")).first()[0] > MOST_BYTES:
        raise ValueError(f"{path} is too large to be sent to every task")
    found = Counter(path, spark.sparkContext.broadcast(bytes(file.first()["content"]).decode()))
    apart = found.count([*_PROBES, *[f" {b}" for b in _PROBES]])
    head, tail = dict(zip(_PROBES, apart)), dict(zip(_PROBES, apart[len(_PROBES) :]))
    both = [(a, b) for a in _PROBES for b in _PROBES]
    if found.count([f"{a} {b}" for a, b in both]) != [head[a] + tail[b] for a, b in both]:
        raise ValueError(f"{path} does not split before blanks: count joined texts, by chunks(count=...)")
    return found


def _sized(known: Counter, texts: pa.Array) -> pa.StructArray:
    own = texts.to_pylist()
    n = known.count(own + [f" {x}" for x in own])
    return pa.StructArray.from_arrays([pa.array(n[: len(own)], pa.int32()), pa.array(n[len(own) :], pa.int32())], ["head", "tail"])


def _like(lists: pa.Array, values: pa.Array) -> pa.ListArray:
    """Other values in the same lists; none of them is null."""
    ends = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array([0, *ends.cumsum().tolist()], pa.int32()), values)


def sizes(known: Counter) -> Callable[[Column], Column]:
    """array<string> -> array<struct(head, tail)>."""
    return F.arrow_udf(lambda units: _like(units, _sized(known, units.flatten())), _SIZES)


def word_sizes(known: Counter) -> Callable[[Column], Column]:
    """The same of array<array<string>>."""

    def run(units: pa.Array) -> pa.Array:
        words = units.flatten()
        return _like(units, _like(words, _sized(known, words.flatten())))

    return F.arrow_udf(run, f"array<{_SIZES}>")


def _by_words(unit: Column, counted: Column, limit: int) -> Column:
    """A unit beyond the limit in pieces of whole words."""

    def pieces(words, opens):
        def one(i):
            start, end = F.get(opens, i), F.coalesce(F.get(opens, i + 1), F.size(words))
            rest = F.aggregate(F.slice(counted, start + 2, F.greatest(end - start - 1, F.lit(0))), F.lit(0), lambda n, x: n + x["tail"])
            first = F.get(counted, start)
            return F.struct(F.array_join(F.slice(words, start + 1, end - start), " ").alias("u"), (first["head"] + rest).alias("head"), (first["tail"] + rest).alias("tail"))

        return F.transform(F.sequence(F.lit(0), F.size(opens) - 1), one)

    return let(F.split(unit, chunks._BLANK), lambda words: let(chunks.openings(counted, limit), lambda opens: pieces(words, opens)))


def subword_chunks(docs: DataFrame, known: Counter, limit: int | None = None, key: str = "doc_id", text: str = "texto") -> DataFrame:
    """(key, pos, chunk): as chunks.chunks, with the tokens of a vocabulary. A null
    or blank text is one chunk, itself; a word beyond the limit stays whole."""
    limit = limit or chunks.window_limit()
    held = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), chunks.units(F.col(text)).alias("__units"))
    held = held.withColumn("__sizes", sizes(known)(F.col("__units")))
    long = F.zip_with("__units", "__sizes", lambda u, s: F.when(s["head"] > limit, F.split(u, chunks._BLANK)).otherwise(F.array().cast("array<string>")))
    held = held.withColumn("__words", word_sizes(known)(long))

    def fine(u, i):
        s, counted = F.get("__sizes", i), F.get("__words", i)
        whole = F.array(F.struct(u.alias("u"), s["head"].alias("head"), s["tail"].alias("tail")))
        return F.when(F.size(counted) == 0, whole).otherwise(_by_words(u, counted, limit))

    parts = chunks._packed(F.flatten(F.transform("__units", fine)), limit, F.col("__text"))
    return held.select(F.col("__key").alias(key), F.posexplode(parts).alias("pos", "chunk"))
