"""Chunks that fit a token window, and hashed lexical embeddings."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.spans import BLOCK, let
from quillrank.functions.text import strip
from quillrank.sources.staging import written

# Fixed value: units end behind . ! ? and at line ends.
UNIT_END = r"(?<=[.!?])\s+|\n+"
_UNIT = re.compile(UNIT_END)
_BLANK = r"(?U)\s+"


def units(text: Column) -> Column:
    """Sentences and lines, stripped, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), UNIT_END), strip), lambda x: x != "")


def window_limit(max_length: int = 128) -> int:
    """Tokens of text in a model's window: two are its own marks."""
    return max(max_length - 2, 16)


def count_words(text: str) -> int:
    return len(text.split())


def pack(parts: list[str], limit: int, count: Callable[[str], int]) -> list[str]:
    """Neighbours joined while the joined text still fits."""
    out: list[str] = []
    for part in parts:
        joined = f"{out[-1]} {part}" if out else part
        if out and count(joined) <= limit:
            out[-1] = joined
        else:
            out.append(part)
    return out


def chunk(text: str | None, limit: int, count: Callable[[str], int] = count_words) -> list[str]:
    """Units packed into chunks; a unit beyond the limit goes in by words."""
    fine = []
    for u in filter(None, (p.strip() for p in _UNIT.split(text or ""))):
        fine += [u] if count(u) <= limit else pack(u.split(), limit, count)
    return pack(fine, limit, count) or [text or ""]


def openings(sizes: Column, limit: int) -> Column:
    """Places (from 0) of the units that open a chunk. sizes: array<struct(head,
    tail)>, the tokens of a unit that opens a chunk and of one behind another.
    Units are taken in blocks, so that arrays that grow are short: linear time."""
    flags = lambda: F.array().cast("array<boolean>")

    def step(acc, x):
        more = (acc["n"] >= 0) & (acc["n"] + x["tail"] <= limit)
        return F.struct(F.when(more, acc["n"] + x["tail"]).otherwise(x["head"]).alias("n"), F.concat(acc["out"], F.array(~more)).alias("out"))

    def block(acc, some):
        got = F.aggregate(some, F.struct(acc["n"].alias("n"), flags().alias("out")), step)
        return let(got, lambda g: F.struct(g["n"].alias("n"), F.concat(acc["out"], F.array(g["out"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda i: F.slice(sizes, i * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(-1).alias("n"), F.array().cast("array<array<boolean>>").alias("out"))
    found = F.flatten(F.aggregate(blocks, start, block, lambda acc: acc["out"]))
    return let(found, lambda f: F.filter(F.sequence(F.lit(0), F.size(f) - 1), lambda i: F.get(f, i)))


def joined(fine: Column, opens: Column) -> Column:
    """The units (u) between one opening and the next, joined by blanks."""
    end = lambda o, i: F.coalesce(F.get(o, i + 1), F.size(fine))
    piece = lambda o, i: F.slice(fine, F.get(o, i) + 1, end(o, i) - F.get(o, i))
    return let(opens, lambda o: F.transform(F.sequence(F.lit(0), F.size(o) - 1), lambda i: F.array_join(F.transform(piece(o, i), lambda x: x["u"]), " ")))


def _packed(fine: Column, limit: int, text: Column) -> Column:
    """Chunks of units array<struct(u, head, tail)>; the text itself if it has none."""
    whole = F.array(F.coalesce(text, F.lit("")))
    return let(fine, lambda f: F.when(F.size(f) > 0, joined(f, openings(f, limit))).otherwise(whole))


def packed(text: Column, limit: int) -> Column:
    """chunk() with words as tokens, as an expression: word counts add up, so a
    running count tells whether a unit still fits."""
    worded = F.transform(units(text), lambda u: F.struct(u.alias("u"), F.split(u, _BLANK).alias("w")))
    piece = lambda w, i: F.slice(w, i * limit + 1, F.lit(limit))
    last = lambda w: F.floor((F.size(w) - 1) / limit).cast("int")
    sized = lambda u, n: F.struct(u.alias("u"), n.alias("head"), n.alias("tail"))
    pieces = lambda w: F.transform(F.sequence(F.lit(0), last(w)), lambda i: sized(F.array_join(piece(w, i), " "), F.size(piece(w, i))))
    fine = F.flatten(F.transform(worded, lambda x: F.when(F.size(x["w"]) <= limit, F.array(sized(x["u"], F.size(x["w"])))).otherwise(pieces(x["w"]))))
    return _packed(fine, limit, text)


def chunks(docs: DataFrame, limit: int | None = None, count: Callable[[str], int] | None = None, key: str = "doc_id", text: str = "texto") -> DataFrame:
    """(key, pos, chunk). Without a counter tokens are words and all stays in
    the JVM; a model's own counter runs in an Arrow UDF, texts in, lists out."""
    limit = limit or window_limit()

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([chunk(t, limit, count) for t in texts.to_pylist()], pa.list_(pa.string()))

    found = packed(F.col(text), limit) if count is None else F.arrow_udf(run, "array<string>")(F.col(text))
    return docs.select(key, found.alias("parts")).select(key, F.posexplode("parts").alias("pos", "chunk"))


def hashed_terms(docs: DataFrame, dim: int = 384, key: str = "doc_id", text: str = "texto") -> DataFrame:
    """Sparse lexical vectors (key, dims, xs) of unit length: token counts in
    buckets by the token's MD5; tokens are runs of letters and digits of any
    script. At most dim entries a row; texts without tokens have no row."""
    tokens = docs.select(key, F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")).alias("t")).where("t <> ''")
    bucket = (F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")
    counts = tokens.groupBy(key, bucket.alias("dim")).agg(F.count("*").cast("double").alias("n"))
    per = counts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dim", "n"))).alias("v"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    return per.select(key, F.col("v.dim").alias("dims"), F.transform("v.n", lambda n: n / F.col("len")).alias("xs"))


def top_scores(offers: DataFrame, docs: DataFrame, k: int, dim: int = 384, block: int = 10_000) -> DataFrame:
    """(offer_id, doc_id, score): per offer a superset of its k best documents of
    those that share a bucket, a few rows per task. Offers go out in blocks of
    checked size and meet each document once, as a matrix product; of documents
    with equal scores the k smallest ids are kept."""
    offers = written(offers.select("offer_id", "dims", "xs"))
    n = offers.count()
    blocks, found = max(1, -(-n // block)), None
    spark = docs.sparkSession
    if blocks > 1:  # texts are turned into terms once
        docs = written(docs.select("doc_id", "dims", "xs"))
    for i in range(blocks):
        part = offers if blocks == 1 else offers.where(F.pmod(F.xxhash64("offer_id"), F.lit(blocks)) == i)
        got = part.select("offer_id", "dims", "xs").toArrow()
        sent = spark.sparkContext.broadcast((got.column("offer_id").to_numpy(), _dense(got.column("dims"), got.column("xs"), dim)))

        def run(batches, sent=sent):
            ids, weights = sent.value
            for b in batches:
                rows = max(1, (1 << 22) // max(1, len(ids)))
                for lo in range(0, b.num_rows, rows):
                    own = b.slice(lo, rows)
                    yield _best_of(ids, own.column(0).to_numpy(), _dense(own.column(1), own.column(2), dim) @ weights.T, k)

        more = docs.select("doc_id", "dims", "xs").mapInArrow(run, "offer_id long, doc_id long, score double")
        found = more if found is None else found.unionAll(more)
    return found


def _dense(dims, xs, dim: int):
    import numpy as np

    if isinstance(dims, pa.ChunkedArray):
        dims, xs = dims.combine_chunks(), xs.combine_chunks()
    out = np.zeros((len(dims), dim))
    row = np.repeat(np.arange(len(dims)), np.diff(dims.offsets.to_numpy()))
    out[row, dims.flatten().to_numpy()] = xs.flatten().to_numpy()
    return out


def _best_of(offers, docs, scores, k: int) -> pa.RecordBatch:
    """Of each column of scores, the rows that can be among the k best once
    scores are rounded to six places."""
    import numpy as np

    cols: list[list] = [[], [], []]
    for j in range(scores.shape[1]):
        s = scores[:, j]
        own = np.flatnonzero(s > 0)
        if len(own) > k:
            own = own[s[own] >= np.partition(s[own], -k)[-k] - 2e-6]
        own = own[np.lexsort((docs[own], -s[own]))]
        new = np.diff(s[own], prepend=np.inf) != 0
        first = np.flatnonzero(new)
        own = own[np.arange(len(own)) - first[np.cumsum(new) - 1] < k] if len(own) else own
        cols[0].append(np.full(len(own), offers[j], np.int64))
        cols[1].append(docs[own])
        cols[2].append(s[own])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0)).cast(t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["offer_id", "doc_id", "score"])


_MODELS: dict = {}


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """The model of that name, loaded on first use, once per Python process."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def lazy(name: str, load: Callable[[], Callable]) -> Callable[[list[str]], list[list[float]]]:
    """An encoder for embed() whose model each worker loads when it first needs it."""
    return lambda texts: loaded(name, load)(texts)


def embed(chunked: DataFrame, encoder: Callable[[list[str]], list[list[float]]], key: str = "doc_id") -> DataFrame:
    """(key, pos, chunk, vec): a dense model as a pluggable encoder of lists of
    texts, one call per Arrow batch; rows come out with unit length."""
    import numpy as np

    def run(texts: pa.Array) -> pa.Array:
        x = np.asarray(encoder(texts.to_pylist()), np.float32)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return pa.array((x / np.where(n == 0, 1, n)).tolist(), pa.list_(pa.float32()))

    return chunked.withColumn("vec", F.arrow_udf(run, "array<float>")(F.col("chunk")))


def centroids(fragments: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, dim, x): the mean of unit rows, not scaled again."""
    return fragments.select(key, F.posexplode(vec).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
