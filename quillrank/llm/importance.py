"""Importance resampling towards a target by hashed n-gram weights.

A document's weight is the sum of its features' gains: how much more often a
bucket of hashed n-grams occurs in the target than in the corpus. Its score adds
Gumbel noise drawn from its id, so that the highest scores are a draw without
replacement, with odds by weight.

The draw is an external merge. Scores are cut into ranges at quantiles; the rows
of each are counted, and ranges behind the one in which the draw count falls are
not read again. Each partition's eligible rows become sorted runs, one a range,
and a range's runs are merged by a tournament tree that unpacks a block of a run
at a time and stops at the exact count. Ranks follow from the counts of the ranges
before. Rows that agree in all that orders them travel as one entry with a count,
so rows that share an id, or repeat, cost an entry a run.

Quantiles are estimated and only steer the ranges' sizes. A range holds the rows
of one score at least.

Cases: null text has no features and weight 0; a null id is spelled '' in the
noise and comes last among ties; documents with too few words are scored and not
drawn; rows that agree in id, features and weight are given ranks one after the
other; further columns are ignored; an empty corpus gives an empty result, an empty
target is one without counts.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm import textnum as tn
from quillrank.llm.store import scratch, shuffle_parts, written

ORDER, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Rows of a score range, and most ranges: their cuts are what tasks are sent.
RANGE_ROWS, MOST_RANGES = 50_000, 1 << 15
#: Rows that a task holds before it sorts them into runs.
RUN_ROWS = 1 << 18
#: Entries of a run that a merge holds at once.
BLOCK = 4096
#: Rows that one merged entry is spread out to at most, and of a stretch of text.
SPREAD, STRETCH = 10_000, 1 << 20
#: What separates words, and capitals in lower case, byte by byte.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_ENTRY = ("score", "absent", "doc_id", "weight", "n_features", "n")


def _stretches(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a stretch of it at a time."""
    raw, at = raw.translate(_PLAIN), 0
    while at < len(raw):
        end = raw.find(b" ", at + STRETCH)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def buckets_of(raw: bytes, order: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, the buckets of the n-grams that end in them), by stretches."""
    tail: list[bytes] = []
    for words in _stretches(raw):
        both, grams = tail + words, words
        for n in range(2, order + 1):
            first = max(len(tail) - n + 1, 0)
            grams = grams + [b" ".join(both[i : i + n]) for i in range(first, len(both) - n + 1)]
        yield len(words), np.fromiter(map(crc32, grams), np.uint32, len(grams)) % np.uint32(buckets)
        tail = both[-(order - 1) :] if order > 1 else []


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[bytes]:
    for x in batch.column(at):  # one text at a time
        yield (x.as_py() or "").encode()


def feature_counts(texts: DataFrame, text_col: str, order: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts: a row a bucket and task is
    moved, a row a bucket collected."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for raw in _texts(b, 0):
                for _, found in buckets_of(raw, order, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    got = texts.select(F.col(text_col).alias("text")).mapInArrow(tn.trimmed(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in got:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, one
    added to every count."""
    k, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda a, b: (float(b + 1) * float(s + k)) / (float(a + 1) * float(t + k))
    return np.array([math.floor(1000 * math.log(ratio(int(a), int(b)))) for a, b in zip(corpus, target)], np.int64)


def weighed(docs: DataFrame, table, order: int, buckets: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight) by the broadcast table of gains."""

    def run(batches):
        own = table.value
        for b in batches:
            rows = np.zeros((b.num_rows, 3), np.int64)
            for i, raw in enumerate(_texts(b, 1)):
                for n, found in buckets_of(raw, order, buckets):
                    rows[i] += (len(found), n, own[found].sum())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in rows.T.copy()]], ["doc_id", "n_features", "n_words", "weight"])

    return docs.mapInArrow(tn.trimmed(run), "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


class Run:
    """A sorted run of packed entries, read a block at a time."""

    def __init__(self, body: bytes):
        self.rows, self.next, self.block, self.at = np.frombuffer(body, "<i8").reshape(-1, len(_ENTRY)), 0, [], 0
        self.refill()

    def refill(self) -> None:
        part = self.rows[self.next : self.next + BLOCK]
        self.next += len(part)
        self.block, self.at = list(map(tuple, part.tolist())), 0

    @property
    def head(self) -> tuple | None:
        return self.block[self.at] if self.at < len(self.block) else None

    def up_to(self, limit: tuple | None) -> list[tuple]:
        """The entries of this block that do not come behind the limit."""
        end = len(self.block) if limit is None else bisect_right(self.block, limit, self.at)
        out, self.at = self.block[self.at : end], end
        if self.at == len(self.block):
            self.refill()
        return out


class Tournament:
    """A tree of losers over sorted runs: the winner gives what is not behind the
    best of those it has beaten, and plays its way up again."""

    def __init__(self, runs: list[Run]):
        self.size = 1 << max(len(runs) - 1, 0).bit_length()
        self.runs = runs + [None] * (self.size - len(runs))
        self.loser = [0] * self.size
        winner = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            first = self.before(a, b)
            winner[node], self.loser[node] = (a, b) if first else (b, a)
        self.champion = winner[1]

    def head(self, i: int) -> tuple | None:
        return None if self.runs[i] is None else self.runs[i].head

    def before(self, a: int, b: int) -> bool:
        x, y = self.head(a), self.head(b)
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self) -> Iterator[list[tuple]]:
        while self.head(self.champion) is not None:
            leaf = (self.champion + self.size) // 2
            rivals, node = [], leaf
            while node:
                rivals.append(self.head(self.loser[node]))
                node //= 2
            limit = min((x for x in rivals if x is not None), default=None)
            # Of equal heads, that of the first run is the champion's: at least one entry comes.
            yield self.runs[self.champion].up_to(limit)
            node = leaf
            while node:
                if self.before(self.loser[node], self.champion):
                    self.loser[node], self.champion = self.champion, self.loser[node]
                node //= 2


def merged(runs: list[bytes], most: int) -> Iterator[tuple[tuple, int, int]]:
    """(entry, rows before it, rows taken of it), until ``most`` rows are taken."""
    done = 0
    for entries in Tournament([Run(x) for x in runs if len(x)]) if runs else ():
        for e in entries:
            n = min(e[-1], most - done)
            if n <= 0:
                return
            yield e, done, n
            done += n


def _range_of(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """0 for the highest scores; cuts ascend."""
    return len(cuts) - np.searchsorted(cuts, score, "right")


def _counted(cuts):
    def run(batches):
        total = np.zeros(len(cuts.value) + 1, np.int64)
        for b in batches:
            total += np.bincount(_range_of(b.column(0).to_numpy(), cuts.value), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["part", "n"])

    return run


def _runs(cuts, last: int):
    """(part, body): the sorted entries of each range up to the last."""

    def sorted_runs(rows: np.ndarray):
        part = _range_of(-rows[:, 0], cuts.value)
        rows, part = rows[part <= last], part[part <= last]
        order = np.lexsort([rows[:, i] for i in (4, 3, 2, 1, 0)])
        rows, part = rows[order], part[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :5] != rows[:-1, :5]).any(axis=1)
        first = np.flatnonzero(new)
        if not len(first):
            return
        rows[first, 5] = np.diff(np.append(first, len(rows)))
        rows, part = rows[first], part[first]
        ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
        starts = np.append(0, ends[:-1])
        parts = pa.array(part[starts].astype(np.int32))
        bodies = pa.array([rows[a:b].astype("<i8").tobytes() for a, b in zip(starts, ends)], pa.binary())
        yield pa.RecordBatch.from_arrays([parts, bodies], ["part", "body"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            ids = b.column(1)
            cols = [-b.column(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), b.column(3).to_numpy(), np.ones(b.num_rows)]
            held.append(np.stack([c.astype(np.int64) for c in cols], axis=1))
            n += b.num_rows
            if n >= RUN_ROWS:
                yield from sorted_runs(np.concatenate(held))
                held, n = [], 0
        if held:
            yield from sorted_runs(np.concatenate(held))

    return run


_DRAWN = "doc_id long, n_features long, weight long, score long, first long, n long"


def _merge(before: dict[int, int], draw: int):
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        start, out = before[part], []
        for (score, absent, doc_id, weight, features, _), ahead, n in merged(group.column("body").to_pylist(), draw - start):
            for lo in range(0, n, SPREAD):
                out.append((None if absent else doc_id, features, weight, -score, start + ahead + lo + 1, min(SPREAD, n - lo)))
        cols = list(zip(*out)) or [()] * 6
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "n_features", "weight", "score", "first", "n"])

    return run


def _spread(entries: DataFrame, rank: Column, parts: int) -> DataFrame:
    """A row for each that an entry stands for."""
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")
    return entries.repartition(parts, "first").select("*", one).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", order: int = ORDER, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document: the rank in
    the draw of ``percent`` per cent of those with enough words, else null."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark, parts = docs.sparkSession, shuffle_parts(docs.sparkSession)
    table = spark.sparkContext.broadcast(gains(feature_counts(docs, "text", order, buckets), feature_counts(target, target_col, order, buckets)))
    with scratch() as tables:
        held = weighed(docs, table, order, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
        held = tables.keep(written(held.withColumn("fit", F.col("n_words") >= least_words).drop("n_words")))
        fit = held.where("fit").select("score", "doc_id", "weight", "n_features")
        count = fit.count()
        draw = percent * count // 100
        ranges = max(1, min(MOST_RANGES, count // RANGE_ROWS))
        probs = [i / ranges for i in range(1, ranges)]
        found = fit.agg(F.percentile_approx("score", probs, 10 * ranges).alias("q")).first()["q"] if probs and draw else []
        cuts = spark.sparkContext.broadcast(np.unique(np.array(found or [], np.int64)))
        sizes = {r["part"]: r["n"] for r in fit.select("score").mapInArrow(_counted(cuts), "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()} if draw else {}
        before, ahead = {}, 0
        for part in sorted(sizes):
            if ahead < draw:
                before[part] = ahead
            ahead += sizes[part]
        last = max(before, default=-1)
        runs = fit.mapInArrow(tn.trimmed(_runs(cuts, last)), "part int, body binary")
        drawn = tables.keep(written(runs.groupBy("part").applyInArrow(_merge(before, draw), _DRAWN)))
    columns = ["doc_id", "n_features", "weight", "score"]
    end = drawn.orderBy(F.desc("first")).first() if draw else None
    none = F.lit(None).cast("long").alias("rank")
    if end is None:
        return held.select(*columns, none)
    same = lambda c: F.col(c).eqNullSafe(F.lit(end[c]).cast("long"))
    equal = same("score") & same("doc_id") & same("weight") & same("n_features")
    left = fit.where(equal).count() - drawn.where(equal).agg(F.sum("n")).first()[0]
    out = _spread(drawn, F.col("first") + F.col("i"), parts).unionAll(held.where(~F.col("fit") | _behind(end)).select(*columns, none))
    if left:
        rest = spark.range(-(-left // SPREAD)).select(*[F.lit(end[c]).cast("long").alias(c) for c in columns], F.col("id").alias("first"), F.least(F.lit(SPREAD).cast("long"), left - F.col("id") * SPREAD).alias("n"))
        out = out.unionAll(_spread(rest, F.lit(None).cast("long"), parts))
    return out


def _behind(end) -> Column:
    """Whether a row comes after the last entry drawn."""
    after, tied = F.col("score") < end["score"], F.col("score") == end["score"]
    absent = F.col("doc_id").isNull()
    own = end["doc_id"]
    after = after | (tied & (absent & F.lit(own is not None) | F.coalesce(F.col("doc_id") > F.lit(own).cast("long"), F.lit(False))))
    tied = tied & F.col("doc_id").eqNullSafe(F.lit(own).cast("long"))
    after = after | (tied & (F.col("weight") > end["weight"]))
    return after | (tied & (F.col("weight") == end["weight"]) & (F.col("n_features") > end["n_features"]))
