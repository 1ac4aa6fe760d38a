"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are hashed, after scaling to unit length, by floor((a . v + b) / w)
with Gaussian a: a few such numbers make a bucket, several tables hold every
row. A query visits its own bucket and then perturbed ones (a number up or
down by one), in the order of their estimated success: the sum of squared
distances from the query's projections to the cell borders it would cross.
Candidates of all tables are merged and reranked by exact cosine.

Rows and probes meet by a shuffle on (table, bucket). Equal vectors are one
class, which goes through the search once, with as many of its ids as a result
can need; of a bucket that many classes or many queries share, blocks of bounded
size meet. A block keeps each query's best only, so no pairs are emitted.

The first number of probes is set on a bounded sample so that measured recall
reaches a goal above what is asked. What a query then has found tells how many
probes meet a row as near as its last one with that probability, by the normal
law of the projections, and it goes round once more with those not yet done. Queries for which
no number of probes is enough, or which have found too few rows, are held in
blocks against all rows.

Cases: vectors that are null, zero, or hold null or non-finite components, and
rows with a null id, take no part; vectors are compared with those of their own
length; equal scores go to the smaller id; a query's own row is left out once, so
repeated rows are candidates of each other and repeated ids have a list each;
fewer candidates than k are all returned; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.store import broadcast_if_small, scratch, written

K = 5
TABLES, HASHES, CELL = 8, 4, 1.0
SEED = 5
#: Queries sent to all rows at once, rows of the recall sample.
BLOCK, SAMPLE = 20_000, 4_000
#: Queries whose buckets, or scores, are held at once.
QUERIES = 512
#: Classes and queries of one bucket that meet in one block, and entries of a group.
ROWS, ASKED, GROUP = 8192, 4096, 50_000
GOAL = 0.97


class Hashes:
    """The p-stable functions of all tables, from a seed."""

    def __init__(self, dim: int, tables: int = TABLES, hashes: int = HASHES, cell: float = CELL, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dim, hashes))
        self.b = rng.uniform(0, cell, (tables, hashes))
        self.cell = cell
        self.steps = np.array(list(product((0, -1, 1), repeat=hashes)))

    def cells(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and the place within the cell (0 to 1) per function."""
        x = (unit @ self.a[t] + self.b[t]) / self.cell
        low = np.floor(x)
        return low.astype(np.int64), x - low

    def code(self, cells: np.ndarray) -> np.ndarray:
        """One number per bucket; cells of unit vectors are far below 1024."""
        return (cells + 1024) @ (4096 ** np.arange(cells.shape[-1]))

    def probes(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the buckets around each query by estimated success, their
        numbers in steps, and the query's place within its cells."""
        cells, place = self.cells(unit, t)
        cost = np.stack([np.zeros_like(place), place**2, (1 - place) ** 2], 2)
        total = sum(cost[:, j, :][:, np.where(self.steps[:, j] == 0, 0, np.where(self.steps[:, j] < 0, 1, 2))] for j in range(self.steps.shape[1]))
        order = np.argsort(total, axis=1, kind="stable")
        return self.code(cells[:, None, :] + self.steps[order]), order, place

    def needed(self, order: np.ndarray, place: np.ndarray, distance: float, goal: float) -> int | None:
        """Probes with which a row at that distance of one query is met in some
        table with probability goal; None if all of them are too few."""
        spread = max(distance, 1e-9) / self.cell
        below = _normal((np.array([-1.0, 0.0, 1.0, 2.0]) - place[..., None]) / spread)
        step = np.diff(below)  # tables x functions x (down, stay, up)
        met = np.ones(order.shape)
        for j in range(self.steps.shape[1]):
            met *= np.take_along_axis(step[:, j, :], self.steps[order, j] + 1, 1)
        missed = np.prod(1 - np.minimum(np.cumsum(met, 1), 1), axis=0)
        enough = np.flatnonzero(missed <= 1 - goal)
        return int(enough[0]) + 1 if len(enough) else None


def _normal(x: np.ndarray) -> np.ndarray:
    """Distribution function of the normal law, to 1e-7 (Abramowitz, Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x < 0, tail, 1 - tail)


def _clean(ids, vectors: pa.Array):
    """Ids and a matrix of the vectors that take part."""
    lists = vectors.to_pylist()
    good = [i for i, v in enumerate(lists) if v is not None and ids[i] is not None and len(v) and all(x is not None for x in v)]
    if not good:
        return np.empty(0, np.int64), np.empty((0, 0))
    x = np.array([lists[i] for i in good], np.float64)
    keep = np.isfinite(x).all(1) & (np.abs(x).max(1) > 0)
    return np.array([ids[i] for i in good], np.int64)[keep], x[keep]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def search_shard(h: Hashes, ids, x, q_ids, q, k: int, probes: int, goal: float = GOAL):
    """k best (query, row, score) of one shard for each query. Every query
    starts with the same number of probes; its k-th row then tells how many it
    needs, and where no number is enough, or k rows are not found, the whole
    shard is its candidates."""
    norm, q_norm = _norms(x), _norms(q)
    unit, q_unit = x / norm[:, None], q / q_norm[:, None]
    tables = []
    for t in range(len(h.a)):
        codes = h.code(h.cells(unit, t)[0])
        order = np.argsort(codes, kind="stable")
        tables.append((order, codes[order]))
    out = []
    for start in range(0, len(q), QUERIES):
        asked = [h.probes(q_unit[start : start + QUERIES], t) for t in range(len(tables))]
        places = [(np.searchsorted(c, a[0]), np.searchsorted(c, a[0], "right")) for (_, c), a in zip(tables, asked)]
        for i in range(start, min(start + QUERIES, len(q))):
            own = i - start
            seen = np.zeros(len(x), bool)

            def visit(first, last, seen=seen, own=own, places=places):
                for (order, _), (lo, hi) in zip(tables, places):
                    for a, b in zip(lo[own, first:last], hi[own, first:last]):
                        if a < b:
                            seen[order[a:b]] = True
                return np.flatnonzero(seen & (ids != q_ids[i]))

            at = visit(0, probes)
            need = None
            if len(at) >= k:
                kth = np.partition(unit[at] @ q_unit[i], -k)[-k]
                need = h.needed(np.stack([a[1][own] for a in asked]), np.stack([a[2][own] for a in asked]), float(np.sqrt(max(2 - 2 * kth, 0))), goal)
            if need is None:
                at = np.flatnonzero(ids != q_ids[i])
            elif need > probes:
                at = visit(probes, need)
            if len(at) > k:
                near = unit[at] @ q_unit[i]
                at = at[near >= np.partition(near, -k)[-k] - 1e-9]
            if not len(at):
                continue
            # The same sums in the same order for equal vectors, so ties are ties.
            exact = (x[at] * q[i]).sum(1) / (norm[at] * q_norm[i])
            best = np.lexsort((ids[at], -exact))[:k]
            out.append((np.full(len(best), q_ids[i]), ids[at[best]], exact[best]))
    return out


def measured_probes(h: Hashes, x: np.ndarray, k: int, goal: float = GOAL) -> int:
    """Least number of probes with which the sample's own recall reaches goal."""
    ids, most = np.arange(len(x)), len(h.steps)
    if len(x) <= 2 * k:
        return most
    own = np.linspace(0, len(x) - 1, min(100, len(x))).astype(int)
    full = _found(search_everything(ids, x, ids[own], x[own], k))
    n = 8
    while n < most:
        got = _found(search_shard(h, ids, x, ids[own], x[own], k, n))
        if len(full & got) >= goal * len(full):
            return n
        n = max(n + 1, n * 5 // 4)
    return most


def _found(parts) -> set:
    return {(int(a), int(b)) for q, v, _ in parts for a, b in zip(q, v)}


def search_everything(ids, x, q_ids, q, k: int):
    """Brute force, for the sample and for tests."""
    norm, q_norm = _norms(x), _norms(q)
    out = []
    for i in range(len(q)):
        exact = (x * q[i]).sum(1) / (norm * q_norm[i])
        exact[ids == q_ids[i]] = -np.inf
        best = np.lexsort((ids, -exact))[:k]
        best = best[np.isfinite(exact[best])]
        out.append((np.full(len(best), q_ids[i]), ids[best], exact[best]))
    return out


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, k1, k2): what takes part; equal vectors have equal keys."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall(v, fine) & F.exists(v, lambda x: x != 0))
    return rows.select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.reverse(v), F.lit(1)).alias("k2"))


def _by_length(v: pa.Array):
    """(places, matrix) of the vectors of each length."""
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, flat[first[at][:, None] + np.arange(n)]


_HASHES: dict = {}


def _hashes(dim: int) -> Hashes:
    if dim not in _HASHES:
        _HASHES[dim] = Hashes(dim)
    return _HASHES[dim]


def _bucket(dim: int, t: int, codes: np.ndarray) -> np.ndarray:
    """One number per vector length, table and bucket."""
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim * 4096 + t)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _index(batches):
    """(bucket, cls, low, v) of every table."""
    for b in batches:
        for at, x in _by_length(b.column(2)):
            h, unit = _hashes(x.shape[1]), x / _norms(x)[:, None]
            rows = b.take(pa.array(at))
            for t in range(len(h.a)):
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(x.shape[1], t, h.code(h.cells(unit, t)[0]))), *rows.columns], ["bucket", "cls", "low", "v"])


def _probes(batches):
    """(bucket, q, v) of each query's probes in every table, from the n-th before
    which all are done, to the n-th wanted."""
    for b in batches:
        done, n = b.column(2).to_numpy(), b.column(3).to_numpy()
        for at, x in _by_length(b.column(1)):
            h, unit = _hashes(x.shape[1]), x / _norms(x)[:, None]
            for lo in range(0, len(at), QUERIES):
                own = at[lo : lo + QUERIES]
                for t in range(len(h.a)):
                    codes = h.probes(unit[lo : lo + QUERIES], t)[0]
                    place = np.arange(codes.shape[1])
                    wanted = (place >= done[own][:, None]) & (place < n[own][:, None])
                    row = pa.array(own[np.nonzero(wanted)[0]])
                    yield pa.RecordBatch.from_arrays([pa.array(_bucket(x.shape[1], t, codes[wanted])), b.column(0).take(row), b.column(1).take(row)], ["bucket", "q", "v"])


def _needs(goal: float):
    """(q, n) from (q, v, kth): the probes a query needs, 0 where none are enough."""

    def run(batches):
        for b in batches:
            kth, n = b.column(2).to_numpy(zero_copy_only=False), np.zeros(b.num_rows, np.int32)
            for at, x in _by_length(b.column(1)):
                h, unit = _hashes(x.shape[1]), x / _norms(x)[:, None]
                for i, place in enumerate(at):
                    if np.isfinite(kth[place]):
                        asked = [h.probes(unit[i : i + 1], t) for t in range(len(h.a))]
                        found = h.needed(np.stack([a[1][0] for a in asked]), np.stack([a[2][0] for a in asked]), float(np.sqrt(max(2 - 2 * kth[place], 0))), goal)
                        n[place] = found or 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["q", "n"])

    return run


_FOUND = "q long, cls long, low long, score double"


def _best(q, qx, cls, low, x, k: int):
    """Columns of _FOUND: the k best classes of each query, equal scores by low."""
    norm, q_norm = _norms(x), _norms(qx)
    unit, out = x / norm[:, None], [[], [], [], []]
    for lo in range(0, len(q), QUERIES):
        near = unit @ (qx[lo : lo + QUERIES] / q_norm[lo : lo + QUERIES, None]).T
        for i in range(near.shape[1]):
            s = near[:, i]
            at = np.flatnonzero(s >= np.partition(s, -k)[-k] - 1e-9) if len(s) > k else np.arange(len(s))
            # The same sums in the same order for equal vectors, so ties are ties.
            exact = (x[at] * qx[lo + i]).sum(1) / (norm[at] * q_norm[lo + i])
            best = np.lexsort((low[at], -exact))[:k]
            for to, c in zip(out, (np.full(len(best), q[lo + i]), cls[at[best]], low[at[best]], exact[best])):
                to.append(c)
    return [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int64, np.int64, np.float64))]


def _table(cols) -> pa.Table:
    return pa.table({n: pa.array(c) for n, c in zip(("q", "cls", "low", "score"), cols)})


def _meet(k: int):
    """What the queries of a group find in the buckets that they probe."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return _table(_best(np.empty(0), np.empty((0, 1)), None, None, np.empty((0, 1)), k))
        sub, cls, low = (rows.column(c).to_numpy() for c in ("sub", "cls", "low"))
        q_sub, q = asked.column("sub").to_numpy(), asked.column("q").to_numpy()
        v, qv, parts = rows.column("v").combine_chunks(), asked.column("v").combine_chunks(), []
        order, q_order = np.argsort(sub, kind="stable"), np.argsort(q_sub, kind="stable")
        for one in np.intersect1d(sub, q_sub):
            own = order[np.searchsorted(sub[order], one) : np.searchsorted(sub[order], one, "right")]
            own_q = q_order[np.searchsorted(q_sub[q_order], one) : np.searchsorted(q_sub[q_order], one, "right")]
            x, qx = (next(_by_length(a.take(pa.array(i))))[1] for a, i in ((v, own), (qv, own_q)))
            parts.append(_best(q[own_q], qx, cls[own], low[own], x, k))
        return _table([np.concatenate(c) for c in zip(*parts)] if parts else _best(np.empty(0), np.empty((0, 1)), None, None, np.empty((0, 1)), k))

    return run


def _scan(sent, k: int):
    """What a block of queries finds among all of a task's rows."""

    def run(batches):
        q, qv = sent.value
        asked = {x.shape[1]: (q[at], x) for at, x in _by_length(qv)}
        for b in batches:
            cls, low = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, x in _by_length(b.column(2)):
                if x.shape[1] in asked:
                    yield from _table(_best(*asked[x.shape[1]], cls[at], low[at], x, k)).to_batches()

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best classes of each query, each once."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "low")
    one = found.groupBy("q", "cls").agg(F.max("low").alias("low"), F.max("score").alias("score"))
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def probed(classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """_FOUND for queries (q, v, done, n), of their probes from done to n: a shuffle
    on the bucket. Blocks of a bucket that is too large for one meet each with each."""
    kind = dict(classes.dtypes)["v"]
    index = classes.select("cls", "low", "v").mapInArrow(_index, f"bucket long, cls long, low long, v {kind}")
    asked = queries.select("q", "v", F.col("done").cast("int").alias("done"), F.col("n").cast("int").alias("n")).mapInArrow(_probes, f"bucket long, q long, v {kind}")
    sizes = written(index.groupBy("bucket").agg(F.count("*").alias("rows")).join(asked.groupBy("bucket").agg(F.count("*").alias("asked")), "bucket"))
    entries = sizes.agg(F.sum(F.col("rows") + F.col("asked"))).first()[0] or 0
    parts = F.greatest(F.ceil(F.col("rows") / ROWS), F.lit(1)).cast("int"), F.greatest(F.ceil(F.col("asked") / ASKED), F.lit(1)).cast("int")
    # Buckets that no query probes stay at home.
    met = broadcast_if_small(written(sizes.select("bucket", parts[0].alias("r"), parts[1].alias("a"))), sizes.count())
    salt = lambda id, n: F.pmod(F.xxhash64(id), F.col(n)).cast("int")
    each = lambda n, body: F.explode(F.transform(F.sequence(F.lit(0), F.col(n) - 1), body)).alias("sub")
    groups = max(1, -(-int(entries) // GROUP))
    group = F.pmod(F.col("sub"), F.lit(groups)).alias("g")
    rows = index.join(met, "bucket").select(each("a", lambda j: F.xxhash64("bucket", salt("cls", "r"), j)), "cls", "low", "v").select(group, "sub", "cls", "low", "v")
    own = asked.join(met, "bucket").select(each("r", lambda i: F.xxhash64("bucket", i, salt("q", "a"))), "q", "v").select(group, "sub", "q", "v")
    return rows.groupBy("g").cogroup(own.groupBy("g")).applyInArrow(_meet(k), _FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", goal: float = GOAL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each query.
    queries are rows of vectors."""
    spark, more = vectors.sparkSession, k + 1
    with scratch() as tables:
        key = ["k1", "k2"]
        first = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
        held = _usable(vectors, id_col, vec_col).withColumn("nth", first).where(F.col("nth") <= more)
        held = tables.keep(written(held.select(*key, "nth", "id", F.when(F.col("nth") == 1, F.col("v")).alias("v"), F.monotonically_increasing_id().alias("cls"))))
        classes = held.where("nth = 1").select("cls", F.col("id").alias("low"), "v", *key)
        asked = tables.keep(written(_usable(queries, id_col, vec_col).select("id", *key, F.monotonically_increasing_id().alias("a"), "v")))
        own = written(asked.groupBy(*key).agg(F.min_by("v", "a").alias("v"), F.min("a").alias("q")))
        some = classes.orderBy(F.xxhash64("k1")).limit(SAMPLE).select("v").toArrow().column(0)
        if not len(some):
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        x = max((x for _, x in _by_length(some)), key=len)
        start = measured_probes(_hashes(x.shape[1]), x, k, goal)
        near = written(_top(probed(classes, own.withColumn("done", F.lit(0)).withColumn("n", F.lit(start)), more), more))
        last = near.groupBy("q").agg(F.count("*").alias("m"), F.min("score").alias("kth")).where(F.col("m") == more)
        kth = own.join(last, "q", "left").select("q", "v", F.coalesce("kth", F.lit(float("nan"))).alias("kth"))
        need = written(kth.mapInArrow(_needs(goal), "q long, n int").join(own, "q"))
        again = need.where(F.col("n") > start)
        if not again.isEmpty():
            near = written(_top(near.select("q", "cls", "low", "score").unionAll(probed(classes, again.withColumn("done", F.lit(start)), more)), more))
        rest = need.where("n = 0").select("q", "v")
        n = rest.count()
        for i in range(-(-n // BLOCK)):  # about BLOCK queries at a time, each block's result written before the next
            part = rest.where(F.pmod(F.xxhash64("q"), F.lit(-(-n // BLOCK))) == i).toArrow()
            sent = spark.sparkContext.broadcast((part.column("q").to_numpy(), part.column("v").combine_chunks()))
            all_rows = classes.select("cls", "low", "v").mapInArrow(_scan(sent, more), _FOUND)
            near = written(_top(near.select("q", "cls", "low", "score").unionAll(all_rows), more))
        near = tables.keep(near if hasattr(near, "_shared_path") else written(near))
    # From classes back to rows: those of a class that has the query's vector leave out its own row, once.
    ids = held.select(*key, "nth", "id")
    of = near.join(classes.select("cls", *key), "cls").join(ids, key).select("q", "score", *[F.col(c).alias(f"c_{c}") for c in key], F.col("id").alias("vec_id"))
    lists = asked.select("a", F.col("id").alias("query_id"), *key).join(asked.groupBy(*key).agg(F.min("a").alias("q")), key).join(of, "q")
    mine = (F.col("k1") == F.col("c_k1")) & (F.col("k2") == F.col("c_k2")) & (F.col("query_id") == F.col("vec_id"))
    lists = lists.withColumn("mine", mine).withColumn("nth", F.row_number().over(Window.partitionBy("a", "mine").orderBy(F.col("score").desc(), "vec_id")))
    order = Window.partitionBy("a").orderBy(F.col("score").desc(), "vec_id")
    out = lists.where(~(F.col("mine") & (F.col("nth") == 1))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
