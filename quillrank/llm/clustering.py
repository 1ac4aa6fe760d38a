"""Centroid clustering with Elkan's bounds, exact in integers.

Vectors become integers, floor(scale * x). Each carries its cluster, an upper
bound u of the distance to its centroid and a lower bound for every centroid.
A round moves the bounds by how far the centroids went and calculates a distance
only where neither u < lower bound nor u < half the distance between the two
centroids rules the other one out. Both tests are strict and bounds are rounded
outwards, so a centroid that could tie is always looked at; distances that are
compared are exact integers, and ties go to the smaller number.

Each round reads the vectors with their bounds from the shared folder and writes
them anew, so a lost executor costs its own tasks only. Sums of a cluster are
gathered per task first: clusters x components rows a task, whatever its size.

Cases: vectors that are null, of another length, or hold a null, NaN or infinite
component take no part and have no row; repeated rows are vectors of their own;
a null vec_id starts no centroid unless others run out; fewer vectors than
clusters give fewer clusters; equal centroids leave the later one empty, which
stays; further columns are ignored; an empty table gives an empty result.
Components beyond 2**27 are reckoned in Python's integers; a distance or sum that
no long can hold is null.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm import textnum as tn
from quillrank.llm.store import discard, scratch, written

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Components up to which squared distances of 64 of them fit into a long.
PLAIN = 1 << 27
_ROOM = 2.0**-50
_STATE = "vec_id long, v array<double>, a int, u float, low array<float>, done long"


def _up(x):
    """The next float32 not below x, which has been rounded as a double."""
    return np.nextafter(np.asarray(x * (1 + _ROOM), np.float32), np.float32(np.inf))


def _down(x):
    return np.maximum(np.nextafter(np.asarray(x * (1 - _ROOM), np.float32), np.float32(-np.inf)), np.float32(0))


def _root(squares) -> np.ndarray:
    """Square roots as doubles, off by a few units in the last place."""
    return np.sqrt(np.asarray(squares, np.float64))


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors that count, as whole doubles."""
    e = F.col(vec_col).cast("array<double>")
    sound = (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < float("inf")))
    whole = F.transform(e, lambda x: x * float(scale) - F.pmod(x * float(scale), F.lit(1.0)))
    return vectors.where(F.col(vec_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(held: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors of the smallest hashes of seed and id; at most ``clusters`` rows."""
    name = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    rows = held.orderBy(F.sha2(name.cast("binary"), 256).asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return [[int(x) for x in r["v"]] for r in rows]


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)


def _whole(column: pa.Array, dim: int, centroids) -> np.ndarray:
    """The vectors as integers: 64 bits where that is enough."""
    x = _matrix(column, dim, np.float64)
    if max(np.abs(x).max(initial=0), max((abs(y) for c in centroids for y in c), default=0)) <= PLAIN:
        return x.astype(np.int64)
    return np.array([[int(y) for y in row] for row in x], object).reshape(len(x), dim)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=1)


class Geometry:
    """Centroids, how far each has moved, and half their distances to each other."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None):
        self.centroids = centroids
        k = len(centroids)
        far = lambda a, b: isqrt(sum((x - y) ** 2 for x, y in zip(a, b)))  # noqa: E731  rounded down to a whole number
        self.half = np.array([[_down(np.float64(far(a, b)) / 2) for b in centroids] for a in centroids], np.float32).reshape(k, k)
        self.moved = None if before is None else np.array([_up(np.float64(far(a, b) + (a != b))) if a != b else 0 for a, b in zip(centroids, before)], np.float32)
        np.fill_diagonal(self.half, np.float32(np.inf))
        self.nearest = self.half.min(axis=1) if k else np.empty(0, np.float32)
        np.fill_diagonal(self.half, 0)


def reassign(x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, geo: Geometry) -> tuple:
    """Nearest centroid of every vector, its bounds and how many distances that
    took. Where a vector's own distance was not needed its upper bound stays loose."""
    cents = np.array(geo.centroids, x.dtype)
    k = len(cents)
    if geo.moved is not None:
        u = _up(u.astype(np.float64) + geo.moved[a])
        low = _down(np.maximum(low.astype(np.float64) - geo.moved, 0))
    took = np.zeros(len(x), np.int64)
    live = np.flatnonzero(~(u < geo.nearest[a]))
    rival = ~(u[live, None] < low[live]) & ~(u[live, None] < geo.half[a[live]])
    rival[np.arange(len(live)), a[live]] = False
    live = live[rival.any(axis=1)]
    # Own distances first, then each rival that the tighter bound leaves.
    best = _squares(x[live], cents[a[live]]) if len(live) else np.empty(0, x.dtype)
    took[live] += 1
    u[live] = _up(_root(best))
    low[live, a[live]] = _down(_root(best))
    for j in range(k):
        own = np.flatnonzero((a[live] != j) & ~(u[live] < low[live, j]) & ~(u[live] < geo.half[a[live], j]))
        if not len(own):
            continue
        at = live[own]
        far = _squares(x[at], cents[j])
        took[at] += 1
        low[at, j] = _down(_root(far))
        wins = (far < best[own]) | ((far == best[own]) & (j < a[at]))
        a[at[wins]], best[own[wins]] = j, far[wins]
        u[at[wins]] = _up(_root(far[wins]))
    return a, u, low, took


def _round(geo: Geometry, dim: int):
    k = len(geo.centroids)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _whole(b.column(1), dim, geo.centroids)
            if b.num_columns == 2:
                a, u, low, done = np.zeros(len(x), np.int64), np.full(len(x), np.inf, np.float32), np.zeros((len(x), k), np.float32), 0
            else:
                a, u, done = (b.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 5))
                a, low = a.astype(np.int64), _matrix(b.column(4), k, np.float32).copy()
            a, u, low, took = reassign(x, a, u, low, geo)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(low.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(a.astype(np.int32)), pa.array(u), bounds, pa.array(took + done)], ["vec_id", "v", "a", "u", "low", "done"])

    return run


def _sums(k: int, dim: int, centroids):
    def run(batches):
        total, n = [[0] * dim for _ in range(k)], [0] * k
        for b in batches:
            x, a = _whole(b.column(0), dim, centroids), b.column(1).to_numpy(zero_copy_only=False)
            for j in np.unique(a):
                own = x[a == j]
                n[j] += len(own)
                total[j] = [s + int(t) for s, t in zip(total[j], own.sum(axis=0))]
        rows = [(j, i, n[j], Decimal(s)) for j in range(k) if n[j] for i, s in enumerate(total[j])]
        cols = list(zip(*rows)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["a", "i", "n", "s"])

    return run


def _moved(state: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """Every centroid with members at their floored mean; clusters x components
    rows are collected, whatever the input."""
    parts = state.select("v", "a").mapInArrow(_sums(len(centroids), dim, centroids), "a int, i int, n long, s decimal(38,0)")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("a", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out[r["a"]][r["i"]] = int(r["s"]) // r["n"]
    return out


def _finish(centroids: list[list[int]], dim: int):
    def run(batches):
        for b in batches:
            x, a = _whole(b.column(1), dim, centroids), b.column(2).to_numpy(zero_copy_only=False)
            far = _squares(x, np.array(centroids, x.dtype)[a]) if len(x) else np.empty(0, np.int64)
            fits = [int(f) if f < 1 << 63 else None for f in far]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fits, pa.int64()), b.column(5)], ["vec_id", "cluster", "distance", "n_distances"])

    return run


def _looked_up(values: list, kind: str) -> Column:
    """The value of each cluster; one literal a cluster."""
    return F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster"))


def elkan(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256
    (of the final centroid's components, joined by commas) and n_distances, how many
    distances the vector's assignments took; clusters x (rounds + 1) without bounds."""
    with scratch() as tables:
        state = written(quantised(vectors, id_col, vec_col, dim, scale))
        centroids, before = first_centroids(state, clusters, seed), None
        for turn in range(rounds + 1):
            geo = Geometry(centroids, before)
            new = written(state.mapInArrow(tn.trimmed(_round(geo, dim)), _STATE))
            discard(state)
            state = new
            if turn < rounds:
                before, centroids = centroids, _moved(state, centroids, dim)
        out = tables.keep(written(state.mapInArrow(tn.trimmed(_finish(centroids, dim)), "vec_id long, cluster int, distance long, n_distances long")))
    k = len(centroids)
    sums = [0] * k
    for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect():
        sums[r["cluster"]] = int(r["s"] or 0)
    fits = lambda n: n if n < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return out.select(
        "vec_id", "cluster", "distance", _looked_up(list(map(fits, sums)) or [0], "long").alias("cluster_inertia"), F.lit(fits(sum(sums))).cast("long").alias("inertia"),
        _looked_up(names or [""], "string").alias("centroid_sha256"), "n_distances",
    )
