"""Elkan's clustering against plain k-means in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillrank.llm import clustering


def brute(rows, dim, scale, clusters, rounds, seed=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in first[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    per = [sum(d for d, c in found if c == j) for j in range(len(cents))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, per[c], sum(per), name[c]) for (i, _), (d, c) in zip(kept, found)), key=repr)


def run(spark, rows, extra=False, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({n: F.lit("x") for n in ("v", "a", "u", "low", "cluster", "distance", "done")})
    out = clustering.elkan(df, **how)
    return sorted((tuple(r)[:6] for r in out.collect()), key=repr), out


@pytest.mark.parametrize("dim,scale,clusters,rounds,spread", [(3, 4, 5, 3, 3.0), (8, 64, 16, 4, 0.3), (2, 1, 7, 6, 2.0)])
def test_same_as_plain(spark, dim, scale, clusters, rounds, spread):
    rng = random.Random(dim)
    centres = [[rng.uniform(-spread, spread) for _ in range(dim)] for _ in range(clusters)]
    rows = [(i, [x + rng.gauss(0, spread / 4) for x in rng.choice(centres)]) for i in range(400)]
    rows += rows[:20] + [(None, rows[0][1]), (7, None), (8, [1.0]), (9, [float("nan")] * dim), (10, [float("inf")] * dim), (11, [None] * dim)]
    got, out = run(spark, rows, True, dim=dim, scale=scale, clusters=clusters, rounds=rounds)
    assert got == brute(rows, dim, scale, clusters, rounds)
    # Bounds spare distances.
    assert out.agg({"n_distances": "sum"}).first()[0] < 0.8 * len(got) * clusters * (rounds + 1)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.5, -0.5]) for i in range(9)]
    how = dict(dim=2, scale=64, clusters=4, rounds=2)
    assert run(spark, same, **how)[0] == brute(same, 2, 64, 4, 2)
    assert run(spark, same[:2], **how)[0] == brute(same[:2], 2, 64, 4, 2)
    assert run(spark, [], **how)[0] == []


def test_large_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1.0, 3e7, -4e7]) * rng.random(), rng.random()]) for i in range(60)]
    how = dict(dim=2, scale=64, clusters=5, rounds=3)
    assert run(spark, rows, **how)[0] == brute(rows, 2, 64, 5, 3)
    huge = [(1, [1e30, 0.0]), (2, [0.0, 0.0])]
    got = clustering.elkan(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), dim=2, clusters=1, rounds=1).collect()
    assert all(r["distance"] is None for r in got)


def test_bounds_hold_after_moves():
    """Whatever way centroids go, no bound passes the true distance."""
    rng = np.random.default_rng(3)
    x = rng.integers(-30, 30, (500, 4))
    cents = x[:6].tolist()
    a, u, low, before = np.zeros(500, np.int64), np.full(500, np.inf, np.float32), np.zeros((500, 6), np.float32), None
    for _ in range(8):
        geo = clustering.Geometry(cents, before)
        a, u, low, _ = clustering.reassign(x, a, u, low, geo)
        true = ((x[:, None, :] - np.array(cents)[None]) ** 2).sum(-1)
        assert (a == true.argmin(1)).all()
        assert (u.astype(float) ** 2 >= true[np.arange(500), a] * (1 - 1e-12)).all()
        assert (low.astype(float) ** 2 <= true * (1 + 1e-12)).all()
        before, cents = cents, (np.array(cents) + rng.integers(-9, 9, (6, 4))).tolist()
