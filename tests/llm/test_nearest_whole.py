"""Queries that few buckets answer: no rows are left out."""

import numpy as np
import pytest

from quillrank.llm import ann_search


def found(x, own, k=5, probes=None):
    h = ann_search.Hashes(x.shape[1])
    ids = np.arange(len(x))
    n = probes or ann_search.measured_probes(h, x, k)
    got = ann_search._found(ann_search.search_shard(h, ids, x, ids[own], x[own], k, n))
    return got, ann_search._found(ann_search.search_everything(ids, x, ids[own], x[own], k))


def test_fewer_candidates_than_k(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann_search.nearest(v, v).collect()}
    assert got == {(a, b) for a in range(3) for b in range(3) if a != b}


@pytest.mark.parametrize("dim", [4, 16, 64])
def test_query_opposite_to_a_cluster(dim):
    for seed in range(20):
        rng = np.random.default_rng(seed)
        c = rng.normal(size=dim)
        x = np.vstack([-c, c + rng.normal(size=(1000, dim)) * 1e-3])
        got, want = found(x, np.array([0]))
        assert got == want and len(got) == 5


def test_outliers_among_clusters():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 64))
    x = np.vstack([centres[rng.integers(0, 20, 3920)] + rng.normal(size=(3920, 64)) * 0.05, rng.normal(size=(80, 64))])
    got, want = found(x, np.arange(3920, 4000), probes=8)
    assert len(got & want) >= 0.95 * len(want)
