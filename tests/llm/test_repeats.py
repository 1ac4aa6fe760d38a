"""Ids and rows that repeat, or are missing."""

import random
from collections import Counter

import numpy as np
import pytest
from common import DOCS, with_extra
from oracle import rows

from quillrank.llm import ann_search, decontaminate, labelled, mixing
from quillrank.llm.queries import QUERIES, SQL


def mixed(spark, data):
    docs = with_extra(spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in data], DOCS))
    return docs, mixing.pareto_mix(docs).collect()


@pytest.mark.parametrize("same_id, same_text", [(None, False), (None, True), (7, True)])
def test_mixing_with_one_id(spark, same_id, same_text):
    data = [(same_id, " ".join(["w"] * 9 + ["x" if same_text else f"x{i}"]), "a") for i in range(1000)] + [(i, "y " * 10, "b") for i in range(2000)]
    docs, out = mixed(spark, data)
    for source_size in (10_000, 20_000):
        own = [r for r in out if r["source_size"] == source_size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5  # half a document
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    again = mixing.pareto_mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixing_as_its_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(4)
    data = [(rng.choice([None, 1, 2, i]), " ".join(["w"] * rng.choice([0, 1, 3, 50, 400])), rng.choice(["a", "a", "b", "c", None])) for i in range(800)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in data], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(SQL["op10_mixing"])
    names = [c[0] for c in want.description]
    got = QUERIES["op10_mixing"](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_inclusion_odds_differ_within_a_source(spark):
    rng = random.Random(5)
    data = [(i, "w " * rng.choice([2, 200]), "a") for i in range(3000)] + [(10_000 + i, "w " * 200, "b") for i in range(3000)]
    _, out = mixed(spark, data)
    mean = {s: np.mean([r["copies"] for r in out if r["size"] == s and r["doc_id"] < 10_000]) for s in (2, 200)}
    assert 0 < mean[2] < 0.5 * mean[200]


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"good text {i}") for i in range(3000)] + [(2, "bad words " * 30_000), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    import pyarrow as pa

    seen = labelled.sample(docs, labels, "toxic", 1, 5, (1, 2), lambda t: {"n": pa.array([len(x) for x in t.to_pylist()], pa.int64())}, "n long")
    assert seen[0].column("n").to_numpy()[seen[1]].tolist() == [len("good text 0"), 300_000, 0] and seen[2] == [0, 1, 1]


def test_nearest_repeated_rows(spark):
    data = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (50, [2.0, 0.0]), (50, [2.0, 0.0])]
    v = with_extra(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in ann_search.nearest(v, v.where("vec_id % 50 = 0"), k=3).collect()]
    lists = Counter((q, r) for q, r, _, _ in got)
    assert lists == {(0, 1): 2, (0, 2): 2, (0, 3): 2, (50, 1): 2, (50, 2): 2, (50, 3): 2}

    def want(own):
        q_id, q = data[own]
        cos = lambda x: float(np.dot(x, q) / np.sqrt(np.dot(x, x)) / np.sqrt(np.dot(q, q)))
        near = sorted((-round(cos(x), 12), i) for j, (i, x) in enumerate(data) if j != own and len(x) == len(q))[:3]
        return [(q_id, n + 1, i, -s) for n, (s, i) in enumerate(near)]

    full = sorted(x for own in (0, 1, 7, 8) for x in want(own))
    assert sorted((q, r, i, round(s, 12)) for q, r, i, s in got) == full


@pytest.mark.parametrize("limits", [(8192, 4096), (16, 4)])
def test_nearest_in_a_crowd(spark, monkeypatch, limits):
    """A third of the rows is one vector, another third a tight cluster."""
    monkeypatch.setattr(ann_search, "ROWS", limits[0])
    monkeypatch.setattr(ann_search, "ASKED", limits[1])
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    x = np.vstack([np.tile(centre, (200, 1)), centre + rng.normal(size=(200, 16)) * 0.01, rng.normal(size=(200, 16))])
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann_search.nearest(v, v.where("vec_id % 20 = 0")).collect()}
    own = np.arange(0, 600, 20)
    want = ann_search.search_everything(np.arange(600), x, own, x[own], 5)
    assert len(got) == 5 * len(own)
    hit = sum(got[int(q[0]), i + 1][0] in ids for q, ids, _ in want for i in range(5))
    assert hit >= 0.97 * 5 * len(own)
    assert [got[0, i][0] for i in range(1, 6)] == [1, 2, 3, 4, 5]  # ties go to the smaller id


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "alpha"), (None, "beta"), (5, "beta")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"], r["near"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (2, ["", "5"], ["", "5"]), 2: (0, [], [])}


def test_lines_with_clashing_columns(spark):
    from pyspark.sql import functions as F

    from quillrank.llm import line_dedup

    rows = [(i, f"own {i}\ncommon", f"s{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("__gone", "__lines", "__edges", "__text", "n_removed")})
    out = line_dedup.remove_boilerplate(df).orderBy("doc_id").collect()
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in out] == [(f"own {i}", 2, 1) for i in range(6)]
    assert all(r[c] == "x" for r in out for c in ("__gone", "__lines", "__edges", "__text"))
