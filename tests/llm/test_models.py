"""Classifiers, language model, search and mixing."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from common import DOCS, corpus, frame, lower, with_extra, words

from quillrank.llm import ann_search, lm_scoring, mixing, quality, toxicity

MEDIUM = "/root/testdata/sf0.1"


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def agreement(spark, module, label):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    out = module.score(docs, module.fit(docs, labels)).join(labels.selectExpr("doc_id", f"{label} AS y"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= module.THRESHOLD) for r in out)
    assert all(r["held_out"] == held(r["doc_id"], module.MOD, module.HELD) for r in out)
    return [(r["predicted"], r["y"]) for r in out if r["held_out"]]


def test_toxicity_held_out(spark):
    pairs = agreement(spark, toxicity, "toxic")
    found, toxic = sum(p and y for p, y in pairs), sum(y for _, y in pairs)
    wrong, clean = sum(p and not y for p, y in pairs), sum(not y for _, y in pairs)
    assert found / toxic > 0.75 and wrong / clean < 0.03  # about 330 toxic rows to learn from


def test_toxicity_misspelt():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    bad = ["scoundrel", "numbskull", "villainous"]
    texts = [" ".join(word() for _ in range(60)) for _ in range(600)]
    y = [i % 2 for i in range(600)]
    texts = [t + " " + rng.choice(bad) + " " + rng.choice(bad) if v else t for t, v in zip(texts, y)]
    model = toxicity.train(pa.array(texts), y)
    calm = " ".join(word() for _ in range(60))
    z = toxicity.document_logits(pa.array([calm, calm + " scoundrell numbskul", calm + " SCOUNDREL! numbskull."]), *model)
    assert z[1] > z[0] + 1 and z[2] > z[0] + 1


def test_quality_held_out(spark):
    pairs = agreement(spark, quality, "quality")
    assert np.mean([p == y for p, y in pairs]) > 0.9
    assert np.mean([p for p, y in pairs if not y]) < 0.4


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_odd_rows(spark, module):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "!!! ...", "en", "s", 7), (4, "x " * 60000, "en", "s", 120000)]
    docs = with_extra(spark.createDataFrame(rows, DOCS))
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    out = module.score(docs, module.fit(docs, labels)).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    none = module.score(docs, module.fit(docs, labels.where("false"))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert module.score(docs.where("false"), module.fit(docs.where("false"), labels)).count() == 0


def tokens(t):
    return [*words(lower(t)), "\x00end"]


def test_lm_base_and_model(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 40)  # most tokens take the join
    texts = corpus(7) + [" ".join(["one two three four"] * 50)] * 40
    docs = with_extra(frame(spark, texts))
    training = docs.where(lm_scoring.fold(docs["doc_id"], 5) != 1)
    counts = lm_scoring.token_counts(training).cache()
    vocab = lm_scoring.vocabulary(counts, 40)
    assert 0 < len(vocab.keys) <= 40
    c = Counter(x for i, t in enumerate(texts) if not held(i, 5, 1) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    start = lm_scoring.start_model(vocab)
    untrained = {r["doc_id"]: r for r in lm_scoring.score(docs, start, counts).collect()}
    trained = {r["doc_id"]: r for r in lm_scoring.score(docs, lm_scoring.train(training, counts), counts).collect()}
    for i, t in enumerate(texts):
        w = tokens(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = untrained[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i, 5, 1), len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] == pytest.approx(base, rel=1e-4)  # before training the model is the base
        assert trained[i]["base_score"] == pytest.approx(base, abs=1e-6)
    late = [i for i in range(len(texts)) if held(i, 5, 1)]
    assert sum(trained[i]["score"] for i in late) > sum(trained[i]["base_score"] for i in late)


def test_lm_odd_rows(spark):
    rows = [(1, "a B"), (1, "a B"), (None, None), (2, ""), (3, "zz " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r["doc_id"], r["n_tokens"]) for r in lm_scoring.score_corpus(docs).collect()), key=repr)
    assert out == [(1, 3), (1, 3), (2, 1), (3, 4), (None, 1)]
    assert lm_scoring.score_corpus(docs.where("false")).count() == 0


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    vocab = lm_scoring.Vocabulary(10_000, 3000, np.sort(rng.integers(1, 1 << 60, 2000).astype(np.uint64)), np.full(2000, 4.0), np.arange(lm_scoring.TOP))
    model = lm_scoring.start_model(vocab)
    model = model._replace(weights=model.weights + rng.normal(0, 0.3, len(model.weights)).astype(np.float32))
    one = np.zeros(1, np.int64)
    total = 0.0
    for cls in range(lm_scoring.CLASSES + 1):
        e = lm_scoring._Events(np.array([cls]), one, np.array([[5], [lm_scoring.HISTORY + 9], [2 * lm_scoring.HISTORY + 7]]), one + 5, one + 9)
        p, seen, q, _, _ = lm_scoring._probabilities(model.parts(), e, np.array([0]))
        total += p[0, cls] * (q.sum() if len(seen) else 1)
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_training_sorts_no_steps(monkeypatch):
    """Gradients add up without a sort in every step."""
    sorts, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or plain(*a, **k))
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(500)) for _ in range(40)]
    found = Counter(" ".join(texts).split())
    vocab = lm_scoring.Vocabulary(20_040, len(found), np.arange(0, dtype=np.uint64), np.arange(0), np.arange(0))
    out = list(lm_scoring._train_task(lm_scoring.start_model(vocab))([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    assert sum(b.num_rows for b in out) > 1 and len(sorts) < 5


def test_nearest_recall(spark):
    v = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    got = ann_search.nearest(v, v.where("vec_id % 50 = 0")).collect()
    t = v.toArrow()
    ids, x = ann_search._clean(t.column("vec_id").to_pylist(), t.column("embedding").combine_chunks())
    own = ids % 50 == 0
    want = ann_search._found(ann_search.search_everything(ids, x, ids[own], x[own], 5))
    have = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(have & want) / len(want) >= 0.9 and len(got) == len(have) == len(want)
    at = {i: k for k, i in enumerate(ids.tolist())}
    for r in got[:100]:
        a, b = x[at[r["query_id"]]], x[at[r["vec_id"]]]
        assert r["score"] == pytest.approx(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), abs=1e-12)


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [2.0, 0.0]), (50, None), (None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann_search.nearest(v, v.where("vec_id % 50 = 0")).orderBy("rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 7), (0, 3, 6)] and got[0][3] == got[1][3] == 1.0
    assert ann_search.nearest(v.where("false"), v.where("false")).count() == 0
    assert ann_search.nearest(v, v.where("vec_id = 50")).count() == 0


def test_mixing_reaches_targets(spark):
    rng = random.Random(9)
    texts = ["w " * rng.choice([1, 5, 40, 300]) for _ in range(3000)] + [None, "", "  "]
    sources = {i: rng.choice(["a"] * 20 + ["b"] * 6 + ["c", "d", None]) for i in range(len(texts))}
    docs = with_extra(frame(spark, texts, sources))
    out = mixing.pareto_mix(docs).collect()
    again = mixing.pareto_mix(docs.repartition(7)).collect()
    assert sorted(out, key=repr) == sorted(again, key=repr)
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        s = sources[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] and r["size"] == len(words(texts[r["doc_id"]]))
    assert all(r["source_size"] == size[sources[r["doc_id"]]] for r in out)
    order = sorted((s for s in size if s is not None)) + [None]
    weight, total, capped = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s in share if share[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert target[s] == pytest.approx(3 * size[s] if s in capped else share[s])
        assert abs(taken[s] - target[s]) <= 150.5  # half of the largest document
    assert mixing.pareto_mix(docs.where("false")).count() == 0


def test_mixing_without_words(spark):
    out = mixing.pareto_mix(frame(spark, ["", None, " "])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0)] * 3
