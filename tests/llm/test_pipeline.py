"""The pipeline's stages, each against brute force on its own input."""

import math
from collections import Counter

import corpus_pipeline
from common import DOCS, with_extra, words
from test_near_copies import roots
from test_text_operators import cleaned, hits

from quillrank.llm import toxicity

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.orderBy("doc_id").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stages, columns, at = dict(corpus_pipeline.STAGES), docs.columns, {}
    now = docs
    for name in stages:
        out = stages[name](spark, now, SMALL).cache()
        assert name == "mixing" or out.columns == columns
        at[name] = (rows(now), rows(out))
        now = out

    before, after = at["toxicity"]
    bad = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r["predicted"]}
    assert bad and after == [r for r in before if r["doc_id"] not in bad]

    before, after = at["line_dedup"]
    want = cleaned([(r["text"], r["source"]) for r in before], 5)
    assert [(r["text"], r["n_chars"]) for r in after] == [(w[2], len(w[2]) if w[1] else r["n_chars"]) for r, w in zip(before, want)]

    before, after = at["simhash_dedup"]
    first = roots([r["text"] for r in before])
    assert after == [r for i, r in enumerate(before) if first[i] == i] and len(after) < len(before)

    before, after = at["decontamination"]
    assert after == [r for r in before if not hits(r["text"], bench)[3]] and len(after) < len(before)

    before, after = at["mixing"]
    size = Counter()
    for r in before:
        size[r["source"]] += len(words(r["text"]))
    taken = Counter()
    for r in after:
        taken[r["source"]] += r["taken"]
        assert r["copies"] > 0 and r["source_size"] == size[r["source"]]
    most = max(len(words(r["text"])) for r in before)
    assert math.isclose(sum(taken.values()), sum(size.values()), rel_tol=0.2)
    assert all(abs(taken[r["source"]] - r["target"]) <= most for r in after)
    assert {r["doc_id"] for r in rows(corpus_pipeline.run(spark, SMALL))} == {r["doc_id"] for r in after}


def test_odd_rows(spark):
    text = "alpha beta gamma delta epsilon"
    data = [(1, text, "en", "a", 30), (1, text, "en", "a", 30), (None, None, None, None, None), (2, "", "en", "b", 0), (3, text, "en", None, 30), (4, "x y z " * 30000, "en", "c", 180000)]
    docs = with_extra(spark.createDataFrame(data, DOCS))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert len(set(out.columns)) == len(out.columns)
        assert name == "mixing" or out.columns == docs.columns
        ids = sorted((r["doc_id"] for r in out.collect()), key=repr)
        assert ids == [1, 2, 4, None] if name == "simhash_dedup" else {1, 3, 4} <= set(ids)
        assert stage(spark, docs.where("false"), SMALL).count() == 0
