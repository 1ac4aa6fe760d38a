"""What operators leave in the shared folder: tables that their results read."""

import os

import pytest
from common import corpus, frame

from quillrank.llm import lm_scoring, quality, simhash_dedup, store


def made(spark):
    folder = store._mine(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_only_tables_that_results_read(spark):
    docs = frame(spark, corpus(n=30))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    for run, most in ((lambda: quality.score(docs, quality.fit(docs, labels)), 0), (lambda: lm_scoring.score_corpus(docs), 1), (lambda: simhash_dedup.simhash_groups(docs), 2)):
        before = made(spark)
        out = run()
        left = made(spark) - before
        assert len(left) <= most
        assert out.count() == docs.count()


@pytest.mark.parametrize("many,sent", [(2, 200_000), (2, 0), (10**9, 1)])
def test_fingerprints_of_many_rows(spark, monkeypatch, many, sent):
    """Sent or joined, each row gets its component."""
    monkeypatch.setattr(simhash_dedup, "MANY", many)
    monkeypatch.setattr(simhash_dedup, "SENT", sent)
    texts = ["", None, " ", "\n"] * 10 + corpus(n=20)
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash_dedup.simhash_groups(frame(spark, texts)).collect()}
    assert len(got) == len(texts) and all(got[i] == (0, 0) for i in range(40))
    monkeypatch.undo()
    assert got == {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash_dedup.simhash_groups(frame(spark, texts)).collect()}
