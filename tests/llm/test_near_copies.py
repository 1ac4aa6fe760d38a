"""The pipeline's near copies against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
from common import DOCS, frame, lower, words

from quillrank.llm import near_copies, shingle_sets


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def edited(n=40, copies=4, seed=3):
    rng = random.Random(seed)
    text = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    out = []
    for _ in range(n):
        body = text(rng.choice([3, 12, 60, 150, 300]))
        out.append(" ".join(body))
        for _ in range(copies):
            w = list(body)
            for _ in range(rng.choice([1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(["new", "WORDS", "here"])
            out.append(" ".join(w))
    return [*out, "", None, " \n", "one", "ONE", out[0].upper()]


@pytest.mark.parametrize("hot", [2, 32])
def test_near_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(shingle_sets, "HOT", hot)
    texts = edited()
    want = roots(texts)
    left = corpus_pipeline.drop_near_copies(spark, frame(spark, texts), "")
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(want))


def test_a_large_group_of_near_copies_grows_in_proportion(spark, monkeypatch):
    rng, held, verified = random.Random(5), [], shingle_sets.verified

    def counted(pairs, texts):
        held.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(shingle_sets, "verified", counted)
    body, n = [f"w{i}" for i in range(120)], 600
    texts = [" ".join(f"x{i}" if j == at else w for j, w in enumerate(body)) for i in range(n) for at in [rng.randrange(120)]]
    left = corpus_pipeline.drop_near_copies(spark, frame(spark, texts), "")
    assert [r["doc_id"] for r in left.collect()] == [0]
    assert sum(held) < 20 * n  # of 179,700 pairs


def test_a_passage_of_many_unlike_texts_is_no_key(spark, monkeypatch):
    """Where the counters tell nothing of a shingle's rarity, as in large inputs."""
    monkeypatch.setattr(near_copies, "_levels", lambda docs: np.zeros(near_copies.COUNTERS, np.uint16))
    rng, found, links = random.Random(8), [], shingle_sets.links

    def seen(members, *more):
        found.extend(r["count"] for r in members.groupBy("h").count().collect())
        return links(members, *more)

    monkeypatch.setattr(shingle_sets, "links", seen)
    passage, texts = [f"p{i}" for i in range(40)], []
    for i in range(60):
        body = [f"w{i}x{j}" for j in range(120)]
        body[60:60] = passage
        texts.append(" ".join(body))
    for i in range(0, 60, 7):
        body = texts[i].split()
        body[rng.randrange(160)] = "new"
        texts.append(" ".join(body))
    left = corpus_pipeline.drop_near_copies(spark, frame(spark, texts), "")
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(roots(texts)))
    assert max(found) <= shingle_sets.WIDE


def test_ids_that_repeat_with_other_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    texts = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d + " end"), (4, c), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], DOCS)
    left = [(r["doc_id"], r["text"][0]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(left, key=repr) == sorted([(1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "a"), (None, "a")], key=repr)
