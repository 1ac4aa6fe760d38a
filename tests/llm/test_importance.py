"""Importance resampling against brute force, and the merge by itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from common import corpus, lower, with_extra

from quillrank.llm import importance


def grams(text, order):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, order=1, buckets=10_000, least=20, percent=10, seed=2024):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(place(g) for x in texts for g in grams(x, order)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        n, g = grams(x, order)
        weight = sum(gain[place(y)] for y in g)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def run(spark, docs, target, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = importance.resample(with_extra(df), spark.createDataFrame([(x,) for x in target], "text string"), **how)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("order,rows", [(1, 50_000), (1, 7), (3, 20)])
def test_same_as_brute_force(spark, monkeypatch, order, rows):
    """Whatever the ranges, blocks and stretches."""
    monkeypatch.setattr(importance, "RANGE_ROWS", rows)
    texts = corpus(seed=2, n=90)
    docs, target = list(enumerate(texts)), [texts[3], texts[40], None, "", "ONE of-these"]
    for percent in (10, 37, 100):
        assert run(spark, docs, target, order=order, buckets=500, percent=percent) == brute(docs, target, order, 500, percent=percent)


def test_ids_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(importance, "SPREAD", 3)
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = [(None, a)] * 40 + [(5, b)] * 30 + [(5, a)] * 10 + [(i, b) for i in range(20)] + [(7, None), (None, "short"), (None, "")]
    for percent in (0, 1, 10, 35, 60, 99, 100):
        assert run(spark, docs, [a], percent=percent) == brute(docs, [a], percent=percent)


def test_empty_tables(spark):
    assert run(spark, [], ["x"]) == []
    docs = [(i, "some words " * 15) for i in range(30)]
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, docs[:5], ["some"]) == brute(docs[:5], ["some"])  # draws none


def test_stretches_of_a_very_long_text(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "É", "Zz9", "x" * 40, "-", "::"]) for _ in range(3000))
    for order in (1, 2, 3):
        monkeypatch.setattr(importance, "STRETCH", 100)
        found = list(importance.buckets_of(text.encode(), order, 997))
        n, want = grams(text, order)
        assert sum(x for x, _ in found) == n
        assert sorted(np.concatenate([x for _, x in found]).tolist()) == sorted(zlib.crc32(g.encode()) % 997 for g in want)


def packed(entries):
    return np.array(entries, "<i8").tobytes()


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_tournament(monkeypatch, k):
    monkeypatch.setattr(importance, "BLOCK", 5)
    rng = random.Random(k)
    runs = [sorted((rng.randrange(30), 0, rng.randrange(9), 0, 0, rng.randint(1, 4)) for _ in range(rng.choice([0, 1, 12, 60]))) for _ in range(k)]
    whole = sorted(e for r in runs for e in r)
    total = sum(e[-1] for e in whole)
    for most in (0, 1, total // 2, total, total + 5):
        got = list(importance.merged([packed(r) for r in runs], most))
        taken = [n for _, _, n in got]
        assert sum(taken) == min(most, total) and [b for _, b, _ in got] == [sum(taken[:i]) for i in range(len(taken))]
        assert [e for e, _, _ in got] == whole[: len(got)]


def test_a_merge_reads_no_more_than_it_draws(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 8)
    read, refill = [], importance.Run.refill
    monkeypatch.setattr(importance.Run, "refill", lambda self: (read.append(1), refill(self))[1])
    runs = [packed([(i * 10 + j, 0, i, 0, 0, 1) for i in range(2000)]) for j in range(10)]
    assert sum(n for _, _, n in importance.merged(runs, 100)) == 100
    assert len(read) <= 10 + 100 // 8 + 10  # of 2,500 blocks


def test_gains_grow_towards_the_target(spark):
    docs = [(i, " ".join(["common"] * 25 + (["rare"] * 10 if i % 10 == 0 else []))) for i in range(200)]
    got = run(spark, docs, ["rare " * 3000])
    assert all(r[0] % 10 == 0 for r in got if r[4] is not None)
    assert sum(r[4] is not None for r in got) == 20
