"""The n-gram join and its signatures against brute force, and words that a
polynomial hash cannot tell apart."""

import random
from functools import partial

import numpy as np
import pytest
from common import frame, lower, with_extra, words

from quillrank.llm import lm_scoring, near_copies, ngram_join, shingle_sets, substring_dedup
from quillrank.llm import textnum as tn


def grams(text, n=4):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts, num=85, den=100):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root))]


def edited(seed, sizes=(2, 4, 9, 14, 30, 60, 150, 500), n=30, copies=5):
    rng = random.Random(seed)
    passage, out = [f"p{i}" for i in range(50)], []
    for _ in range(n):
        body = [f"w{rng.randrange(4000)}" for _ in range(rng.choice(sizes))]
        if rng.random() < 0.3:
            at = rng.randrange(len(body))
            body[at:at] = passage
        out.append(" ".join(body))
        for _ in range(copies):
            w = list(body)
            for _ in range(rng.choice([1, 1, 2, 4, 8])):
                at, what = rng.randrange(len(w)), rng.random()
                w[at : at + 1] = [] if what < 0.2 and len(w) > 1 else [w[at], "more"] if what < 0.4 else [rng.choice(["NEW", "Words"])]
            out.append(" ".join(w))
    return [*out, "", None, " \n", "one", "ONE", "a b", out[0].upper(), out[5]]


@pytest.mark.parametrize("hot,sent", [(2, 1 << 21), (32, 0)])
def test_components_are_those_of_all_links(spark, monkeypatch, hot, sent):
    monkeypatch.setattr(shingle_sets, "HOT", hot)
    monkeypatch.setattr(shingle_sets, "SENT", sent)
    texts = edited(4)
    got = ngram_join.jaccard_groups(with_extra(frame(spark, texts)))
    assert sorted(map(tuple, got.collect())) == brute(texts)


def versions(seed, n, size=200, most=16, parents=0.0):
    """Copies of one text with up to so many edits, of the text or of earlier copies:
    many are similar, but too few to be linked."""
    rng, out = random.Random(seed), []
    base = [f"w{rng.randrange(4000)}" for _ in range(size)]
    for _ in range(n):
        w = list(rng.choice(out).split() if out and rng.random() < parents else base)
        for _ in range(rng.randrange(most)):
            at = rng.randrange(len(w))
            w[at : at + 1] = [] if rng.random() < 0.2 else [f"n{rng.randrange(300)}"]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,most,parents", [(1, 8, 0.9), (2, 24, 0.0), (3, 14, 0.4)])
def test_large_groups_of_versions_lose_no_link(spark, monkeypatch, seed, most, parents):
    """Around a hub, where every set is a component of its own; under a quarter of
    the pairs meet."""
    texts = versions(seed, 60, most=most, parents=parents) + versions(seed + 9, 30, 40, most // 3, parents)
    h, bounds = shingle_sets.sets_of(next(tn.chunks(tn.pa.array(texts))), 4)
    sets = {int(n): h[a:b].view(np.int64).tolist() for n, a, b in zip(shingle_sets.nodes_of(h, bounds), bounds, bounds[1:])}
    group = spark.createDataFrame([(min(sets), n, n) for n in sets], "hub long, node long, of long")
    met = shingle_sets.around(group, spark.createDataFrame([*sets.items()], "node long, sh array<long>"), ngram_join.RULE).collect()
    assert 8 * len(met) < len(sets) * (len(sets) - 1)
    root = {n: n for n in sets}
    for a, b in met:
        if 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]}):
            root = {n: min(root[a], root[b]) if r in (root[a], root[b]) else r for n, r in root.items()}
    parts = lambda of: sorted(sorted(n for n in of if of[n] == r) for r in {*of.values()})
    by_text = [int(n) for n in shingle_sets.nodes_of(h, bounds)]
    assert parts(root) == parts({n: r for n, (_, _, r) in zip(by_text, brute(texts))})
    monkeypatch.setattr(shingle_sets, "WIDE", 2)
    assert sorted(map(tuple, ngram_join.jaccard_groups(frame(spark, texts)).collect())) == brute(texts)


def test_differences_of_one_member_make_no_rows_for_its_hub(spark, monkeypatch):
    rng, made, written = random.Random(6), [], shingle_sets.written

    def counted(df, *more):
        out = written(df, *more)
        made.append(out.count())
        return out

    monkeypatch.setattr(shingle_sets, "written", counted)
    sets = {0: list(range(100))}
    for i in range(1, 200):
        sets[i] = [*rng.sample(sets[0], 94), *range(1000 * i, 1000 * i + 20)]
    group = spark.createDataFrame([(0, n, n) for n in sets], "hub long, node long, of long")
    shingle_sets.around(group, spark.createDataFrame([*sets.items()], "node long, sh array<long>"), ngram_join.RULE)
    assert max(made) <= 6 * len(sets)  # each differs from the hub in 26 elements, of which it has 20 alone


def test_odd_rows(spark):
    a = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([(3, a), (3, a), (None, a + " end"), (None, "x y"), (2, ""), (1, None), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.jaccard_groups(docs).collect()), key=repr)
    assert got == sorted([(3, 57, 3), (3, 57, 3), (None, 58, 3), (None, 1, None), (2, 0, 2), (1, 0, 1), (None, 0, None)], key=repr)
    assert ngram_join.jaccard_groups(docs.where("false")).count() == 0


def test_a_very_long_text(spark):
    body = [f"w{i % 5000}x{i % 77}" for i in range(120_000)]
    texts = [" ".join(body), " ".join(body[1000:]), " ".join(body[:90_000])]
    got = sorted(map(tuple, ngram_join.jaccard_groups(frame(spark, texts)).collect()))
    assert got == brute(texts)


@pytest.mark.parametrize("sets", [1.0, 1e4, 1e9])
def test_linked_sets_share_a_signature(sets):
    rng = random.Random(7)
    met = 0
    while met < 250:
        n = rng.choice([6, 7, 9, 12, 20, 40, 100, 300, 900])
        a = {rng.getrandbits(64) for _ in range(n)}
        gone = rng.sample(sorted(a), rng.randint(0, n // 6))
        b = (a - set(gone)) | {rng.getrandbits(64) for _ in range(rng.randint(0, max(1, n // 6 - len(gone))))}
        if a == b or 100 * len(a & b) < 85 * len(a | b):
            continue
        h = np.array(sorted(a) + sorted(b), np.uint64)
        keys, owner = ngram_join.signatures(h, np.array([0, len(a), len(a) + len(b)]), sets=sets)
        assert set(keys[owner == 0]) & set(keys[owner == 1])
        met += 1


def test_a_set_of_thin_partitions_sends_what_it_has(monkeypatch):
    """Where a plan leaves hardly a shingle for a signature, links stay."""
    monkeypatch.setattr(ngram_join, "plan", lambda k, small, sets: ngram_join.Plan(k // 2 + 2, 3, 1, 2, 1))
    test_linked_sets_share_a_signature(1.0)


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


TWINS = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_words_that_a_polynomial_hash_confuses(spark):
    c = next(tn.chunks(tn.pa.array([" ".join(TWINS), " ".join(thue_morse(n, *p) for n in (2, 8, 64, 128, 255, 256, 300) for p in ("ab", "ba"))])))
    w = tn.words_of(c)
    for seed in (0, 1):
        assert len(set(tn.word_hash(c.data, w.starts, w.ends, seed).tolist())) == len(w.starts)
    rest = " ".join(f"w{i}" for i in range(34))
    docs = frame(spark, [f"{x} {rest}" for x in TWINS])
    assert [r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()] == [0, 0]
    short = frame(spark, [f"{x} b c d" for x in TWINS])
    assert sorted(r["component_id"] for r in ngram_join.jaccard_groups(short).collect()) == [0, 1]
    assert sorted(r["component_id"] for r in near_copies.near_copy_groups(frame(spark, [f"{x} b c d e" for x in TWINS])).collect()) == [0, 1]
    counts = lm_scoring.token_counts(docs).collect()
    assert len(counts) == 34 + 2 + 1


def test_windows_of_two_words_in_turn(spark):
    """Runs of 64 words that a polynomial over words would not tell apart."""
    texts = [" ".join(thue_morse(64, *p)) for p in ("ab", "ba")]
    assert len({int(tn.window_hash(tn.mix(np.array([ord(x) for x in t.split()], np.uint64)), 64, 0)[0]) for t in texts}) == 2
    got = partial(substring_dedup.substring_dedup, width=64)(frame(spark, texts))
    assert [r["n_removed"] for r in got.collect()] == [0, 0]
