"""Registered queries and model kernels against plain loops."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from common import corpus, frame, lower, words
from test_models import tokens
from test_text_operators import bench_words, fingerprint, groups, hits

from quillrank.llm import decontaminate, lm_scoring, quality, simhash_dedup, toxicity
from quillrank.llm import textnum as tn
from quillrank.llm.components import components
from quillrank.llm.queries import QUERIES
from quillrank.llm.vocabulary import Frequent, frequent

SMALL = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_simhash_query(spark):
    texts = documents(spark)
    ids = sorted(texts)
    prints = [fingerprint(texts[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, groups(prints))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash_dedup"](spark, SMALL).collect()}
    assert got == want


def test_lm_query_base(spark):
    texts = documents(spark)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(x for i, t in texts.items() if not held[i] for x in tokens(t))
    n, v = sum(c.values()), len(c)
    for r in QUERIES["op7_lm_scoring"](spark, SMALL).collect():
        w = tokens(texts[r["doc_id"]])
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(r["score"])


def test_nearest_query(spark):
    t = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    x = np.array(t["embedding"].tolist(), np.float64)
    ids, unit = t["vec_id"].to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True)
    got = QUERIES["op4_nearest_neighbours"](spark, SMALL).collect()
    hit = 0
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[ids == q][0]
        near = [i for i in ids[np.lexsort((ids, -s))] if i != q][:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert all(sc == pytest.approx(s[ids == i][0], abs=1e-12) for _, i, sc in own)
        hit += len({i for _, i, _ in own} & set(near))
    assert hit >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_toxicity_logits():
    rng = np.random.default_rng(3)
    table, texts = rng.normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32), ["Ábc def, abc x", "", "!!", "one two three " * 50, "déjà VU"]
    got = toxicity.document_logits(pa.array(texts), table, 0.25)

    def mixed(word):
        """Buckets of a word's n-grams, borders included, and of itself."""
        one = toxicity._bag(next(tn.chunks(pa.array([word]))))
        at = one.starts[0] - 1
        grams = [int(g[at + i]) for g, n in zip(one.grams, toxicity._counts(one)) for i in range(int(n[0]))]
        return [int(one.whole[0]), *grams]

    for text, z in zip(texts, got):
        found = {w for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(text).translate({i: i + 32 for i in range(0xC0, 0xDF)}))}
        each = [np.mean(table[mixed(w)].astype(np.float64)) for w in sorted(found)]
        assert z == pytest.approx(0.25 + sum(each) / (len(found) + toxicity.PRIOR_WORDS) * (len(found) + toxicity.PRIOR_WORDS) ** toxicity.STRETCH, abs=1e-5)


def plain_tokens(text):
    out = []
    for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+", text):
        out.append("CAPITALS" if len(w) >= 2 and w.isascii() and w.isalpha() and w.isupper() else lower(w))
    return out


def test_word_vectors_and_pooling(spark):
    texts = [t or "" for t in corpus(6)][:40] + ["SHOUT a SHOUT, b!? c", ""]
    vectors = quality.word_vectors(frame(spark, texts), limit=150)
    assert len(vectors.words.keys) <= 150
    counts = Counter(x for t in texts for x in plain_tokens(t))
    assert vectors.words.n == sum(counts.values()) and vectors.words.v == len(counts)

    def number(token):
        h = quality._CAPS if token == "CAPITALS" else quality._tokens(next(tn.chunks(pa.array([token]))))[0][0]
        return int(quality._ids(vectors.words, np.array([h], np.uint64))[0])

    place, sign = quality.index_vectors(len(vectors.table))
    table = np.zeros((len(vectors.table), quality.DIM))
    for t in texts:
        w = [number(x) for x in plain_tokens(t)]
        for i, a in enumerate(w):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if j != i:
                    np.add.at(table[a], place[w[j]], sign[w[j]])
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    table = table / np.where(norm > 0, norm, 1)
    assert np.allclose(vectors.table, table, atol=1e-5)
    got = quality.pooled(pa.array(texts), vectors)
    for t, row in zip(texts, got):
        v = table[[number(x) for x in plain_tokens(t)]]
        want = np.concatenate([v.mean(0), (v**2).mean(0) * 4]) if len(v) else np.zeros(2 * quality.DIM)
        assert np.allclose(row, want, atol=1e-4)


def test_frequent_tokens_when_all_are_equal(spark):
    counts = spark.range(10_000).selectExpr("id * 7919 AS h", "3L AS c")
    got = frequent(counts, 500)
    assert 400 <= len(got.keys) <= 500 and got.n == 30_000 and got.v == 10_000
    assert isinstance(got, Frequent) and (np.diff(got.keys.astype(np.int64)) > 0).all()


def plain_score(model, h, c):
    """log10 probability of one text from the weights, token by token; h are
    its token hashes and c their counts in training."""
    lm, v = lm_scoring, model.vocab
    bias, words_, feats, hashed = model.parts()
    feats, words_ = feats.reshape(-1, lm.CLASSES + 1), words_.reshape(lm.WORD_CLASSES, lm.PER_CLASS)
    rank = {int(v.keys[at]): i for i, at in enumerate(v.top)}
    rare, mask, total = v.rare(), (1 << 32) - 1, 0.0
    bucket = lambda x: rank[x] if x in rank else lm.TOP + x % (lm.HISTORY - lm.TOP)
    for i, x in enumerate(h):
        prev, skip = (bucket(h[i - k]) if i >= k else lm.HISTORY - 1 for k in (1, 2))
        pair = (((prev * lm.HISTORY + skip) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> (64 - lm.PAIR_BITS)
        z = (bias + feats[prev] + feats[lm.HISTORY + skip] + feats[2 * lm.HISTORY + pair]).astype(np.float64)
        cls = rank[x] // lm.PER_CLASS if x in rank else lm.WORD_CLASSES + (x & 15)
        total += (z[cls] - np.logaddexp.reduce(z)) / math.log(10)
        if x in rank:
            at = [[(((((cls * lm.PER_CLASS + j) * 0x85EBCA6B) & mask) ^ (((y * 2 + k) * 0xC2B2AE35) & mask)) * 0x27D4EB2F & mask) >> (32 - lm.WORD_BITS) for j in range(lm.PER_CLASS)] for k, y in enumerate((prev, skip))]
            q = (words_[cls] + hashed[at[0]] + hashed[at[1]]).astype(np.float64)
            total += (q[rank[x] % lm.PER_CLASS] - np.logaddexp.reduce(q)) / math.log(10)
        else:
            total += math.log10(c[x] + 0.5) - math.log10(rare[cls - lm.WORD_CLASSES])
    return total


def test_lm_trained_score(spark):
    """Tokens beyond the modelled ones too, as the vocabulary is larger."""
    texts = corpus(8, vocabulary=1500) + [" ".join(["one two three four"] * 30)] * 20
    docs = frame(spark, texts)
    training = docs.where(lm_scoring.fold(docs["doc_id"], 5) != 1)
    counts = lm_scoring.token_counts(training).cache()
    model = lm_scoring.train(training, counts)
    hashes = {i: [int(x) for x in lm_scoring._tokens(next(tn.chunks(pa.array([t or ""]))))[0]] for i, t in enumerate(texts)}
    c = Counter(x for i, h in hashes.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in h)
    assert len(c) > lm_scoring.TOP
    for r in lm_scoring.score(docs, model, counts).collect():
        assert r["score"] == pytest.approx(plain_score(model, hashes[r["doc_id"]], c), rel=1e-4)


def test_plan_chooses_a_radius_for_many_fingerprints():
    rng = np.random.default_rng(0)
    sample, corr = rng.integers(0, 1 << 63, 1 << 12).astype(np.uint64), np.eye(64)
    few = simhash_dedup.plan(corr, sample, 1e5, 2)
    many = simhash_dedup.plan(corr, sample, 3e9, 2)
    assert few[1] == [0, 0, 0] and len(many[0]) == 2 and sorted(many[1]) == [0, 1]
    # Bits that are all alike in the sample: their partition is the one left out or met exactly.
    stiff = sample & np.uint64((1 << 40) - 1)
    parts, chosen = simhash_dedup.plan(corr, stiff, 1e7, 2)
    assert sum(t + 1 for t in chosen) == 3


@pytest.mark.parametrize("hot, found", [(1, (2, [1, 0])), (32, (2, [0, 1])), (1, (1, [2])), (32, (4, [0, -1, 0, 0])), (1, (4, [-1, 1, 0, -1]))])
def test_links_at_any_allocation(spark, monkeypatch, hot, found):
    monkeypatch.setattr(simhash_dedup, "HOT", hot)
    rng, values = random.Random(6), {0}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            values.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    parts = simhash_dedup.group_bits(np.eye(64), found[0])
    edges = simhash_dedup.links(spark.createDataFrame([(v,) for v in signed], "fp long"), found=(parts, found[1]))
    of = {r["node"]: r["component"] for r in components(edges.distinct()).collect()}
    want = groups(values)
    same = lambda label: {frozenset(i for i in range(len(values)) if label(i) == x) for x in map(label, range(len(values)))}
    assert same(lambda i: of.get(signed[i], signed[i])) == same(lambda i: want[i])


def near(docs, items, span=30):
    """Items whose three rarest words stand within a span, by trying all."""
    split = {i: bench_words(t) for i, t in docs}
    n, out = Counter(x for w in split.values() for x in w), {i: set() for i, _ in docs}
    for item, t in items:
        w = bench_words(t)
        rare = sorted((n[x], w.index(x), x) for x in set(w) if n[x])[:3]
        if not w or len(rare) < min(3, len(set(w))):
            continue
        for i, d in split.items():
            at = [[p for p, x in enumerate(d) if x == r] for *_, r in rare]
            if all(at) and any(all(any(p <= q < p + span for q in places) for places in at) for p in sorted(sum(at, []))):
                out[i].add(str(item))
    return out


def test_phrases_and_proximity(spark):
    texts = list(enumerate(corpus(11)))
    rng = random.Random(2)
    vocab = words(texts[0][1])
    items = [(k, " ".join(rng.sample(vocab, 6))) for k in range(12)] + [(20, texts[4][1]), (21, vocab[0]), (22, f"{vocab[1]} nowhere"), (23, f"{vocab[1]} {vocab[2]} {vocab[3]} nowhere"), (24, f"{vocab[0]} {vocab[0]}")]
    got = decontaminate.contamination(frame(spark, [t for _, t in texts]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got} == {i: hits(t, items) for i, t in texts}
    assert {r["doc_id"]: set(r["near"]) for r in got} == near(texts, items)
    assert any(r["near"] for r in got)


def test_a_frequent_word_as_an_item(spark):
    texts = ["the " * 500 + f"end{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, "the"), (2, "the the"), (3, "the end3")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(frame(spark, texts), bench).collect()}
    assert got == {i: hits(t, [(1, "the"), (2, "the the"), (3, "the end3")]) for i, t in enumerate(texts)}


def test_settings_are_compared_on_training_rows(monkeypatch):
    from quillrank.llm import toxicity_settings

    text, y, rest = toxicity_settings.training_rows("/root/testdata/sf0.01")
    assert set(rest) == set(toxicity_settings.FOLDS) and toxicity.HELD not in set(rest) and len(text) == len(y) == len(rest)
    monkeypatch.setattr(toxicity_settings, "GRID", {"steady": (3000,), "decay": (0.05,), "damping": (1e-2,)})
    (loss, recall, alarms, setting), = toxicity_settings.compare("/root/testdata/sf0.01", workers=1)
    assert 0 < loss < 1 and 0 <= recall <= 1 and alarms < 0.2 and setting["steady"] == 3000
