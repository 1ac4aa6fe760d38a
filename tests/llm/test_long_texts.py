"""Very long texts and runs: linear work, whole results."""

import random
import time

import pytest
from common import DOCS, frame, words
from pyspark.sql import functions as F
from test_near_copies import roots
from test_text_operators import base_spans, cleaned, fingerprint, hits, peak, repeated

from quillrank.llm import decontaminate, line_dedup, lm_scoring, mixing, near_copies, secret_scan, simhash_dedup, substring_dedup

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


@pytest.mark.parametrize("text, suspect", [("a-1-" * 100_000, False), ("".join(random.Random(1).choices(BASE64, k=1_000_000)), True), ("aB3" * 200_000, False)])
def test_one_long_run(spark, text, suspect):
    began = time.time()
    got = secret_scan.scan_secrets(frame(spark, [text])).first()
    assert [(x["start"], x["end"]) for x in got["spans"] if x["order"] == 3] == ([(0, len(text))] if suspect else [])
    assert [tuple(x) for x in got["base"]] == base_spans(text)
    assert time.time() - began < 60


def test_many_matches(spark):
    text = "é 0123456789abcdef password=abcdefgh1234 " * 40_000
    began = time.time()
    got = secret_scan.scan_secrets(frame(spark, [text])).first()
    assert [tuple(x) for x in got["base"]] == base_spans(text)
    assert time.time() - began < 120


def test_peak_entropy(spark):
    rng = random.Random(2)
    runs = ["".join(rng.choices(rng.choice(["ab", "0123456789abcdef", BASE64, "+-/_="]), k=rng.choice([1, 5, 19, 20, 21, 40, 300]))) for _ in range(200)]
    df = spark.createDataFrame([(r,) for r in runs], "s string").select("s", secret_scan.peak_entropy(F.col("s")).alias("p"))
    assert all(r["p"] == pytest.approx(peak(r["s"]), abs=1e-9) for r in df.collect())


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def test_substring_and_simhash(spark):
    texts = [LONG, "start " + LONG + " end", "short one"]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(frame(spark, texts)).collect())
    assert got == repeated(texts, 35)
    prints = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash_dedup.simhash_groups(frame(spark, texts)).collect()}
    assert prints == {i: fingerprint(t) for i, t in enumerate(texts)}


def test_decontamination(spark):
    bench = [(1, " ".join(LONG.split()[40_000:40_020])), (2, "not there at all")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(frame(spark, [LONG, "x"]), items).collect()}
    assert got == {0: hits(LONG, bench), 1: hits("x", bench)}


def test_lines_sizes_and_tokens(spark):
    text = "\n".join(f"line {i % 5000}" for i in range(100_000))
    rows = [(text, f"s{i}") for i in range(5)] + [("line 1\nown", "s9")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (t, s) in enumerate(rows)], DOCS)
    got = [(r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.remove_boilerplate(docs).orderBy("doc_id").collect()]
    assert got == cleaned(rows, 5)
    out = {r["doc_id"]: r for r in mixing.pareto_mix(docs).collect()}
    assert out[0]["size"] == len(words(text)) and all(r["taken"] <= 3 * r["size"] for r in out.values())
    scored = {r["doc_id"]: r["n_tokens"] for r in lm_scoring.score_corpus(docs).collect()}
    assert scored == {i: len(words(t)) + 1 for i, (t, _) in enumerate(rows)}


def test_near_copies(spark):
    texts = [LONG, LONG + " one more", LONG[: len(LONG) // 2], "x y"]
    out = near_copies.near_copy_groups(frame(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == dict(enumerate(roots(texts)))


def test_toxicity_of_a_text_in_pieces():
    import numpy as np
    import pyarrow as pa

    from quillrank.llm import textnum as tn
    from quillrank.llm import toxicity

    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdeÉñZ", k=rng.randint(1, 7))) for _ in range(700_000)) + "q" * 300_000 + "."
    table = np.random.default_rng(1).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32)
    chunk = next(tn.chunks(pa.array([text])))
    assert len(list(toxicity._stretches(chunk))) > 2
    whole = toxicity._bag(chunk)
    words = len(whole.keys) + toxicity.PRIOR_WORDS
    want = 0.5 + toxicity._word_means(whole, table).sum() * words ** (toxicity.STRETCH - 1)
    assert toxicity.document_logits(pa.array(["a", text]), table, 0.5)[1] == pytest.approx(want, rel=1e-6)
    bag = np.zeros(1 << toxicity.BUCKET_BITS)
    got = toxicity._bags(pa.array([text]))[0]
    np.add.at(bag, got[0], got[1].astype(np.float64))
    assert bag @ table / toxicity.UNIT == pytest.approx((want - 0.5), rel=2e-2, abs=2e-2)
