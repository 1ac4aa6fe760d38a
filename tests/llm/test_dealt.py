"""Joins with hot keys: the same rows as a plain join, no key in one task."""

import random

from pyspark.sql import functions as F

from quillrank.llm import dealt, decontaminate
from tests.llm.common import corpus, frame, words
from tests.llm.test_plain_loops import near
from tests.llm.test_text_operators import hits


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_key_of_a_third_of_all_rows(spark):
    many = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "gone").otherwise((F.col("id") % 500).cast("string")).alias("k"))
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("8", 3), (None, 4), ("none", 5)], "k string, x int")
    assert _rows(dealt.join(many, few, "k", 500).select("k", "id", "x")) == _rows(many.join(few, "k").select("k", "id", "x"))
    hot = {r["_key"]: r["_parts"] for r in dealt.hot_keys(many, few, "k", 500).collect()}
    of = lambda k: spark.range(1).select(F.xxhash64(F.lit(k))).first()[0]
    assert hot == {of("hot"): 12, of("gone"): 0}
    # Each part gives its share of the rows, give or take.
    part = F.pmod(F.xxhash64("id", "k"), F.lit(12))
    assert max(r["count"] for r in many.where("k = 'hot'").groupBy(part).count().collect()) * 2 < 1.5 * 500


def test_no_hot_key_and_no_rows(spark):
    many = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    few = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, x int")
    assert dealt.hot_keys(many, few, "k", 5) is None
    assert _rows(dealt.join(many, few, "k", 5)) == [("a", 1, 1), ("a", 1, 2)]
    assert dealt.join(many.where("false"), few, "k", 1).count() == dealt.join(many, few.where("false"), "k", 1).count() == 0


def test_hot_keys_stay_few(spark, monkeypatch):
    monkeypatch.setattr(dealt, "MOST", 10)
    many = spark.range(4000).select((F.col("id") % 100).alias("k"))
    few = spark.range(100).withColumnRenamed("id", "k")
    hot = dealt.hot_keys(many.unionAll(spark.range(2000).select(F.lit(7).cast("long"))), few, "k", 30)
    assert hot.count() <= 10 and hot.agg(F.max("_parts")).first()[0] >= 3


def test_decontamination_without_broadcasts(spark, monkeypatch):
    texts = list(enumerate(corpus(17, 40, 60) + ["the " * 300 + f"end{i}" for i in range(6)]))
    vocab, rng = words(texts[0][1]), random.Random(4)
    items = [(k, " ".join(rng.sample(vocab, 5))) for k in range(6)] + [(20, texts[4][1]), (21, "the"), (22, "the the"), (23, "the end3"), (24, vocab[0]), (25, None)]
    monkeypatch.setattr(decontaminate, "LOOKUPS", -1)
    monkeypatch.setattr(decontaminate, "TERMS", -1)
    monkeypatch.setattr(dealt, "PART", 50)
    got = decontaminate.contamination(frame(spark, [t for _, t in texts]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got} == {i: hits(t, items) for i, t in texts}
    assert {r["doc_id"]: set(r["near"]) for r in got} == near(texts, [x for x in items if x[1]])
