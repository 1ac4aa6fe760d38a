"""Unicode forms against Python's own."""

import random
import unicodedata

from pyspark.sql import functions as F

from quillrank.functions import forms, text


def folded(x):
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))


def compared(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "x string").repartition(4)
    for r in df.select("x", forms.compose(F.col("x")).alias("c"), forms.fold(F.col("x")).alias("f")).collect():
        assert r["c"] == unicodedata.normalize("NFC", r["x"]), ascii(r["x"])
        assert r["f"] == folded(r["x"]), ascii(r["x"])


def test_each_character_alone(spark):
    every = (chr(p) for p in range(1, 0x30000) if not 0xD800 <= p < 0xE000)
    compared(spark, [c for c in every if unicodedata.category(c) != "Cn"])


def test_mixed_characters(spark):
    rng, t = random.Random(3), forms.tables()
    hangul = [chr(rng.randrange(forms.SYLLABLES, forms.SYLLABLES + 11172)) for _ in range(600)]
    hot = [*t.order, *t.canonical, *t.folded, *sorted(t.late) * 6, *forms.LEADS * 4, *hangul, *(x[0] for x in t.pairs), *"aeiou \n" * 60]
    close = list("aeᾄ゙ְ̧̣̈͂̓̄ෝ각가̈́Åか\U000f0001")
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for pool in (hot, close) for _ in range(4000)]
    compared(spark, texts + ["", "́", "ᅣ", "ι"])


def test_nulls_and_long_texts(spark):
    assert spark.createDataFrame([(None,)], "x string").select(forms.compose(F.col("x")), forms.fold(F.col("x"))).first() == (None, None)
    compared(spark, ["a" + "́" * 100_000, "a" + "̣́" * 50_000, "ᅡ" * 50_000, "éx" * 100_000, "가나" * 50_000, "hola mundo " * 100_000, "añó " * 100_000])


def test_tables_bound_what_joins():
    """A late starter never takes one in itself, so clusters may end after it."""
    t = forms.tables()
    assert not ({x[0] for x in t.pairs} | set(forms.LEADS)) & t.late
    assert all(len(unicodedata.normalize("NFD", c)) <= t.reach[0] + 1 for c in t.pairs.values())


def test_rules_read_any_latin_letter(spark):
    df = spark.createDataFrame([("ＦＯＲＭＡＣＩÓＮ",), ("Ȟoriẓoṇṭal ĿĐ ﬁn",), ("İŐ ",)], "x string")
    assert [r[0] for r in df.select(text.normalise(F.col("x"))).collect()] == ["formacion", "horizontal l·đ fin", "io"]
