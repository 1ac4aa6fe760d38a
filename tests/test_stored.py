"""Bucketed tables, subword chunks, pruned top k and places by range."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank.functions import text
from quillrank.operators import chunks, pruned, ranking, sections, subwords
from quillrank.plans import config
from quillrank.sources import bucketed, staging, tables

CAND = "id int, archivo string, nombre string, fecha_alta int"


def stored_files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_a_merge_rewrites_only_what_it_touches(spark, tmp_path):
    first = spark.createDataFrame([(i, f"f{i:03d}", f"n{i}", 1) for i in range(1, 201)], CAND)
    table = bucketed.Table(spark, str(tmp_path / "t"), "candidatos").create(first, 16)
    before, at = stored_files(tmp_path / "t"), table.snapshot()
    new = spark.createDataFrame([("f007", "otro", 5), ("f007", "nuevo", 9), ("zz", "más", 9)], "archivo string, nombre string, fecha_alta int")
    after = table.merge(new)
    changed = [b for b in range(16) if at.folders.get(b) != after.folders.get(b)]
    assert len(changed) <= 2 and before <= stored_files(tmp_path / "t")
    want = sorted([(i, f"f{i:03d}", "nuevo" if i == 7 else f"n{i}", 1) for i in range(1, 201)] + [(201, "zz", "más", 9)])
    assert sorted(map(tuple, table.read().collect())) == want
    assert table.read(0).count() == 200  # the snapshot before
    assert sorted(map(tuple, tables.save("candidatos", first, new).collect())) == want
    table.vacuum()
    assert sorted(map(tuple, table.read().collect())) == want
    assert len(stored_files(tmp_path / "t") & before) < len(before)


def test_ids_go_on_behind_the_highest_ever(spark, tmp_path):
    table = bucketed.Table(spark, str(tmp_path / "t"), "candidatos").create(spark.createDataFrame([], CAND), 4)
    row = lambda *files: spark.createDataFrame([(f, f, 1) for f in files], "archivo string, nombre string, fecha_alta int")
    for files in (("b", "a"), (), ("c",), ("a", "d")):
        table.merge(row(*files))
    assert sorted((r["archivo"], r["id"]) for r in table.read().collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert table.snapshot().number == 3


def test_a_merge_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    table = bucketed.Table(spark, str(tmp_path / "t"), "candidatos").create(spark.createDataFrame([(1, "a", "A", 1)], CAND), 4)
    bad = spark.createDataFrame([("a", "B", 2)], "archivo string, nombre string, fecha_alta int").withColumn("nombre", F.expr("raise_error('no')"))
    with pytest.raises(Exception, match="no"):
        table.merge(bad)
    assert [tuple(r) for r in table.read().collect()] == [(1, "a", "A", 1)] and table.snapshot().number == 0
    # A writer that comes between: the merge is done again over what it has left.
    other, snapshot = bucketed.Table(spark, table.path, "candidatos"), table.snapshot
    came = []

    def late():
        at = snapshot()
        if not came:
            came.append(other.merge(spark.createDataFrame([("b", "B", 3)], "archivo string, nombre string, fecha_alta int")))
        return at

    monkeypatch.setattr(table, "snapshot", late)
    table.merge(spark.createDataFrame([("c", "C", 4)], "archivo string, nombre string, fecha_alta int"))
    assert sorted((r["id"], r["archivo"]) for r in other.read().collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_matches_have_no_id(spark, tmp_path):
    ddl = "candidato_id int, puesto_id int, score float, fecha int"
    table = bucketed.Table(spark, str(tmp_path / "t"), "matches").create(spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.25, 1)], ddl), 4)
    table.merge(spark.createDataFrame([(1, 2, 0.75, 2), (2, 2, 0.125, 2)], ddl))
    assert sorted(map(tuple, table.read().collect())) == [(1, 1, 0.5, 1), (1, 2, 0.75, 2), (2, 2, 0.125, 2)]


TEXTS = [
    "Uno dos tres. Cuatro cinco! ¿Seis? siete\nocho nueve", "", None, " \n", "x" * 400, "it's 3,14 isn't it? (yes) — no.\n\n'quoted' text", "ñandú " * 90 + ". " + "日本語 " * 40,
    "word " * 300 + "end. Short.", "a.b.c d. e", "tab\tseparated  words here.  hard blank", "<|endoftext|> is text. So it goes.",
]


@pytest.mark.parametrize("limit", [3, 16, 126])
def test_subword_chunks_are_those_of_joined_counts(spark, limit):
    known = subwords.counter(spark, config.settings(spark, "/").vocabulary)
    rng = random.Random(limit)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "Beta.", "γ", "12.5", "end!", "\n", "can't", "--"]) for _ in range(rng.randint(1, 200))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, texto string")
    got: dict[int, list[str]] = {}
    for r in subwords.subword_chunks(df, known, limit).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert got == {i: chunks.chunk(t, limit, lambda x: known.count([x])[0]) for i, t in enumerate(texts)}


def test_vocabularies_that_do_not_split_before_blanks(spark, tmp_path):
    from tokenizers import Tokenizer, models

    whole = Tokenizer(models.BPE(vocab={"a": 0, " ": 1, "a ": 2}, merges=[("a", " ")]))
    whole.save(str(tmp_path / "v.json"))
    with pytest.raises(ValueError, match="blanks"):
        subwords.counter(spark, str(tmp_path / "v.json"))


def test_long_texts_in_linear_time(spark):
    known = subwords.counter(spark, config.settings(spark, "/").vocabulary)
    words = "uno dos tres. " * 120_000
    df = spark.createDataFrame([(1, words), (2, "a" + " " * 500_000 + "b"), (3, "palabra " * 200_000)], "doc_id long, texto string")
    n = {r["doc_id"]: r["count"] for r in chunks.chunks(df).groupBy("doc_id").count().collect()}
    assert n == {1: -(-120_000 // 42), 2: 1, 3: -(-200_000 // 126)}
    assert subwords.subword_chunks(df, known).where("doc_id = 1").count() > 5000
    assert df.select(F.length(text.normalise(F.col("texto"))).alias("n")).where("n = 500002").count() == 1
    lines = "x\nEXPERIENCIA\ny\n" * 60_000
    cut = spark.createDataFrame([(1, lines)], "doc_id long, texto string")
    assert {r["section"]: len(r["text"]) for r in sections.cv_sections(cut).collect()} == {"otros": 1, "experiencia": 2 * 119_999 - 1}


def test_sections_need_no_exchange(spark):
    df = spark.createDataFrame([(1, "x\nIDIOMAS\nInglés C1"), (1, "FORMACIÓN\n\nGrado"), (2, None)], "doc_id long, texto string")
    out = sections.cv_sections(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "formacion", "Grado"), (1, "idiomas", "Inglés C1"), (1, "otros", "x"), (2, "otros", "")]
    assert "Exchange" not in sections.cv_profiles(df, 2026)._jdf.queryExecution().executedPlan().toString()


def brute_top(offers, cands, k, places):
    unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + (np.linalg.norm(x, axis=1, keepdims=True) == 0))
    score = np.round(unit(np.array(offers)) @ unit(np.array(cands)).T, places)
    return sorted((i, int(j), float(score[i, j]) + 0.0) for i in range(len(offers)) for j in np.lexsort((np.arange(len(cands)), -score[i]))[:k])


@pytest.mark.parametrize("spread,share", [(0.05, 0.5), (2.0, 1.0)])
def test_pruned_top_k(spark, spread, share):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    cands = centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 8)) * spread
    cands[5] = 0
    cands[10:30] = cands[9]  # ties
    offers = np.concatenate([centres[:10] + rng.normal(size=(10, 8)) * spread, np.zeros((1, 8)), cands[9:10]])
    rows = lambda x: [(i, [float(y) for y in r]) for i, r in enumerate(x)]
    found = pruned.top_k(spark.createDataFrame(rows(offers), "offer_id int, v array<double>"), spark.createDataFrame([*rows(cands), (999, None)], "cand_id int, v array<double>"), 7, places=6)
    got = sorted((r["offer_id"], r["cand_id"], r["score"] + 0.0) for r in found.rows.collect())
    want = brute_top(offers, cands, 7, 6)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)
    assert found.pairs == 12 * 600 and found.scored <= share * found.pairs


def test_pruned_odd_tables(spark):
    ddl = "v array<double>"
    offers = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], f"offer_id int, {ddl}")
    few = spark.createDataFrame([(7, [0.0, 1.0]), (7, [1.0, 1.0])], f"cand_id int, {ddl}")
    assert [r["cand_id"] for r in pruned.top_k(offers, few, 5).rows.collect()] == [7, 7]
    assert pruned.top_k(offers, few.where("false"), 5).rows.count() == 0
    assert pruned.top_k(offers.where("false"), few, 5).rows.count() == 0


def test_pruned_meets_pairs_in_parts(spark, monkeypatch):
    """A part gives few rows per offer, not one per pair; large blocks and many
    offers are dealt, repeated ids and ties at the last place kept in order."""
    for name, n in (("PART_NUMBERS", 8 * 40), ("OFFER_NUMBERS", 8 * 16), ("TABLE", 500)):
        monkeypatch.setattr(pruned, name, n)
    rng = np.random.default_rng(6)
    cands = np.concatenate([np.tile(rng.normal(size=(1, 8)), (150, 1)), rng.normal(size=(400, 8)).round(1)])
    offers = np.concatenate([cands[:20], rng.normal(size=(40, 8)).round(1)])
    rows = lambda x: [(i, [float(y) for y in r]) for i, r in enumerate(x)]
    left, right = spark.createDataFrame(rows(offers), "offer_id int, v array<double>"), spark.createDataFrame(rows(cands), "cand_id int, v array<double>")
    found = pruned.top_k(left, right, 5, places=6)
    assert sorted((r["offer_id"], r["cand_id"]) for r in found.rows.collect()) == [w[:2] for w in brute_top(offers, cands, 5, 6)]
    parts = pruned.parted(np.array([10, 200, 0, 30, 20]), 40)
    assert parts.first.tolist() == [0, 1, 6, 6, 7] and parts.count.tolist() == [1, 5, 1, 1, 1]
    listed = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    visits = pa.table({"offer_id": range(60), "o": listed(offers), "least": pa.nulls(60, pa.float64()), "own": pa.array([[0]] * 60, pa.list_(pa.int32()))})
    met = pruned._meet(5, 6, 1e-6)(visits, pa.table({"cand_id": range(550), "v": listed(cands), "block": np.zeros(550, np.int32)}))
    assert 60 * 5 <= met.num_rows < 60 * 30


def test_ties_are_spread_over_ranges(spark):
    """Equal scores of one offer, far more than the others'."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("offer_id"), F.col("id").alias("cand_id"), F.lit(0.0).alias("score")).unionAll(spark.range(300).select((2 + F.col("id") % 3).cast("int"), "id", F.rand(1)))
    held = ranking.ranged(df, "score", "cand_id", "offer_id", 16)
    assert held.groupBy("__part").count().agg(F.max("count")).first()[0] < 3 * n / 16
    out = ranking.places(df, {"p": "score", "q": "cand_id"}, plain=1000, parts=16)
    assert out.where("offer_id = 1 and (p <> cand_id + 1 or q <> 200000 - cand_id)").count() == 0
    plain = ranking.places(df.where("offer_id > 1"), {"p": "score"})
    assert plain.join(out.where("offer_id > 1").withColumnRenamed("p", "r"), ["offer_id", "cand_id"]).where("p <> r").count() == 0
    assert plain.count() == 300


def test_staging_leaves_nothing(spark):
    with staging.scratch() as scope:
        a, b = staging.written(spark.range(3)), staging.written(spark.range(4))
        scope.keep(b)
    assert b.count() == 4
    with pytest.raises(Exception):
        a.count()


def test_stored_chunks_stay_where_they_are(spark, tmp_path):
    from quillrank.sources import chunk_index

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = spark.createDataFrame([(c, p, f"{c}.{p}", [float(p == c % 3), float(p)]) for c in range(40) for p in range(3)], "cand_id int, pos int, chunk string, vec array<double>")
        index = chunk_index.store(parts, "chunks_test", str(tmp_path / "index"), 4)
        offers = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "offer_id int, v array<double>")
        ranked = spark.createDataFrame([(o, c, 1) for o in (1, 2, 3) for c in (*range(40), 77)], "offer_id int, cand_id int, posicion int")
        out = chunk_index.explained(ranked, offers, index)
        got = {(r["offer_id"], r["cand_id"]): r["extracto"] for r in out.collect()}
        assert got == {(o, c): "" if c == 77 else f"{c}.{ {1: c % 3, 2: 0, 3: 2}[o]}" for o in (1, 2, 3) for c in (*range(40), 77)}
        plan = out._jdf.queryExecution().executedPlan().toString()
        final = plan[: plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
        scan = next(i for i, line in enumerate(final.splitlines()) if "FileScan" in line and "chunks_test" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :|+-*()0123456789"))
        above, lines = [], final.splitlines()
        for line in reversed(lines[:scan]):  # the scan's ancestors, up to the join
            if depth(line) < depth(lines[scan] if not above else above[-1]):
                above.append(line)
            if "Join" in line:
                break
        assert not any("Exchange" in line for line in above) and "Bucketed: true" in final
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS chunks_test")
