"""Sources, tables and rankings beyond what the queries show."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillrank.functions import spans, text
from quillrank.operators import chunks, names, ranking
from quillrank.plans import config, profiles, service
from quillrank.sources import files, tables


@pytest.fixture
def parser():
    def pages(raw):  # a nested function travels to the workers by value
        if raw.startswith(b"bad"):
            raise ValueError("corrupt")
        return raw.decode().split("\f")

    return pages


def test_scan_says_what_failed(spark, tmp_path, parser):
    for name, raw in (("b.pdf", b"bad"), ("a.pdf", b"uno"), ("c.pdf", b" \f ")):
        (tmp_path / name).write_bytes(raw)
    got = {r["archivo"]: (r["texto"], r["error"]) for r in files.scan_pdfs(spark, str(tmp_path), parser).collect()}
    assert got == {"a.pdf": ("uno", None), "b.pdf": ("", "ValueError: corrupt"), "c.pdf": ("", None)}
    assert [r["archivo"] for r in files.read_pdfs(spark, str(tmp_path), parser, ordered=True).collect()] == ["a.pdf", "b.pdf", "c.pdf"]


def test_landing(spark, tmp_path, parser):
    folder = str(tmp_path)
    assert files.land_pdf(spark, folder, "x.txt", b"uno", parser) == 400
    assert files.land_pdf(spark, folder, "../a.PDF", b"uno", parser) == 200
    assert files.land_pdf(spark, folder, "a.PDF", b"dos", parser) == 200
    assert files.land_pdf(spark, folder, "b.pdf", b"  ", parser) == 422
    with pytest.raises(ValueError):
        files.land_pdf(spark, folder, "c.pdf", b"bad", parser)
    assert (tmp_path / "a.PDF").read_bytes() == b"dos" and not (tmp_path / "b.pdf").exists()
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"a.PDF", "c.pdf"}
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]


def test_offers_by_name(spark, tmp_path):
    (tmp_path / "jefe_de_obra-o'neil.txt").write_text("Requisitos")
    (tmp_path / "analista.txt").write_text("Grado")
    row = files.read_offer(spark, "jefe_de_obra-o'neil", str(tmp_path)).first()
    assert tuple(row) == ("jefe_de_obra-o'neil.txt", "Jefe De Obra-O'Neil", "Requisitos")
    with pytest.raises(FileNotFoundError):
        files.read_offer(spark, "nadie", str(tmp_path))
    assert [r["archivo"] for r in files.read_offers(spark, str(tmp_path)).collect()] == ["analista.txt", "jefe_de_obra-o'neil.txt"]


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("CVS_DIR", "datos/./cvs")
    spark.conf.set("quillrank.this.year", "2031")
    try:
        s = config.settings(spark, "/srv/app/")
    finally:
        spark.conf.unset("quillrank.this.year")
    assert (s.cvs_dir, s.offers_dir, s.this_year, s.database) == ("/srv/app/datos/cvs", "/srv/app/ofertas", 2031, "default")
    assert config.anchored("/abs/x", "/r") == "/abs/x" and config.anchored("s3a://b/x", "/r") == "s3a://b/x"


def test_describe(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS qd LOCATION '{tmp_path}/db'")
    try:
        tables.create_tables(spark, "qd")
        got = {tuple(r) for r in tables.describe(spark, "qd").collect()}
        assert got == {(r["tabla"], r["columna"], r["tipo"]) for r in tables.described(spark).collect()}
    finally:
        spark.sql("DROP DATABASE qd CASCADE")


def test_listing_order(spark):
    rows = [(1, "Óscar"), (2, "ana"), (3, "Zoe"), (4, "Ana"), (5, "oliva")]
    df = spark.createDataFrame([(i, n, f"{i}.pdf", None, None) for i, n in rows], "id int, nombre string, archivo string, texto_cv string, fecha_alta timestamp")
    assert [r["id"] for r in tables.listing(df).collect()] == [2, 4, 5, 1, 3]


@pytest.mark.parametrize("sample", [10_000, 200])
def test_numbering(spark, sample):
    keys = [f"k{i:05d}" for i in random.Random(1).sample(range(90_000), 3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["n"] for r in tables.numbered(df, "k", "n", sample=sample, ranges=16).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}
    assert tables.numbered(df.where("false"), "k", "n").count() == 0


def test_save_by_policy(spark):
    cand = "id int, nombre string, archivo string, fecha_alta int"
    old = spark.createDataFrame([(7, "A", "a", 1)], cand)
    new = spark.createDataFrame([("A2", "a", 5), ("A3", "a", 6), ("C", "c", 6), ("B", "b", 6)], "nombre string, archivo string, fecha_alta int")
    got = sorted(map(tuple, tables.save("candidatos", old, new).collect()))
    assert got == [(7, "A3", "a", 1), (8, "B", "b", 6), (9, "C", "c", 6)]
    off = spark.createDataFrame([(1, "T", "texto", "h", 1)], "id int, titulo string, descripcion string, huella string, fecha_alta int")
    again = spark.createDataFrame([("T2", "otro", "h", 9)], "titulo string, descripcion string, huella string, fecha_alta int")
    assert [tuple(r) for r in tables.save("puestos", off, again).collect()] == [(1, "T2", "texto", "h", 1)]
    empty = spark.createDataFrame([], cand)
    assert sorted(r["id"] for r in tables.save("candidatos", empty, new).collect()) == [1, 2, 3]


def test_pdf_lookup(spark):
    c = spark.createDataFrame([(1, "a.pdf"), (2, "../b.pdf"), (3, "c.pdf")], "id int, archivo string")
    there = spark.createDataFrame([("a.pdf",), ("../b.pdf",)], "archivo string")
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id int")
    assert dict((r["id"], r["status"]) for r in tables.pdf_lookup(asked, c, there).collect()) == {1: 200, 2: 400, 3: 404, 4: 404}


def test_positions_with_ties(spark):
    rng = random.Random(2)
    rows = [(o, c, rng.choice([0.5, 0.5, -0.25, rng.random()])) for o in range(3) for c in range(400)]
    df = spark.createDataFrame(rows, "offer_id int, cand_id int, score double")
    want = F.row_number().over(Window.partitionBy("offer_id").orderBy(F.col("score").desc(), "cand_id"))
    assert ranking.positions(df, "score", "p").withColumn("q", want).where("p <> q").count() == 0


def test_offers_in_blocks(spark):
    rng = np.random.default_rng(0)
    o = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)], "offer_id long, v array<double>")
    c = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(20)], "cand_id long, v array<double>")
    key = lambda df: sorted((r["offer_id"], r["cand_id"], round(r["score"], 9)) for r in df.collect())
    assert key(ranking.score_pairs(o, c)) == key(ranking.score_pairs(o, c, block=7))


def test_lexical_scores_in_blocks(spark):
    rng = random.Random(3)
    vocab = ["año", "niño", "Casa", "2024", "c3po", "über", "dog", "red", "to"]
    body = lambda: " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 12])))
    docs = [(i, body()) for i in range(120)] + [(200 + i, "dog red") for i in range(40)] + [(999, None), (998, "¡!")]
    offers = [(i, body()) for i in range(11)]
    d, o = (spark.createDataFrame(x, f"{k} long, texto string") for x, k in ((docs, "doc_id"), (offers, "offer_id")))
    dv, ov = chunks.hashed_terms(d), chunks.hashed_terms(o, key="offer_id")
    best = lambda block: sorted(map(tuple, ranking.top_k(chunks.top_scores(ov, dv, 4, block=block).withColumn("score", F.round("score", 6)), 4, tie="doc_id").select("offer_id", "posicion", "doc_id", "score").collect()))
    flat = lambda df, k: {r[k]: dict(zip(r["dims"], r["xs"])) for r in df.collect()}
    dm, om, want = flat(dv, "doc_id"), flat(ov, "offer_id"), []
    assert 999 not in dm and 998 not in dm and sum(x * x for x in dm[0].values()) == pytest.approx(1)
    for i, q in om.items():
        s = sorted((-round(sum(x * v.get(k, 0) for k, x in q.items()), 6), j) for j, v in dm.items() if set(q) & set(v))[:4]
        want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    assert best(10_000) == best(4) == sorted(want)


def test_packing_by_expression(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join("pa" * rng.randint(1, 3) for _ in range(rng.choice([1, 5, 40, 130, 300]))) + rng.choice([".", "!", "", "\n"])
    texts = [" ".join(sentence() for _ in range(rng.randint(0, 12))) for _ in range(40)] + ["", None, "  \n ", "uno"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, texto string")
    for limit in (126, 7):
        got = {}
        for r in chunks.chunks(df, limit).orderBy("doc_id", "pos").collect():
            got.setdefault(r["doc_id"], []).append(r["chunk"])
        assert got == {i: chunks.chunk(t, limit) for i, t in enumerate(texts)}
    counted = chunks.chunks(df, 50, count=len).groupBy("doc_id").agg(F.max(F.length("chunk")).alias("n")).collect()
    assert all(r["n"] <= 50 for r in counted)


def test_a_model_is_loaded_once(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda texts: [[float(len(t)), 0.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 400)], "doc_id int, chunk string").repartition(8)
    out = chunks.embed(df, chunks.lazy("test-model", load))
    assert out.where("vec[0] = 1.0").count() == 399 and out.count() == 399
    assert 1 <= loads.value <= 4  # one for each Python worker at most


def test_matches_of_a_pattern(spark):
    s = "é ab12 x " * 3000
    df = spark.createDataFrame([(s,), ("",), ("none",)], "t string")
    got = [r[0] for r in df.select(spans.matches(F.col("t"), "[a-z]+[0-9]+")).collect()]
    assert [(x["start"], x["match"]) for x in got[0]] == [(9 * i + 2, "ab12") for i in range(3000)] and got[1:] == [[], []]
    assert df.select(F.size(text.located(F.col("t"), "[a-z]+[0-9]+"))).first()[0] == 3000


def test_reports(spark):
    docs = spark.createDataFrame([("  uno dos\ttres " + "x" * 80, "Ana María"), (None, None)], "t string, n string")
    got = docs.select(names.preview(F.col("t"), 3, 12).alias("p"), names.is_named(F.col("n"), ("Ana",)).alias("c")).collect()
    assert [r["p"] for r in got] == ["uno dos tres", ""] and got[0]["c"] is True and not got[1]["c"]
    row = spark.createDataFrame([(1, 1, "Ana", 0.5, 0.1, 0.4, ["a & b"], "EXPERIENCIA uno")], "offer_id int, posicion int, nombre string, score double, penalizacion double, score_ajustado double, avisos array<string>, extracto string")
    shown = service.shown(row).first()
    assert (shown["es_lider"], shown["aviso"], shown["percent"], round(shown["grados"])) == (True, "a &amp; b", 40.0, 60)
    assert service.console(row).first()["linea"] == "1   Ana              0.5000  " + "#" * 10 + "." * 10
    assert service.response(row, row.selectExpr("offer_id", "'T' AS titulo", "' ' AS texto")).first()["status"] == 400


def test_profile_text(spark):
    t = profiles.peopled(spark.range(16)).select("archivo", profiles.profile_text().alias("t")).orderBy("archivo").first()["t"].split("\n")
    assert t[:4] == ["Alba Ríos", "Backend Developer | Madrid", "alba_rios@example.org", "PERFIL"] and "EXPERIENCIA" in t


def test_a_whole_ranking_joins_no_candidates(spark):
    """What a pair needs is told where it is met, not looked up again."""
    offers = spark.createDataFrame([(1, [1.0, 0.0], "Requisitos\n- 9 años de experiencia")], "offer_id int, v array<double>, texto string")
    rows = [(i, f"n{i}", [1.0, float(i)], [[0.0, 1.0], [1.0, 0.0]], ["a", f"b{i}"], "EXPERIENCIA\n2 años de experiencia") for i in range(3)] + [(8, "x", None, [], [], ""), (9, "y", [0.0, 1.0], [], [], None)]
    cands = spark.createDataFrame(rows, "cand_id int, nombre string, v array<double>, fragmentos array<array<double>>, trozos array<string>, texto string")
    out = service.rank_detailed(offers, cands, 2026)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = [(r["posicion"], r["cand_id"], r["nombre"], r["extracto"]) for r in out.orderBy("posicion").collect()]
    assert got == [(1, 0, "n0", "b0"), (2, 1, "n1", "b1"), (3, 2, "n2", "b2"), (4, 9, "y", "")]
    assert [r["extracto"] for r in service.rank_detailed(offers, cands, 2026, 2).orderBy("posicion").collect()] == ["b0", "b1"]
