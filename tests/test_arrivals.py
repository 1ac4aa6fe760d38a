"""Uploads that land, and rankings that follow a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.operators import ranking
from quillrank.plans import service
from quillrank.sources import bucketed, files, landing, pdf
from quillrank.streaming import ranking as following


def table(spark, path):
    return bucketed.Table(spark, str(path), "archivos").create(landing.none(spark), 4)


def uploads(spark, *rows):
    return spark.createDataFrame([(n, bytearray(c)) for n, c in rows], landing.SCHEMA)


def test_uploads_land(spark, tmp_path):
    held = table(spark, tmp_path / "t")
    a, b = pdf.rendered("uno"), pdf.rendered("dos\ntres")
    first = uploads(spark, ("x/ana.pdf", a), ("c:\\b.PDF", b), ("b.txt", b), ("vacia.pdf", pdf.rendered(" \n\u00a0")), ("rota.pdf", b"%PDF-1.4"), ("ana.pdf", a))
    said = sorted(map(tuple, landing.land(first, held).collect()))
    assert said == [("ana.pdf", 200), ("ana.pdf", 200), ("b.PDF", 200), ("b.txt", 400), ("rota.pdf", 422), ("vacia.pdf", 422)]
    assert sorted((r["archivo"], r["texto"]) for r in files.pdf_texts(held.read()).collect()) == [("ana.pdf", "uno"), ("b.PDF", "dos\ntres")]
    # Tried again, and a name that comes again: refused it keeps what it had.
    landing.land(first, held)
    landing.land(uploads(spark, ("ana.pdf", b""), ("b.PDF", a)), held)
    assert sorted((r["archivo"], r["texto"]) for r in files.pdf_texts(held.read()).collect()) == [("ana.pdf", "uno"), ("b.PDF", "uno")]


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    held = table(spark, tmp_path / "t")
    bad = uploads(spark, ("a.pdf", pdf.rendered("x"))).withColumn("content", F.expr("if(archivo = 'a.pdf', raise_error('lost'), content)"))
    with pytest.raises(Exception, match="lost"):
        landing.land(bad, held)
    assert held.read().count() == 0 and held.snapshot().number == 0


def test_a_ranking_follows_its_stream(spark, tmp_path):
    rng = np.random.default_rng(2)
    row = lambda i, x: (i, [float(y) for y in x])
    offers = spark.createDataFrame([row(i, rng.normal(size=4)) for i in range(3)], "offer_id long, v array<double>")
    cands = [row(i, rng.normal(size=4)) for i in range(60)] + [row(100 + i, [1, 0, 0, 0]) for i in range(9)] + [(200, None)]
    state: dict[int, list] = {}

    def keep(df, _):
        for r in df.orderBy("offer_id", "posicion").collect():
            state.setdefault(r["offer_id"], [])
            if r["posicion"] == 1:
                state[r["offer_id"]] = []
            state[r["offer_id"]].append((r["posicion"], r["cand_id"]))

    ddl = "cand_id long, v array<double>"
    for part in (cands[:25], cands[25:50], cands[50:]):  # the query stops and starts again
        spark.createDataFrame(part, ddl).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        out = following.follow(stream, offers, 7).writeStream.outputMode("update").foreachBatch(keep)
        out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want: dict[int, list] = {}
    live = spark.createDataFrame(cands, ddl).where("v is not null")
    for r in ranking.top_k(ranking.score_pairs(offers, live), 7).orderBy("offer_id", "posicion").collect():
        want.setdefault(r["offer_id"], []).append((r["posicion"], r["cand_id"]))
    assert state == want


def test_long_rankings_come_in_pages(spark):
    rows = spark.createDataFrame([(o, p, f"n{p}", 0.5, 0.0, 0.5, ["a"], "") for o, n in ((1, 25), (2, 10)) for p in range(1, n + 1)], "offer_id int, posicion int, nombre string, score double, penalizacion double, score_ajustado double, avisos array<string>, extracto string")
    got = service.response(rows, page=10).orderBy("offer_id", "pagina").collect()
    assert [(r["offer_id"], r["pagina"]) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert '"total_candidatos":25' in got[2]["body"] and got[2]["body"].count('"posicion"') == 5
