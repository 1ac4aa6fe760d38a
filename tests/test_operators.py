import pytest
from pyspark.sql import functions as F

from quillrank.functions import present, text, vectors
from quillrank.operators import chunks, names
from quillrank.plans import service
from quillrank.sources import files, tables
from quillrank.streaming import intake


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_cleaning(spark):
    assert one(spark, text.repair_accents, "Formacio´n", "M´aster", "Espan˜a", "Tecnolog´ıa", None) == ["Formación", "Máster", "España", "Tecnología", None]
    assert one(spark, text.clean, "desarro-\nllador", " a\t• b \n\n\n\n c ") == ["desarrollador", "a b\n\nc"]
    assert one(spark, text.normalise, " Título ", "ÑANDÚ") == one(spark, text.normalise_latin, " Título ", "ÑANDÚ") == ["titulo", "nandu"]
    a, b = one(spark, text.fingerprint, " x\n", "x")
    assert a == b


def test_names(spark):
    got = one(spark, names.name_from_text, "CURRICULUM VITAE\nMARCOS GUERRERO", "Tel 611408310\nx", "Ana de la Cruz", "JEAN-LUC O'NEIL", "", None)
    assert got == ["Marcos Guerrero", None, "Ana de la Cruz", "Jean-Luc O'Neil", None, None]
    assert one(spark, names.title_from_text, "x\nBargas, Toledo 611408310", "x\nAnalista | 3 anos", "x\nPERFIL", "x") == [None, "Analista", None, None]
    assert one(spark, names.name_from_file, "ana_ruiz-backend.pdf", "RRHH_x.pdf") == ["Ana Ruiz Backend", "RRHH X"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [0.5, 0.7, 0.7])], "a array<float>, z array<float>, s array<double>")
    r = df.select(vectors.cosine(F.col("a"), F.col("z")), vectors.cosine(F.col("a"), F.col("a")), vectors.argmax(F.col("s")), vectors.argmax(F.array().cast("array<double>"))).first()
    assert tuple(r) == (0.0, 1.0, 1, 0)


def test_presentation(spark):
    assert one(spark, present.quote, "Ana 600  PERFIL Ingeniera", "x" * 330, None) == ["PERFIL Ingeniera", "x" * 320 + "...", ""]
    assert one(spark, present.escape, '<a "b">&') == ["&lt;a &quot;b&quot;&gt;&amp;"]
    assert one(spark, lambda c: present.bar(c.cast("double")), "0.5", "-1") == ["#" * 10 + "." * 10, "." * 20]


def test_packing(spark):
    words = "uno dos tres. cuatro cinco seis. siete"
    assert chunks.chunk(words, 6) == ["uno dos tres. cuatro cinco seis.", "siete"]
    assert chunks.chunk("a b c d e", 2) == ["a b", "c d", "e"] and chunks.chunk("", 5) == [""] and chunks.chunk(None, 5) == [""]
    assert chunks.window_limit() == 126


def test_upsert_and_ids(spark):
    schema = "id int, archivo string, texto string, fecha_alta int"
    old = spark.createDataFrame([(1, "a", "x", 10), (2, "b", "y", 11)], schema)
    new = spark.createDataFrame([(None, "a", "z", 20), (None, "c", "w", 21)], schema)
    out = tables.with_new_ids(tables.upsert(old, new, ("archivo",), ("id", "fecha_alta")), "archivo")
    assert sorted(map(tuple, out.collect())) == [(1, "a", "z", 10), (2, "b", "y", 11), (3, "c", "w", 21)]
    seq = spark.createDataFrame([("a", 1, "p"), ("a", 3, "q"), ("a", 2, "r")], "k string, seq int, v string")
    assert [tuple(r) for r in tables.latest(seq, ("k",), "seq").collect()] == [("a", 3, "q")]


def test_catalog(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS qr LOCATION '{tmp_path}/db'")
    try:
        tables.create_tables(spark, "qr")
        tables.create_tables(spark, "qr")
        assert tables.add_missing_columns(spark, "qr.matches", {"score": "FLOAT", "nota": "STRING"}) == ["nota"]
    finally:
        spark.sql("DROP DATABASE qr CASCADE")


def test_pdf_scan_survives_bad_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"uno\fdos")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def parser(raw):
        if raw == b"bad":
            raise ValueError("corrupt")
        return raw.decode().split("\f")

    got = dict(map(tuple, files.read_pdfs(spark, str(tmp_path), parser).collect()))
    assert got == {"a.pdf": "uno\n\ndos", "b.pdf": ""}
    with pytest.raises(Exception):
        files.read_pdfs(spark, str(tmp_path / "none"), parser)
    with pytest.raises(ValueError):
        files.pdf_bytes(spark, str(tmp_path), "../a.pdf")
    assert files.pdf_bytes(spark, str(tmp_path), "a.pdf").first()["content"] == b"uno\fdos"


def test_offers_and_requests(spark, tmp_path):
    (tmp_path / "data_engineer.txt").write_text("Requisitos\n- Grado")
    row = files.read_offers(spark, str(tmp_path)).first()
    assert (row["titulo"], row["texto"]) == ("Data Engineer", "Requisitos\n- Grado")
    assert files.offer_from_bytes(spark, b"A\xffB").first()["texto"] == "A�B"
    raw = spark.createDataFrame([('{"texto": "x", "top": 0}',), ('{"texto": " "}',)], "body string")
    assert [tuple(r) for r in files.requests(raw).collect()] == [("x", "Oferta via API", 0, True, 200), (" ", "Oferta via API", None, True, 400)]
    assert files.offer_path("x", "d", lambda p: p == "d/x.txt") == "d/x.txt"


def test_service(spark):
    encode = lambda texts: [[float(len(t)), float(t.count("a")), 1.0] for t in texts]
    cvs = spark.createDataFrame([("ana.pdf", "Ana Ruiz\nAnalista\nEXPERIENCIA\nA (2024-2026)."), ("vacio.pdf", "  ")], "archivo string, texto string")
    held = service.ingest(cvs, encode)
    assert held.count() == 1 and held.first()["nombre"] == "Ana Ruiz - Analista"
    cands = held.select(F.lit(1).alias("cand_id"), "nombre", F.col("embedding").alias("v"), "fragmentos", "trozos", F.col("texto_cv").alias("texto"))
    offer = spark.createDataFrame([(9, [1.0, 0.0, 0.0], "Requisitos\n- 5 anos de experiencia")], "offer_id int, v array<float>, texto string")
    out = service.rank_detailed(offer, cands, 2026, top=0)
    r = out.first()
    assert (r["posicion"], r["penalizacion"], r["avisos"]) == (1, pytest.approx(0.15), ["pide 5 años de experiencia, se le calculan 2"]) and r["extracto"].startswith("Ana")
    assert '"total_candidatos":1' in service.response(out).first()["body"]
    assert service.matches(out).first()["score"] == pytest.approx(r["score"], abs=1e-6)


def test_streaming_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("uno")
    seen = []
    q = intake.merge_stream(intake.texts(spark, str(tmp_path / "in")), "archivo", "modified", lambda df, n: seen.extend(df.select("archivo", "texto").collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [tuple(r) for r in seen] == [("a.txt", "uno")]
