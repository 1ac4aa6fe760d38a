import pytest
from pyspark.sql import functions as F

from quillrank.functions import rules
from quillrank.operators import ranking, sections

YEAR = 2026
CVS = [
    ("EXPERIENCIA\nBackend en Acme (2019-2024).", (5, None, None)),
    ("EXPERIENCIA\nA (2021-2026).\nB (2019-2021).\nC (2018-2019).", (8, None, None)),
    ("EXPERIENCIA\nA (2020-2024).\nFORMACION\nGrado (2014-2018).", (4, 2, None)),
    ("EXPERIENCIA\nA (2023 - actualidad).", (3, None, None)),
    ("EXPERIENCIA\nA (2021-2026). Un monolito de siete anos.", (5, None, None)),
    ("PERFIL\nsiete anos de experiencia gestionando", (7, None, None)),
    ("PERFIL\n6 anos de experiencia", (6, None, None)),
    ("PERFIL\nnada", (None, None, None)),
    ("PERFIL\n3 anos de experiencia\nEXPERIENCIA\nA (2026-2026)", (3, None, None)),
    ("FORMACION\nMaster en IA y Grado", (None, 3, None)),
    ("FORMACION\nGrado Superior en DAW", (None, 1, None)),
    ("EDUCATION\nBSc in Maths", (None, 2, None)),
    ("IDIOMAS\nEspanol, Valenciano nativo, Ingles C1", (None, None, 5)),
    ("IDIOMAS\nIngles C1. Frances B1.", (None, None, 5)),
    ("LANGUAGES\nEnglish native. Spanish fluent.", (None, None, 6)),
    ("IDIOMAS\nIngles: nivel alto.", (None, None, 5)),
    ("PERFIL\nIngles C2", (None, None, None)),
    ("IDIOMAS\nIngles y english fluent, C2", (None, None, 6)),
    ("", (None, None, None)),
    (None, (None, None, None)),
]
OFFERS = [
    ("Requisitos\n- Minimo 5 anos de experiencia", (5, None, None)),
    ("Requisitos\n- Al menos 1 ano de experiencia", (1, None, None)),
    ("Requisitos\n- Al menos tres anos de experiencia", (3, None, None)),
    ("Requisitos\n- 3+ anos de experiencia", (3, None, None)),
    ("Requirements\n- At least 3 years of experience", (3, None, None)),
    ("Requisitos\n- Grado", (None, 2, None)),
    ("Se valorara\n- 5 anos de experiencia\n- Ingles B2", (None, None, None)),
    ("Requisitos\n- Master\n- Ingles B2", (None, 3, 4)),
    ("Requirements\n- Minimum English level C1", (None, None, 5)),
    ("Requisitos\n- React\nQue ofrecemos\n- ingenieria", (None, None, None)),
    ("Requisitos\n- React\nOtras cosas:\n- Grado", (None, None, None)),
    ("Requisitos :\n- 1 ano de experiencia", (None, None, None)),
]


@pytest.mark.parametrize("kind", ["cv", "offer"])
def test_extraction(spark, kind):
    cases = CVS if kind == "cv" else OFFERS
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, texto string")
    out = sections.cv_profiles(docs, YEAR) if kind == "cv" else sections.offer_requirements(docs)
    got = {r["doc_id"]: (r["anios"], r["titulacion"], r["ingles"]) for r in out.collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_sections(spark):
    text = "hola\nEXPERIENCIA LABORAL\nA (2021-2026)\nMVC.\nB\n(2018-2019).\nFORMACION\nC\nTECNOLOGIAS\nD"
    docs = spark.createDataFrame([(1, text)], "doc_id int, texto string")
    got = {r["section"]: r["text"] for r in sections.cv_sections(docs).collect()}
    assert got == {"otros": "hola\nD", "experiencia": "A (2021-2026)\nMVC.\nB\n(2018-2019).", "formacion": "C"}


VERDICTS = [
    ((3, 2, 4), (5, 3, 5), 0.0, 0), ((5, 2, 5), (None, None, None), 0.0, 0), ((None, None, None), (1, 1, 1), 0.0, 0), ((5, None, None), (3, None, None), 0.10, 1),
    ((12, None, None), (2, None, None), 0.20, 1), ((None, None, 5), (None, None, 4), 0.03, 1), ((None, 3, None), (None, 2, None), 0.04, 1), ((5, 3, 5), (4, 2, 4), 0.12, 3),
]


def test_verdict(spark):
    rows = [(i, *r, *p) for i, (r, p, _, _) in enumerate(VERDICTS)]
    df = spark.createDataFrame(rows, "i int, ra int, rt int, ri int, pa int, pt int, pi int")
    names = ("anios", "titulacion", "ingles")
    v = rules.verdict(dict(zip(names, map(F.col, ("ra", "rt", "ri")))), dict(zip(names, map(F.col, ("pa", "pt", "pi")))))
    for r in df.select("i", v.alias("v")).collect():
        assert (r["v"]["penalizacion"], len(r["v"]["avisos"])) == (pytest.approx(VERDICTS[r["i"]][2]), VERDICTS[r["i"]][3])
    said = {a for r in df.select(v.alias("v")).collect() for a in r["v"]["avisos"]}
    assert "pide 5 años de experiencia, se le calculan 3" in said and "pide inglés C1, acredita B2" in said and "pide Máster, acredita Grado" in said


def test_ranking_keeps_the_score(spark):
    scored = spark.createDataFrame([(1, 1, 0.60), (1, 2, 0.55), (1, 3, 0.50)], "offer_id int, cand_id int, score double")
    asks = spark.createDataFrame([(1, 5, None, None)], "offer_id int, anios int, titulacion int, ingles int")
    has = spark.createDataFrame([(1, 2, None, None), (2, 10, None, None)], "cand_id int, anios int, titulacion int, ingles int")
    out = ranking.rank_shift(ranking.adjust(scored, asks, has)).orderBy("cand_id").collect()
    assert [r["score"] for r in out] == [0.60, 0.55, 0.50]
    assert [r["penalizacion"] for r in out] == [pytest.approx(0.15), 0.0, 0.0]
    assert [r["adj_pos"] for r in out] == [3, 1, 2] and [r["shift"] for r in out] == [2, -1, -1]
    assert ranking.top_k(scored, 0).count() == 1
