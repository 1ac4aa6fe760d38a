"""Queries over the driver tables, one per operator or group of operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.functions import present, rules, text, vectors
from quillrank.operators import chunks, names, pruned, ranking, sections, subwords
from quillrank.plans import config, fixtures, profiles, service
from quillrank.plans.sql import SQL
from quillrank.sources import bucketed, chunk_index, files, landing, pdf, staging, tables

__all__ = ["QUERIES", "SQL"]
QUERIES: dict = {}
K, N_OFFERS, PLACES = 5, 5, 6


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cvs(spark, d):
    return spark.sql(fixtures.CVS, customer=_t(spark, d, "customer"), orders=_t(spark, d, "orders"))


def _offers(spark):
    return spark.sql(fixtures.OFFERS)


def _all_offers(spark, d):
    """The written offers, and one for each part."""
    return _offers(spark).unionAll(spark.sql(fixtures.PART_OFFERS, part=_t(spark, d, "part")))


def _pairs(spark, d):
    """Offers are the first vectors, a fixed number; the rest are candidates."""
    e = _t(spark, d, "embeddings").withColumnRenamed("embedding", "v")
    offers = e.where(F.col("vec_id") < N_OFFERS).select(F.col("vec_id").alias("offer_id"), "v")
    return ranking.score_pairs(offers, e.where(F.col("vec_id") >= N_OFFERS).withColumnRenamed("vec_id", "cand_id"))


def _required(spark, d):
    i = F.col("vec_id").cast("int")
    return _t(spark, d, "embeddings").where(i < N_OFFERS).select(
        F.col("vec_id").alias("offer_id"), F.when(i % 4 != 3, 3 + i).alias("anios"), F.when(i % 2 == 0, 2 + i % 2).alias("titulacion"), F.when(i != 3, 4 + i % 3).alias("ingles")
    )


def _profiles(spark, d):
    i = F.col("vec_id").cast("int")
    return _t(spark, d, "embeddings").where(i >= N_OFFERS).select(
        F.col("vec_id").alias("cand_id"), F.when(i % 11 != 0, i % 9).alias("anios"), F.nullif(i % 4, F.lit(0)).alias("titulacion"), F.nullif(i % 7, F.lit(0)).alias("ingles")
    )


def _adjusted(spark, d):
    """Scores rounded first, so that both engines order the same numbers."""
    scored = _pairs(spark, d).withColumn("score", F.round("score", PLACES))
    out = ranking.adjust(scored, _required(spark, d), _profiles(spark, d))
    return out.withColumn("score_ajustado", F.round("score_ajustado", PLACES))


@query
def cosine_rank_topk(spark, d):
    return ranking.top_k(_pairs(spark, d).withColumn("score", F.round("score", PLACES)), K).select("offer_id", "posicion", "cand_id", "score")


@query
def pruned_rank_topk(spark, d):
    """The best candidates of many offers, without meeting all pairs."""
    e = _t(spark, d, "embeddings").withColumnRenamed("embedding", "v")
    offers = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("offer_id"), "v")
    found = pruned.top_k(offers, e.where(F.col("vec_id") % 20 != 0).withColumnRenamed("vec_id", "cand_id"), K, places=PLACES)
    return found.rows.select("offer_id", "posicion", "cand_id", "score")


@query
def offer_candidate_matrix(spark, d):
    return _pairs(spark, d).select("offer_id", "cand_id", F.round("score", PLACES).alias("score"))


def _fragments(spark, d):
    return _t(spark, d, "embeddings").where(F.col("vec_id") >= N_OFFERS).select("label", "vec_id", F.col("embedding").alias("v"))


@query
def best_fragment(spark, d):
    """Fragments of a label: the closest to each offer, the first on ties."""
    scored = _pairs(spark, d).withColumn("score", F.round("score", PLACES)).join(_fragments(spark, d).select("label", F.col("vec_id").alias("cand_id")), "cand_id")
    return scored.groupBy("offer_id", "label").agg(F.max_by("cand_id", F.struct("score", -F.col("cand_id"))).alias("best"), F.max("score").alias("score"))


@query
def fragment_centroid(spark, d):
    unit = _fragments(spark, d).withColumn("v", vectors.unit(F.col("v")))
    return chunks.centroids(unit, "label", "v").select("label", "dim", F.round("x", PLACES).alias("x"))


@query
def pooling_ablation(spark, d):
    scored = _pairs(spark, d).join(_fragments(spark, d).select("label", F.col("vec_id").alias("cand_id")), "cand_id")
    per = ranking.best_scores(scored, ("offer_id", "label"), 3)
    kinds = ("mean", "mean70", "mean50", "mean30", "top3", "top2", "max")
    return per.select("offer_id", "label", *[F.round(vectors.pooled(F.col("mean"), F.col("top"), k), PLACES).alias(k) for k in kinds])


@query
def penalty_verdict(spark, d):
    out = _adjusted(spark, d)
    return out.select("offer_id", "cand_id", "penalizacion", F.array_join("avisos", " · ").alias("avisos"))


@query
def adjusted_rank(spark, d):
    return ranking.top_k(_adjusted(spark, d), K, "score_ajustado").select("offer_id", "posicion", "cand_id", "score", "penalizacion", "score_ajustado")


@query
def rank_shift(spark, d):
    return ranking.rank_shift(_adjusted(spark, d)).select("offer_id", "cand_id", "raw_pos", "adj_pos", "shift")


@query
def control_positions(spark, d):
    """Controls are candidates of label 0: their mean position per offer."""
    controls = _t(spark, d, "embeddings").where("label = 0").select(F.col("vec_id").alias("cand_id"))
    out = ranking.rank_shift(_adjusted(spark, d)).join(controls, "cand_id", "left_semi")
    return out.groupBy("offer_id").agg(F.count("*").alias("n"), F.round(F.avg("raw_pos"), PLACES).alias("raw_mean"), F.round(F.avg("adj_pos"), PLACES).alias("adj_mean"))


@query
def winner_change(spark, d):
    per = _adjusted(spark, d).groupBy("offer_id").agg(
        F.max_by("cand_id", F.struct("score", -F.col("cand_id"))).alias("before"), F.max_by("cand_id", F.struct("score_ajustado", -F.col("cand_id"))).alias("winner")
    )
    return per.select("offer_id", "winner", F.when(F.col("before") != F.col("winner"), F.concat(F.lit("antes: "), F.col("before").cast("string"))).otherwise("").alias("note"))


@query
def score_heatmap(spark, d):
    return _pairs(spark, d).groupBy("cand_id").pivot("offer_id", list(range(N_OFFERS))).agg(F.first(F.round("score", PLACES))).select("cand_id", *[F.col(str(i)).alias(f"offer_{i}") for i in range(N_OFFERS)])


@query
def angle_degrees(spark, d):
    return _pairs(spark, d).select("offer_id", "cand_id", F.round(present.angle(F.col("score")), 4).alias("grados"))


@query
def rank_bar(spark, d):
    s = F.round("score", PLACES)
    return _pairs(spark, d).select("offer_id", "cand_id", present.bar(s).alias("bar"), F.round(present.percent(s), 4).alias("percent"))


@query
def section_segment_cv(spark, d):
    return sections.cv_sections(_cvs(spark, d))


@query
def section_segment_offer(spark, d):
    return sections.offer_sections(_all_offers(spark, d))


@query
def cv_profile(spark, d):
    return sections.cv_profiles(_cvs(spark, d), fixtures.THIS_YEAR)


@query
def offer_requirements(spark, d):
    return sections.offer_requirements(_all_offers(spark, d))


@query
def years_interval_union(spark, d):
    y = F.year("o_orderdate")
    per = _t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.struct(y.alias("start"), (y + 1 + F.col("o_custkey").cast("int") % 3).alias("end"))).alias("spans"))
    return per.select("o_custkey", rules.union_years(F.col("spans")).cast("int").alias("anios"))


@query
def years_phrase(spark, d):
    return _cvs(spark, d).select("doc_id", rules.years_by_phrase(F.col("texto")).alias("anios"))


@query
def degree_level(spark, d):
    return _cvs(spark, d).select("doc_id", rules.degree_level(F.col("texto")).alias("titulacion"))


@query
def english_level(spark, d):
    return _cvs(spark, d).select("doc_id", rules.english_level(F.col("texto")).alias("ingles"))


@query
def extractor_coverage(spark, d):
    p = sections.cv_profiles(_cvs(spark, d), fixtures.THIS_YEAR)
    return p.agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull()).alias(f"sin_{c}") for c in ("anios", "titulacion", "ingles")])


@query
def accent_repair(spark, d):
    broken = F.replace(F.replace(F.replace("text", F.lit("ó"), F.lit("o´")), F.lit("é"), F.lit("´e")), F.lit("ñ"), F.lit("n˜"))
    return _t(spark, d, "documents").select("doc_id", F.md5(text.repair_accents(broken).cast("binary")).alias("h"))


@query
def clean_text(spark, d):
    dirty = F.replace(F.replace(F.replace("text", F.lit(". "), F.lit("-\n ")), F.lit(" de "), F.lit(" •\t\t ")), F.lit(",\n"), F.lit("\n\n\n\n"))
    return _t(spark, d, "documents").select("doc_id", F.md5(text.clean(dirty).cast("binary")).alias("h"))


@query
def candidate_name(spark, d):
    return _cvs(spark, d).select("doc_id", names.candidate_name(F.col("archivo"), F.col("texto"), {"CV1.pdf": "CV1"}).alias("nombre"), names.name_from_file(F.col("archivo")).alias("de_archivo"))


@query
def candidate_title(spark, d):
    return _cvs(spark, d).select("doc_id", names.name_from_text(F.col("texto")).alias("nombre"), names.title_from_text(F.col("texto")).alias("puesto"))


@query
def sentence_units(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(chunks.units(F.col("text"))).alias("pos", "unit")).select("doc_id", "pos", F.md5(F.col("unit").cast("binary")).alias("h"))


@query
def chunk_pack(spark, d):
    out = chunks.chunks(_t(spark, d, "documents").select("doc_id", F.col("text").alias("texto")))
    return out.select("doc_id", "pos", F.md5(F.col("chunk").cast("binary")).alias("h"), F.length("chunk").alias("chars"))


@query
def chunk_pack_subword(spark, d):
    """Chunks by the tokens of a vocabulary file."""
    known = subwords.counter(spark, config.settings(spark, "/").vocabulary)
    out = subwords.subword_chunks(_t(spark, d, "documents").select("doc_id", F.col("text").alias("texto")), known)
    return out.select("doc_id", "pos", F.md5(F.col("chunk").cast("binary")).alias("h"), F.length("chunk").alias("chars"))


@query
def hashed_embedding_score(spark, d):
    offers = _t(spark, d, "benchmark").select(F.col("item_id").alias("offer_id"), F.col("text").alias("texto"))
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("texto"))
    scored = chunks.top_scores(chunks.hashed_terms(offers, key="offer_id"), chunks.hashed_terms(docs), K)
    return ranking.top_k(scored.withColumn("score", F.round("score", PLACES)), K, tie="doc_id").select("offer_id", "posicion", "doc_id", "score")


@query
def upsert_latest(spark, d):
    """Last event per user, with the time of the first."""
    e = _t(spark, d, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return tables.latest(e.select("user_id", F.col("ts").alias("seq"), "value", F.col("ts").alias("fecha_alta")), ("user_id",), "seq", ("fecha_alta",)).select(
        "user_id", F.round("value", 4).alias("value"), F.date_format("seq", "yyyy-MM-dd HH:mm:ss").alias("seq"), F.date_format("fecha_alta", "yyyy-MM-dd HH:mm:ss").alias("fecha_alta")
    )


@query
def upsert_merge(spark, d):
    """Every third customer comes again with a new balance, and new ones come."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("archivo"), F.col("c_acctbal").cast("double").alias("saldo"))
    stored, new = c.where("id % 2 = 0"), c.where("id % 3 = 0").select((F.col("id") + 1000000).alias("id"), "archivo", (F.col("saldo") + 1).alias("saldo"))
    return tables.upsert(stored, new, ("archivo",), ("id",)).select("id", "archivo", F.round("saldo", 2).alias("saldo"))


@query
def offer_fingerprint(spark, d):
    padded = F.concat(F.lit(" \t\n"), "text", F.lit("\n "))
    return _t(spark, d, "benchmark").select("item_id", text.fingerprint(padded).alias("huella"))


@query
def cascade_delete(spark, d):
    gone = _t(spark, d, "customer").where("c_custkey % 10 <> 0")
    return tables.cascade(_t(spark, d, "orders"), gone, "o_custkey", "c_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


def _candidates(spark, d):
    """Stored candidates: some without a vector, some without fragments, some
    whose text is null. Vectors are those of the driver's table, each used often."""
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("e"))
    i = F.col("doc_id").cast("long")
    held = _cvs(spark, d).withColumns({"a": i % 480 + 6, "b": i % 480 + 7})
    held = held.join(e.withColumnsRenamed({"vec_id": "a", "e": "v"}), "a").join(e.withColumnsRenamed({"vec_id": "b", "e": "w"}), "b")
    day = F.timestamp_seconds(F.lit(1_700_000_000) + i * 3600)
    return held.select(
        i.cast("int").alias("id"), F.concat(F.lit("cand "), i.cast("string")).alias("nombre"), F.concat(i.cast("string"), F.lit("_"), "archivo").alias("archivo"),
        F.when(i % 13 != 4, F.col("texto")).alias("texto_cv"), F.when(i % 7 != 3, F.col("v")).alias("embedding"),
        F.when(i % 5 != 2, F.array("v", "w")).alias("fragmentos"), day.alias("fecha_alta"),
    )


def _files(spark, d):
    return _candidates(spark, d).where("id % 4 <> 1").select("archivo")


@query
def candidate_listing(spark, d):
    return tables.listing(_candidates(spark, d))


@query
def candidate_detail(spark, d):
    out = tables.with_files(_candidates(spark, d), _files(spark, d))
    return out.select("id", "nombre", "archivo", F.md5(F.col("texto").cast("binary")).alias("h"), "caracteres", "fecha_alta", "indexado", "pdf_disponible")


@query
def candidate_by_id(spark, d):
    return tables.detail(_candidates(spark, d), _files(spark, d), 7).select("id", "archivo", "indexado", "pdf_disponible")


@query
def candidate_pdf(spark, d):
    """Every third id and some that do not exist; one name leaves the folder."""
    c = _candidates(spark, d).withColumn("archivo", F.when(F.col("id") == 9, "../x.pdf").otherwise(F.col("archivo")))
    asked = c.where("id % 3 = 0").select("id").unionAll(c.where("id % 50 = 0").select(-F.col("id") - 1))
    return tables.pdf_lookup(asked, c, _files(spark, d))


@query
def vector_scan(spark, d):
    out = tables.scan_vectors(_candidates(spark, d))
    return out.select("id", "nombre", F.size("embedding").alias("dimension"), F.size("fragmentos").alias("n"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("x0"))


def _blank(i):
    """Texts that hold nothing but white space, of one kind or another."""
    return F.when(i % 3 == 0, "  ").when(i % 3 == 1, "\n\t").otherwise("\u00a0\u2003")


@query
def upload_statuses(spark, d):
    i = F.col("doc_id")
    name = F.concat("source", F.when(i % 4 == 0, ".pdf").when(i % 4 == 1, ".PDF").when(i % 4 == 2, ".docx").otherwise(""))
    docs = _t(spark, d, "documents").select("doc_id", name.alias("file"), F.when(i % 5 != 0, F.col("text")).otherwise(_blank(i)).alias("text"))
    return docs.select("doc_id", files.upload_status(F.col("file"), F.col("text")).alias("status"))


@query
def json_requests(spark, d):
    """Requests with some of their fields, as they come in."""
    i = F.col("item_id").cast("int")
    body = F.to_json(F.struct(
        F.when(i % 5 == 0, _blank(i)).when(i % 7 != 0, F.col("text")).alias("texto"), F.when(i % 2 == 0, F.concat(F.lit("Oferta "), i.cast("string"))).alias("titulo"), F.when(i % 3 == 0, i % 4).alias("top"), F.when(i % 4 == 0, F.lit(False)).alias("guardar"),
    ))
    got = files.requests(_t(spark, d, "benchmark").select(body.alias("body")))
    return got.select(F.md5(F.col("texto").cast("binary")).alias("h"), "titulo", "top", "guardar", "status")


@query
def stdin_offer(spark, d):
    """Texts as bytes, with some that are no UTF-8 behind them."""
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF41FE")))
    return _t(spark, d, "benchmark").select("item_id", F.md5(files.decoded(raw).cast("binary")).alias("h"))


@query
def offer_titles(spark, d):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 2 == 0, "_o'neil-SQL.txt").otherwise(".txt"))
    return _t(spark, d, "part").select("p_partkey", files.offer_title(name).alias("titulo"))


@query
def pdf_text(spark, d):
    """Texts put on pages of PDF files and read from them again."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("archivo"), pdf.render(F.coalesce("text", F.lit(""))).alias("content"))
    return files.pdf_texts(docs).select(F.col("archivo").alias("doc_id"), F.md5(F.col("texto").cast("binary")).alias("h"), "error")


@query
def landed_uploads(spark, d):
    """Uploaded files, some of another kind or without text: what became of each,
    and the text of what was stored."""
    i = F.col("doc_id")
    name = F.concat(F.lit("doc_"), i.cast("string"), F.when(i % 4 == 0, ".PDF").when(i % 4 == 3, ".docx").otherwise(".pdf"))
    up = _t(spark, d, "documents").select(name.alias("archivo"), pdf.render(F.when(i % 5 == 0, _blank(i)).otherwise(F.coalesce("text", F.lit("")))).alias("content"))
    table = bucketed.Table(spark, f"{staging.own_dir(spark)}/archivos-{uuid.uuid4().hex}", "archivos").create(landing.none(spark), 8)
    said = landing.land(up, table)
    held = files.pdf_texts(table.read()).select("archivo", F.md5(F.col("texto").cast("binary")).alias("h"))
    return said.join(held, "archivo", "left").select("archivo", "status", "h")


@query
def table_schemas(spark, d):
    """Of the stored tables, and of those given."""
    out = tables.described(spark)
    for name in ("documents", "embeddings", "benchmark", "labels"):
        out = out.unionAll(tables.described(spark, {name: _t(spark, d, name).schema}))
    return out


def _at(seconds: int):
    return F.timestamp_seconds(F.lit(1_800_000_000 + seconds))


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _saved(spark, name, stored, new, buckets=8):
    """A stored table after a merge."""
    table = bucketed.Table(spark, f"{staging.own_dir(spark)}/{name}-{uuid.uuid4().hex}", name).create(stored, buckets)
    table.merge(new)
    return table.read()


@query
def save_candidates(spark, d):
    """Known files come again with a new name and text, twice, and new ones come."""
    stored = _candidates(spark, d).where("id % 2 = 0").select("id", "archivo", "nombre", "texto_cv", "fecha_alta")
    come = _candidates(spark, d).where("id % 3 = 0").select("archivo", F.concat("nombre", F.lit(" bis")).alias("nombre"), F.lit("texto").alias("texto_cv"))
    new = come.withColumn("fecha_alta", _at(9)).unionByName(come.withColumns({"nombre": F.lit("viejo"), "fecha_alta": _at(5)}))
    out = _saved(spark, "candidatos", stored, new)
    return out.select("id", "archivo", "nombre", F.md5(F.coalesce("texto_cv", F.lit("")).cast("binary")).alias("h"), _stamp("fecha_alta").alias("fecha_alta"))


@query
def save_offers(spark, d):
    """An offer that comes again keeps its description, not its title."""
    b = _t(spark, d, "benchmark").groupBy(F.col("text").alias("texto")).agg(F.min("item_id").cast("int").alias("id"))
    row = lambda df, title, at: service.offer_row(df).select("id", F.lit(title).alias("titulo"), F.concat(F.lit(title), F.lit(": "), "texto").alias("descripcion"), "huella", at.alias("fecha_alta"))
    stored = row(b.where("id % 2 = 0"), "Uno", _at(0))
    new = row(b.where("id % 3 = 0").withColumn("texto", F.concat(F.lit("\n "), "texto", F.lit(" "))), "Dos", _at(7)).drop("id")
    out = _saved(spark, "puestos", stored, new)
    return out.select("id", "titulo", F.md5(F.regexp_replace("descripcion", r"\s", "").cast("binary")).alias("h"), "huella", _stamp("fecha_alta").alias("fecha_alta"))


@query
def save_matches(spark, d):
    """Ranking again updates score and time of a pair, and adds new pairs."""
    got = service.matches(ranking.score_pairs(_offer_rows(spark, d), _ranked_candidates(spark, d).where("v is not null")), _at(0))
    stored = got.where("(candidato_id + puesto_id) % 2 = 0")
    again = got.where("candidato_id % 3 = 0").withColumns({"score": (F.col("score") / 2).cast("float"), "fecha": _at(60)})
    out = _saved(spark, "matches", stored, again)
    return out.select("candidato_id", "puesto_id", F.round(F.col("score").cast("double"), 5).alias("score"), _stamp("fecha").alias("fecha"))


def _offer_rows(spark, d):
    v = _t(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("doc_id"), F.col("embedding").alias("v"))
    return _offers(spark).join(v, "doc_id").select(F.col("doc_id").cast("int").alias("offer_id"), F.concat(F.lit("Oferta "), F.col("doc_id").cast("string")).alias("titulo"), "v", "texto")


def _ranked_candidates(spark, d):
    c = _candidates(spark, d)
    pieces = F.array(*[F.concat(F.lit(f"{x} de "), "nombre") for x in ("inicio", "final")])
    return c.select(F.col("id").alias("cand_id"), "nombre", F.col("embedding").alias("v"), F.coalesce("fragmentos", F.array().cast("array<array<float>>")).alias("fragmentos"), pieces.alias("trozos"), F.col("texto_cv").alias("texto"))


def _ranking(spark, d, top=None):
    return service.rank_detailed(_offer_rows(spark, d), _ranked_candidates(spark, d), fixtures.THIS_YEAR, top)


@query
def rank_detailed(spark, d):
    out = _ranking(spark, d)
    return out.select("offer_id", "posicion", "cand_id", "nombre", F.round("score", PLACES).alias("score"), "penalizacion", F.round("score_ajustado", PLACES).alias("score_ajustado"), F.array_join("avisos", " · ").alias("avisos"), "extracto")


def _chunk_index(spark, d):
    """The chunks of the candidates' texts, stored with vectors of the driver's table."""
    parts = chunks.chunks(_candidates(spark, d).select(F.col("id").alias("cand_id"), F.col("texto_cv").alias("texto")), 12, key="cand_id")
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("of"), F.col("embedding").alias("vec"))
    held = parts.withColumn("of", (F.col("cand_id").cast("long") * 7 + F.col("pos") * 13) % 400).join(e, "of")
    name = f"chunks_{uuid.uuid4().hex}"
    return chunk_index.store(held, name, f"{staging.own_dir(spark)}/{name}", 8)


@query
def rank_explained(spark, d):
    """Rankings explained from stored chunks."""
    out = service.rank_detailed(_offer_rows(spark, d), _ranked_candidates(spark, d).drop("fragmentos", "trozos"), fixtures.THIS_YEAR, 20, _chunk_index(spark, d))
    return out.select("offer_id", "posicion", "cand_id", "extracto")


@query
def rank(spark, d):
    return service.rank(_offer_rows(spark, d), _ranked_candidates(spark, d), fixtures.THIS_YEAR).select("offer_id", "posicion", "nombre", F.round("score", PLACES).alias("score"))


@query
def match_response(spark, d):
    """The answer to each offer: the first three rows, or why there are none. A
    blank offer and one for which no candidate has a vector come along."""
    offers = _offer_rows(spark, d)
    odd = spark.createDataFrame([(7, "Vacía", " "), (8, "Sin nadie", "Requisitos"), (9, "Tabulador", "\n\t"), (10, "Fijo", "\u00a0"), (11, "Nula", None)], "offer_id int, titulo string, texto string")
    out = service.response(_ranking(spark, d, 3), offers.select("offer_id", "titulo", "texto").unionByName(odd))
    get = lambda path: F.get_json_object("body", path)
    return out.select(
        "offer_id", "status", get("$.titulo").alias("titulo"), get("$.total_candidatos").cast("int").alias("total"), get("$.ranking[0].candidato").alias("primero"),
        get("$.ranking[2].candidato").alias("tercero"), get("$.ranking[0].avisos[0]").alias("aviso"), get("$.ranking[1].posicion").cast("int").alias("segunda"), get("$.detail").alias("detail"),
    )


@query
def top_zero(spark, d):
    """top 0 or less still gives one row."""
    return _ranking(spark, d, 0).select("offer_id", "posicion", "nombre")


@query
def shown_ranking(spark, d):
    out = service.shown(_ranking(spark, d, 8))
    return out.select("offer_id", "posicion", "es_lider", "nombre", F.round("grados", 4).alias("grados"), "aviso", "cita", F.round("percent", 4).alias("percent"))


@query
def console_table(spark, d):
    return service.console(_ranking(spark, d, 8))


@query
def ranking_measurement(spark, d):
    """Controls are told by the first word of the name."""
    rows = _ranking(spark, d).withColumn("nombre", F.concat(F.when(F.col("cand_id") % 20 == 0, "Beatriz ").when(F.col("cand_id") % 20 == 1, "Javier ").otherwise("Otra "), F.col("cand_id").cast("string")))
    asks = sections.offer_requirements(_offers(spark)).withColumn("offer_id", F.col("doc_id").cast("int"))
    return service.measured(rows, asks, ("Beatriz", "Javier"))


@query
def fragment_index(spark, d):
    """The place of the fragment closest to the first offer; none gives 0."""
    offer = _offer_rows(spark, d).where("offer_id = 1").select(F.col("v").alias("o"))
    c = _ranked_candidates(spark, d).crossJoin(ranking.hinted(offer))
    return c.select("cand_id", vectors.argmax(F.transform("fragmentos", lambda f: vectors.dot(f, F.col("o")))).alias("indice"))


def _batch(spark, d):
    """Texts to take in; some are null, and some blank in other ways."""
    i = F.col("id")
    return _candidates(spark, d).select("archivo", F.when(i % 17 == 5, _blank(i)).otherwise(F.col("texto_cv")).alias("texto"))


@query
def ingest_batch(spark, d):
    """Texts, some blank, go in; each says what became of it."""
    texts = _batch(spark, d)
    encode = chunks.lazy("lengths", lambda: lambda parts: [[float(len(p)), 1.0] for p in parts])
    empty = spark.createDataFrame([], "id int, nombre string, archivo string, texto_cv string, embedding array<float>, fecha_alta timestamp")
    new = service.ingest(texts, encode).select("nombre", "archivo", "texto_cv", "embedding").withColumn("fecha_alta", _at(0))
    report = service.ingest_report(texts, tables.save("candidatos", empty, new))
    return report.select("archivo", "status", "id", "nombre", "caracteres", "dimension", "aviso")


@query
def ingest_count(spark, d):
    texts = _batch(spark, d)
    saved = _candidates(spark, d).select("archivo", "id", "nombre", "embedding")
    return service.ingested(service.ingest_report(texts, saved))


@query
def text_preview(spark, d):
    return _t(spark, d, "documents").select("doc_id", names.preview(F.col("text")).alias("inicio"), F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"))


@query
def nfc_compose(spark, d):
    """Texts whose accents have come apart are put together again."""
    apart = F.col("text")
    for plain, accented in text.ACUTE.items():
        apart = F.replace(apart, F.lit(accented), F.lit(plain + "\u0301"))
    return _t(spark, d, "documents").select("doc_id", F.md5(text.compose(apart).cast("binary")).alias("h"))


@query
def plain_text(spark, d):
    """Lower case without accents, by decomposition (any script) and by table."""
    return _t(spark, d, "documents").select("doc_id", F.md5(text.normalise(F.col("text")).cast("binary")).alias("por_formas"), F.md5(text.normalise_latin(F.col("text")).cast("binary")).alias("por_tabla"))


@query
def profile_extraction(spark, d):
    """Candidates from their parts to a text and back to a profile: each customer
    is one of the invented sixteen, some years later."""
    docs = profiles.peopled(_t(spark, d, "customer").select(F.col("c_custkey").alias("id")))
    return sections.cv_profiles(docs.select(F.col("id").alias("doc_id"), profiles.profile_text().alias("texto")), fixtures.THIS_YEAR)


@query
def coverage_report(spark, d):
    """The extractor's findings per candidate, '-' where a text tells nothing."""
    p = sections.cv_profiles(_cvs(spark, d), fixtures.THIS_YEAR)
    level = F.get(F.array(*[F.lit(k.upper()) for k in rules.LEVELS]), F.col("ingles") - 1)
    said = {"anios": F.col("anios").cast("string"), "titulacion": rules.chosen(F.col("titulacion"), rules.DEGREE_SHORT, "string"), "ingles": level}
    return p.select("doc_id", *[F.coalesce(v, F.lit("-")).alias(k) for k, v in said.items()])


@query
def health_count(spark, d):
    return tables.health(_t(spark, d, "embeddings"))


@query
def semi_text_fetch(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("texto_cv"))
    ids = _t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return tables.texts_of(docs, ids).select("id", F.md5(F.col("texto").cast("binary")).alias("h"))


@query
def quote_extract(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(present.quote(F.col("text")).cast("binary")).alias("h"))


@query
def html_escape(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(present.escape(F.col("html")).cast("binary")).alias("h"))


@query
def char_totals(spark, d):
    n = F.sum(F.char_length("text"))
    return _t(spark, d, "documents").agg(F.count("*").alias("docs"), n.alias("chars"), F.floor(n / F.count("*")).cast("long").alias("mean_chars"), F.max(F.char_length("source")).cast("long").alias("widest"))


@query
def vector_json(spark, d):
    """Vectors to JSON text and back keep every float."""
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    back = e.select("vec_id", "v", F.from_json(F.to_json("v"), "array<float>").alias("b"))
    total = F.aggregate("b", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", F.size("b").cast("long").alias("dim"), (F.col("v") == F.col("b")).alias("same"), F.round(total, 5).alias("suma"))
