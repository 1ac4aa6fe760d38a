"""The callable surface: ingest, rank, evaluate, over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import present, rules
from quillrank.functions.text import fingerprint, is_blank
from quillrank.functions.vectors import argmax, dot
from quillrank.operators import chunks, names, ranking, sections
from quillrank.sources import chunk_index

#: Rows of a ranking in one response body.
PAGE = 1000


def ingest(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], limit: int | None = None, count: Callable[[str], int] | None = None) -> DataFrame:
    """(archivo, nombre, texto_cv, fragmentos, trozos, embedding) of texts
    (archivo, texto) that are not blank."""
    docs = texts.where(~is_blank(F.col("texto")))
    parts = chunks.embed(chunks.chunks(docs, limit, count, "archivo"), encoder, "archivo")
    held = parts.groupBy("archivo").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk", "vec"))).alias("f"))
    mean = F.transform(
        F.aggregate("f.vec", F.transform(F.get("f.vec", F.lit(0)), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double"))),
        lambda x: (x / F.size("f")).cast("float"),
    )
    held = held.select("archivo", F.col("f.vec").alias("fragmentos"), F.col("f.chunk").alias("trozos"), mean.alias("embedding"))
    return docs.join(held, "archivo").select("archivo", names.candidate_name(F.col("archivo"), F.col("texto")).alias("nombre"), F.col("texto").alias("texto_cv"), "fragmentos", "trozos", "embedding")


def ingest_report(texts: DataFrame, saved: DataFrame) -> DataFrame:
    """One row per text (archivo, texto) of a batch: status 200 with id, nombre,
    caracteres and dimension of the stored candidate, or 422 and a warning for a
    text that holds nothing (a scan, which would need OCR)."""
    text = F.coalesce("texto", F.lit(""))
    both = texts.select("archivo", text.alias("texto")).join(saved.select("archivo", "id", "nombre", "embedding"), "archivo", "left")
    bad = is_blank(F.col("texto"))
    ok = lambda c: F.when(~bad, c)
    return both.select(
        "archivo", F.when(bad, 422).otherwise(200).alias("status"), ok(F.col("id")).alias("id"), ok(F.col("nombre")).alias("nombre"), ok(F.char_length("texto")).alias("caracteres"),
        ok(F.size("embedding")).alias("dimension"), F.when(bad, F.concat(F.col("archivo"), F.lit(": sin texto extraible, se omite."))).alias("aviso"),
    )


def ingested(report: DataFrame) -> DataFrame:
    """How many texts of a batch were stored, and how many were left out."""
    return report.agg(F.count_if(F.col("status") == 200).alias("guardados"), F.count_if(F.col("status") == 422).alias("omitidos"))


def rank_detailed(offers: DataFrame, candidates: DataFrame, this_year: int, top: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """The ranking of each offer (offer_id, v, texto) over candidates (cand_id,
    nombre, v, fragmentos, trozos, texto) that have a vector: position, raw and
    adjusted score, penalty, notices, best chunk. top 0 or less gives one row. With
    a chunk_index its chunks explain, and candidates need no fragmentos and trozos.
    All that a pair needs is told where it is met, so candidates are not joined again;
    of rankings with a top, only the rows shown look for their chunk."""
    live = candidates.where(F.col("v").isNotNull())
    best = argmax(F.transform("fragmentos", lambda f: dot(f, F.col("o"))))
    chunk = F.coalesce(F.get("trozos", best), F.lit(""))
    kept = ("cand_id", "v", "nombre", *(("fragmentos", "trozos") if top is None and index is None else ()))
    profiled = sections.cv_profiles(live.select(*kept, F.coalesce("texto", F.lit("")).alias("texto")), this_year, kept)
    told = {n: F.col(n) for n in ("nombre", *rules.PENALTIES)}
    scored = ranking.score_pairs(offers, profiled, more={**told, "extracto": chunk} if "trozos" in kept else told)
    asked = sections.offer_requirements(offers.select(F.col("offer_id").alias("doc_id"), "texto")).withColumnRenamed("doc_id", "offer_id")
    out = ranking.adjust(scored, asked).drop(*rules.PENALTIES, *[f"r_{n}" for n in rules.PENALTIES])
    if top is None:
        out = ranking.positions(out, "score_ajustado", "posicion")
    else:
        out = ranking.top_k(out, top, "score_ajustado")
    shown = ("offer_id", "posicion", "cand_id", "nombre", "score", "penalizacion", "score_ajustado", "avisos", "extracto")
    if index is not None:
        return chunk_index.explained(out, offers, index).select(*shown)
    if top is None:
        return out.select(*shown)
    rest = out.join(live.select("cand_id", "fragmentos", "trozos"), "cand_id").join(offers.select("offer_id", F.col("v").alias("o")), "offer_id")
    return rest.withColumn("extracto", chunk).select(*shown)


def rank(offers: DataFrame, candidates: DataFrame, this_year: int) -> DataFrame:
    """(offer_id, posicion, nombre, score): ordered by the adjusted score, shows the raw."""
    return rank_detailed(offers, candidates, this_year).select("offer_id", "posicion", "nombre", "score")


def response(ranking_rows: DataFrame, offers: DataFrame | None = None, page: int = PAGE) -> DataFrame:
    """(offer_id, pagina, status, body): per offer (offer_id, titulo, texto) the
    ranking as JSON objects of up to ``page`` rows, one unless there are more; the
    total counts what is left after top. 400 for a blank text, 409 where no candidate
    has a vector; the body then says why. Without offers, bodies for each offer that
    has rows."""
    row = F.struct("posicion", F.col("nombre").alias("candidato"), F.bround("score", 4).alias("score"), F.bround("score_ajustado", 4).alias("score_ajustado"), "penalizacion", "avisos", "extracto")
    number = F.floor((F.col("posicion") - 1) / page).cast("int").alias("pagina")
    per = ranking_rows.groupBy("offer_id", number).agg(F.sort_array(F.collect_list(row)).alias("ranking"))
    # Pages are few: their sizes add up to the total.
    pages = per.withColumn("total_candidatos", F.sum(F.size("ranking")).over(Window.partitionBy("offer_id")).cast("int"))
    if offers is None:
        return pages.select("offer_id", "pagina", F.lit(200).alias("status"), F.to_json(F.struct("total_candidatos", "ranking")).alias("body"))
    both = offers.select("offer_id", "titulo", "texto").join(pages, "offer_id", "left")
    status = F.when(is_blank(F.col("texto")), 400).when(F.col("ranking").isNull(), 409).otherwise(200)
    good = F.to_json(F.struct("titulo", "total_candidatos", "ranking"))
    bad = F.to_json(F.struct(F.when(F.col("status") == 400, "El campo 'texto' esta vacio.").otherwise("No hay candidatos con embedding.").alias("detail")))
    return both.withColumn("status", status).select("offer_id", F.coalesce("pagina", F.lit(0)).alias("pagina"), "status", F.when(F.col("status") == 200, good).otherwise(bad).alias("body"))


def matches(ranking_rows: DataFrame, when=None) -> DataFrame:
    """Rows to store: the pure cosine as FLOAT, of all candidates, whatever top
    shows, and when they were made (now unless given)."""
    when = F.current_timestamp() if when is None else when
    return ranking_rows.select(F.col("cand_id").cast("int").alias("candidato_id"), F.col("offer_id").cast("int").alias("puesto_id"), F.col("score").cast("float").alias("score"), when.alias("fecha"))


def offer_row(offers: DataFrame) -> DataFrame:
    return offers.withColumn("huella", fingerprint(F.col("texto")))


def shown(ranking_rows: DataFrame) -> DataFrame:
    """What a page shows of a ranking: the leader apart from the rest, quote,
    angle, notice and bar, texts escaped."""
    return ranking.leader(ranking_rows).select(
        "offer_id", "posicion", "es_lider", present.escape(F.col("nombre")).alias("nombre"), "score", present.angle(F.col("score")).alias("grados"),
        present.notice(F.col("avisos")).alias("aviso"), present.escape(present.quote(F.col("extracto"))).alias("cita"), "percent",
    )


def console(ranking_rows: DataFrame) -> DataFrame:
    """(offer_id, posicion, linea): the console table, names as wide as each
    offer's widest; ordered as the ranking, showing the raw score."""
    head = len("CANDIDATO")
    widest = ranking_rows.groupBy("offer_id").agg(F.greatest(F.max(F.char_length("nombre")), F.lit(head)).alias("w"))
    line = present.console_row(F.col("posicion"), F.col("nombre"), F.col("score"), F.col("w"))
    return ranking_rows.join(widest, "offer_id").select("offer_id", "posicion", line.alias("linea"))


def measured(ranking_rows: DataFrame, requirements: DataFrame, controls: tuple[str, ...]) -> DataFrame:
    """Per offer what it asks, the winner, the one before the filter where it
    was another, and the controls' summed positions without and with it."""
    both = ranking.rank_shift(ranking_rows.select("offer_id", "cand_id", "nombre", "score", "score_ajustado"))
    control = names.is_named(F.col("nombre"), controls)
    first = lambda c: F.max(F.when(F.col(c) == 1, F.col("nombre")))
    per = both.groupBy("offer_id").agg(
        first("adj_pos").alias("ganador"), first("raw_pos").alias("antes"), F.count_if(control).alias("controles"),
        F.sum(F.when(control, F.col("raw_pos"))).alias("sin_filtro"), F.sum(F.when(control, F.col("adj_pos"))).alias("con_filtro"),
    )
    per = per.withColumn("antes", F.when(F.col("antes") != F.col("ganador"), F.col("antes")))
    asks = requirements.select("offer_id", rules.asked_label(F.col("anios"), F.col("titulacion"), F.col("ingles")).alias("pide"))
    return per.join(asks, "offer_id", "left")
