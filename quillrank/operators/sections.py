"""Sections of a text: each line belongs to the last header before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions import rules
from quillrank.functions.spans import let
from quillrank.functions.text import strip


def segments(text: Column, header: Callable[[Column], Column], section: Callable[[Column], Column]) -> Column:
    """array<struct(section, lines)> of a text, in its order: the lines before any
    header are under 'otros', as are those of unknown headers; header lines drop
    out. A fold over the text's lines within its row, in linear time."""

    def cut(lines):
        number = F.sequence(F.lit(0), F.size(lines) - 1)
        opens = F.filter(number, lambda i: header(F.get(lines, i)))
        # A part opens at each header, and one before the first line.
        return let(F.concat(F.array(F.lit(-1)), opens, F.array(F.size(lines))), lambda at: parts(lines, at))

    def parts(lines, at):
        def one(i):
            start, end = F.get(at, i), F.get(at, i + 1)
            name = F.when(start < 0, F.lit("otros")).otherwise(section(F.get(lines, start)))
            return F.struct(name.alias("section"), F.slice(lines, start + 2, end - start - 1).alias("lines"))

        return F.transform(F.sequence(F.lit(0), F.size(at) - 2), one)

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), cut)


def joined(held: Column, name: str) -> Column:
    """The text of all parts of a section; '' where there is none."""
    own = F.flatten(F.transform(F.filter(held, lambda p: p["section"] == name), lambda p: p["lines"]))
    return strip(F.array_join(own, "\n"))


def segment(docs: DataFrame, header: Callable[[Column], Column], section: Callable[[Column], Column], names: tuple[str, ...], key: str = "doc_id", text: str = "texto") -> DataFrame:
    """(key, section, text) of every section of names with lines, each row of docs
    by itself: nothing is shuffled."""
    held = docs.select(key, segments(F.col(text), header, section).alias("parts"))
    full = lambda n: F.exists("parts", lambda p: (p["section"] == n) & (F.size(p["lines"]) > 0))
    rows = F.filter(F.array(*[F.struct(F.lit(n).alias("section"), joined(F.col("parts"), n).alias("text"), full(n).alias("full")) for n in names]), lambda r: r["full"])
    return held.select(key, F.explode(rows).alias("r")).select(key, "r.section", "r.text")


CV_SECTIONS = tuple(dict.fromkeys([*rules.CV_HEADERS.values(), "otros"]))
OFFER_SECTIONS = tuple(dict.fromkeys([*rules.OFFER_HEADERS.values(), "otros"]))


def cv_sections(docs: DataFrame) -> DataFrame:
    return segment(docs, rules.cv_header, rules.cv_section, CV_SECTIONS)


def offer_sections(docs: DataFrame) -> DataFrame:
    return segment(docs, rules.offer_header, rules.offer_section, OFFER_SECTIONS)


def cv_profiles(docs: DataFrame, this_year: int, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, anios, titulacion, ingles; null means unknown. Each row by itself,
    with the columns that are kept."""
    held = docs.select(*kept, "texto", segments(F.col("texto"), rules.cv_header, rules.cv_section).alias("parts"))
    own = {"texto": F.col("texto"), **{n: joined(F.col("parts"), n) for n in ("experiencia", "formacion", "idiomas")}}
    # One normalisation of each text, read by all rules.
    held = held.select(*kept, *[rules.plain_text(c).alias(n) for n, c in own.items()])
    return held.select(
        *kept, rules.cv_years_of(F.col("experiencia"), F.col("texto"), this_year).alias("anios"), rules.degree_level_of(F.col("formacion")).alias("titulacion"), rules.english_level_of(F.col("idiomas")).alias("ingles")
    )


def offer_requirements(docs: DataFrame) -> DataFrame:
    """doc_id, anios, titulacion, ingles; null means not asked."""
    held = docs.select("doc_id", segments(F.col("texto"), rules.offer_header, rules.offer_section).alias("parts"))
    held = held.select("doc_id", rules.plain_text(joined(F.col("parts"), "requisitos")).alias("r"))
    r = F.col("r")
    return held.select("doc_id", rules.years_by_phrase_of(r).alias("anios"), rules.degree_level_of(r).alias("titulacion"), rules.english_level_of(r).alias("ingles"))
