"""Presentation scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.text import strip

# Where a quote looks for a header in capitals, how long it may
# be, and what a header is.
QUOTE_HEAD, QUOTE_LIMIT = 220, 320
_HEADER = r"(?U)\b[A-ZÁÉÍÓÚÑ]{2,}(?:\s+[A-ZÁÉÍÓÚÑ]{2,})*\b"


def angle(score: Column) -> Column:
    """Degrees between two vectors of this cosine."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))))


def bar(score: Column, width: int = 20) -> Column:
    n = F.bround(F.greatest(score, F.lit(0.0)) * width).cast("int")
    return F.rpad(F.repeat(F.lit("#"), n), width, ".")


def quote(text: Column, limit: int = QUOTE_LIMIT) -> Column:
    """White space collapsed; from the first header in capitals near the
    start; cut at the last blank before the limit."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    at = F.regexp_instr(F.substring(flat, 1, QUOTE_HEAD), F.lit(_HEADER))
    flat = F.when(at > 1, F.substr(flat, at)).otherwise(flat)
    head = F.substring(flat, 1, limit)
    return F.when(F.length(flat) > limit, F.concat(F.regexp_replace(head, r"(?s)^(.*) .*$", "$1"), F.lit("..."))).otherwise(flat)


def escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def notice(avisos: Column) -> Column:
    """Why a candidate has gone down, escaped for HTML; '' if nothing is said."""
    return escape(F.array_join(F.coalesce(avisos, F.array().cast("array<string>")), " · "))


def percent(score: Column) -> Column:
    """Width of a score's bar; scores below 0 have none."""
    return F.greatest(score, F.lit(0.0)) * 100


def console_row(position: Column, name: Column, score: Column, width: Column) -> Column:
    """A line of the console ranking: place, name (as wide as the widest),
    score with four decimals and its bar."""
    number = F.lpad(F.format_string("%.4f", score), 10, " ")
    place = position.cast("string")
    place = F.when(F.length(place) < 4, F.rpad(place, 4, " ")).otherwise(place)
    return F.concat(place, F.rpad(name, width + 4, F.lit(" ")), number, F.lit("  "), bar(score))
