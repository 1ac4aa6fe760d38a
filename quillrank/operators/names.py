"""Name and job title of a candidate, from the text or the file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.text import strip

# Headings that are not names.
HEADINGS = ("curriculum", "curriculum vitae", "cv", "resume", "resumen", "hoja de vida", "datos personales")
# Fixed value: what a word of a name may look like.
_WORD = r"^[A-Za-zÁÉÍÓÚÜÑáéíóúüñ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ'’.\-]*$"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R", -1), strip), lambda x: x != "")


def _capitals(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def title_case(c: Column) -> Column:
    """Every run of letters starts with a capital, also after - and '."""
    letters = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(letters, F.initcap), "")


def name_from_text(text: Column) -> Column:
    """The first line that is not a heading, if it reads like a name."""
    line = F.get(F.filter(_lines(text), lambda x: ~F.btrim(F.lower(x), F.lit(".:")).isin(*HEADINGS)), F.lit(0))
    words = F.split(line, r"(?U)\s+")
    fits = F.size(words).between(2, 5) & F.length(line).between(5, 60) & F.forall(words, lambda w: w.rlike(_WORD))
    return F.when(fits, F.when(_capitals(line), title_case(line)).otherwise(line))


def title_from_text(text: Column) -> Column:
    """The second non-blank line up to | or ·, unless it reads like contact
    data or a heading."""
    line = F.btrim(F.substring_index(F.substring_index(F.get(_lines(text), F.lit(1)), "|", 1), "·", 1), F.lit(" .,-–—"))
    fits = F.length(line).between(3, 60) & ~line.rlike(r"[@,]|(?U)\d") & ~F.lower(line).isin(*HEADINGS) & ~_capitals(line)
    return F.when(fits, line)


def name_from_file(file: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(file, r"\.[^.]*$", ""), "[_-]", " "), " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(_capitals(w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))), " ")


def candidate_name(file: Column, text: Column, alias: dict[str, str] | None = None) -> Column:
    """Alias, else 'name - title', else name, else the file's name in words."""
    name, title = name_from_text(text), title_from_text(text)
    known = [F.get(F.array(*[F.lit(v) for v in alias.values()]), F.nullif(F.array_position(F.array(*[F.lit(k) for k in alias]), file), F.lit(0).cast("long")).cast("int") - 1)] if alias else []
    return F.coalesce(*known, F.when(name.isNotNull(), F.concat_ws(" - ", name, title)), name_from_file(file))


def preview(text: Column, words: int = 8, width: int = 60) -> Column:
    """The first words of a text, cut to a width; '' for one without text."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return F.substring(F.array_join(F.slice(found, 1, words), " "), 1, width)


def is_named(name: Column, first_names: tuple[str, ...]) -> Column:
    """Whether the first word of a name is one of these, as for controls."""
    return F.get(F.filter(F.split(F.coalesce(name, F.lit("")), r"(?U)\s+"), lambda w: w != ""), F.lit(0)).isin(*first_names)
