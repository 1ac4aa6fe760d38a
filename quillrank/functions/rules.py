"""Rules that read requirements and profiles out of section texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.text import located, normalise, strip

# Section headers after normalisation, and the section of each.
CV_HEADERS = {
    "perfil": "perfil", "profile": "perfil", "resumen": "perfil",
    "experiencia": "experiencia", "experiencia laboral": "experiencia", "experiencia profesional": "experiencia",
    "experience": "experiencia", "work experience": "experiencia",
    "formacion": "formacion", "formacion academica": "formacion", "education": "formacion",
    "idiomas": "idiomas", "languages": "idiomas",
}
OFFER_HEADERS = {
    "requisitos": "requisitos", "requisitos minimos": "requisitos", "que buscamos": "requisitos", "lo que buscamos": "requisitos",
    "requirements": "requisitos", "what we are looking for": "requisitos",
    "se valorara": "valorado", "se valoraran": "valorado", "valorable": "valorado", "nice to have": "valorado", "bonus": "valorado",
}
OFFER_CLOSERS = (
    "que ofrecemos", "what we offer", "que te ofrecemos", "beneficios", "benefits", "sobre el puesto", "about the role", "about the job",
    "sobre nosotros", "que haras en el dia a dia", "what you will do", "tus funciones", "tus principales funciones seran", "funciones",
    "responsabilidades", "trabajar con nosotros te aportara", "condiciones",
)
# Language levels, the phrases that stand for one (tried in this
# order) and the languages that end a mention of English.
LEVELS = {"a1": 1, "a2": 2, "b1": 3, "b2": 4, "c1": 5, "c2": 6}
LEVEL_PHRASES = {
    "nativo": 6, "nativa": 6, "native": 6, "bilingue": 6, "bilingual": 6,
    "nivel alto": 5, "fluido": 5, "fluida": 5, "fluent": 5, "avanzado": 5,
}
OTHER_LANGUAGES = "frances|french|aleman|german|italiano|italian|portugues|portuguese|catalan|valenciano|espanol|spanish|chino|chinese"
# Patterns of degrees (on normalised text) and number words.
VOCATIONAL = r"\bgrado superior\b|\bfp\b|\bformacion profesional\b"
MASTER = r"\bmaster\b|\bmsc\b|\bmba\b|\bdoctorad|\bphd\b|\bdoctor\b"
DEGREE = r"\bgrado\b|\blicenciatur|\bingenieria\b|\bbachelor\b|\bbsc\b|\bdegree\b"
NUMBER_WORDS = {
    "un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10,
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
}
YEAR = r"19[89]\d|20[0-4]\d"
TODAY = "actualidad|actual|presente|hoy|present|now|current"
RANGE = rf"\b({YEAR})\s*[-–—/]\s*({YEAR}|{TODAY})\b"
_N = r"\d{1,2}|" + "|".join(NUMBER_WORDS)
PHRASE = rf"\b({_N})\s*\+?\s*anos?\s+(?:de\s+experiencia|\w+ando|\w+iendo|of\s+experience)|\b({_N})\s*\+?\s*years?\s+of\s+experience"
# Penalty per missing unit and its cap.
PENALTIES = {"anios": (0.05, 0.20), "titulacion": (0.04, 0.08), "ingles": (0.03, 0.09)}
DEGREE_NAMES = {1: "FP o Grado Superior", 2: "Grado", 3: "Máster"}
# The short names of degrees in the measurement reports.
DEGREE_SHORT = {1: "FP", 2: "Grado", 3: "Master"}


def chosen(key: Column, table: dict, kind: str = "int") -> Column:
    """Look a key up in a small fixed table; null where absent."""
    return F.get(F.array(*[F.lit(v) for v in table.values()]), F.nullif(F.array_position(F.array(*[F.lit(k) for k in table]), key), F.lit(0).cast("long")).cast("int") - 1).cast(kind)


def cv_header(line: Column) -> Column:
    """A short line in capitals without figures or brackets."""
    x = strip(line)
    return (x != "") & (F.length(x) <= 40) & ~x.endswith(".") & ~x.rlike(r"[0-9(]") & (x == F.upper(x)) & x.rlike("[A-ZÁÉÍÓÚÑ]{3}")


def cv_section(line: Column) -> Column:
    """Section a header line opens; unknown headers open 'otros'."""
    return F.coalesce(chosen(F.rtrim(normalise(line), F.lit(":")), CV_HEADERS, "string"), F.lit("otros"))


def offer_title(line: Column) -> Column:
    """Normalised line; colons go after the stripping, so blanks before stay."""
    return F.rtrim(normalise(line), F.lit(":"))


def offer_header(line: Column) -> Column:
    """A known title, or a short label that ends in a colon."""
    x = strip(line)
    known = offer_title(line).isin(*OFFER_HEADERS, *OFFER_CLOSERS)
    label = x.endswith(":") & ~x.contains(".") & ~x.contains(",")
    return (x != "") & (F.length(x) <= 60) & ~x.rlike(r"^[-*•]") & (known | label)


def offer_section(line: Column) -> Column:
    return F.coalesce(chosen(offer_title(line), OFFER_HEADERS, "string"), F.lit("otros"))


def plain_text(text: Column) -> Column:
    """What the rules below read. They take it from here, so that a text that
    several of them read can be normalised once, in a projection of its own."""
    return normalise(F.coalesce(text, F.lit("")))


def english_level(text: Column) -> Column:
    return english_level_of(plain_text(text))


def degree_level(text: Column) -> Column:
    return degree_level_of(plain_text(text))


def years_by_ranges(text: Column, this_year: int) -> Column:
    return years_by_ranges_of(plain_text(text), this_year)


def years_by_phrase(text: Column) -> Column:
    return years_by_phrase_of(plain_text(text))


def cv_years(experience: Column, whole: Column, this_year: int) -> Column:
    return cv_years_of(plain_text(experience), plain_text(whole), this_year)


def english_level_of(plain: Column) -> Column:
    """1 to 6 by the first mention of English that a level follows within 80
    characters and before another language; null if none."""
    windows = F.transform(located(plain, r"\bingles\b|\benglish\b"), lambda e: F.substr(plain, e + 1, F.lit(80)))
    windows = F.transform(windows, lambda w: F.regexp_extract(w, rf"(?s)^(.*?)(?:{OTHER_LANGUAGES}|\z)", 1))

    def level(w):
        phrase = F.coalesce(*[F.when(w.contains(p), F.lit(n)) for p, n in LEVEL_PHRASES.items()])
        return F.coalesce(chosen(F.regexp_extract(w, r"\b([abc][12])\b", 1), LEVELS), phrase)

    return F.get(F.filter(F.transform(windows, level), lambda x: x.isNotNull()), F.lit(0))


def degree_level_of(plain: Column) -> Column:
    """3 master, 2 degree, 1 vocational: the highest named; null if none."""
    rest = F.regexp_replace(plain, r"\bgrado superior\b", " ")
    return F.greatest(F.when(plain.rlike(VOCATIONAL), 1), F.when(rest.rlike(MASTER), 3), F.when(rest.rlike(DEGREE), 2))


def union_years(spans: Column) -> Column:
    """Length of the union of array<struct<start, end>>; null if empty."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-(1 << 30)).alias("upto"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")
    )
    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"]))


def years_by_ranges_of(plain: Column, this_year: int) -> Column:
    spans = F.zip_with(
        F.regexp_extract_all(plain, F.lit(RANGE), F.lit(1)), F.regexp_extract_all(plain, F.lit(RANGE), F.lit(2)),
        lambda a, b: F.struct(a.cast("int").alias("start"), F.coalesce(b.try_cast("int"), F.lit(this_year)).alias("end")),
    )
    return union_years(F.filter(spans, lambda s: s["end"] >= s["start"]))


def years_by_phrase_of(plain: Column) -> Column:
    n = F.coalesce(*[F.nullif(F.regexp_extract(plain, PHRASE, i), F.lit("")) for i in (1, 2)])
    return F.coalesce(n.try_cast("int"), chosen(n, NUMBER_WORDS))


def cv_years_of(experience: Column, whole: Column, this_year: int) -> Column:
    """Ranges of the experience section if they add up to anything, else the
    phrase anywhere; a total of 0 counts as no ranges."""
    return F.coalesce(F.nullif(years_by_ranges_of(experience, this_year), F.lit(0)), years_by_phrase_of(whole))


def asked_label(anios: Column, titulacion: Column, ingles: Column) -> Column:
    """What an offer asks for, in short: '5a,Grado,B2'; '-' if nothing."""
    level = F.get(F.array(*[F.lit(k.upper()) for k in LEVELS]), ingles - 1)
    said = F.concat_ws(",", F.concat(anios.cast("string"), F.lit("a")), chosen(titulacion, DEGREE_SHORT, "string"), level)
    return F.when(said == "", F.lit("-")).otherwise(said)


def verdict(asked: dict[str, Column], has: dict[str, Column]) -> Column:
    """struct(penalizacion, avisos): only what is asked and known to be less."""
    terms, notices = [], []
    level = lambda c: F.get(F.array(*[F.lit(k.upper()) for k in LEVELS]), c - 1)
    degree = lambda c: chosen(c, DEGREE_NAMES, "string")
    wording = {
        "anios": lambda r, p: F.format_string("pide %d años de experiencia, se le calculan %d", r, p),
        "titulacion": lambda r, p: F.format_string("pide %s, acredita %s", degree(r), F.coalesce(degree(p), F.lit("ninguna titulación"))),
        "ingles": lambda r, p: F.format_string("pide inglés %s, acredita %s", level(r), level(p)),
    }
    for name, (unit, cap) in PENALTIES.items():
        r, p = asked[name], has[name]
        terms.append(F.when(p < r, F.least((r - p) * unit, F.lit(cap))).otherwise(F.lit(0.0)))
        notices.append(F.when(p < r, wording[name](r, p)))
    return F.struct(F.bround(sum(terms[1:], terms[0]), 4).alias("penalizacion"), F.filter(F.array(*notices), lambda x: x.isNotNull()).alias("avisos"))
