"""Text cleaning and normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions import forms, spans

# Accented Latin letters and their bases, and the pairs that
# accent repair composes.
ACCENTED = "ÁÀÄÂÃÅÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇáàäâãåéèëêíìïîóòöôõúùüûñç"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCaaaaaaeeeeiiiiooooouuuunc"
ACUTE = dict(zip("aeiouAEIOU", "áéíóúÁÉÍÓÚ"))
TILDE = dict(zip("nN", "ñÑ"))
BULLETS = "•◦●▪·"
#: White space in Unicode's sense, and the four ASCII separators before the blank.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Unicode white space off both ends, in linear time whatever runs of it a
    text holds."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    """Null, or nothing but Unicode white space."""
    return strip(F.coalesce(c, F.lit(""))) == ""


def normalise(c: Column) -> Column:
    """Lower case without accents, stripped: by full compatibility decomposition,
    for any script."""
    return strip(F.lower(forms.fold(c)))


def normalise_latin(c: Column) -> Column:
    """The same for the accented letters of the table and loose marks alone."""
    bare = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), "[̀-ͯ]", "")
    return strip(F.lower(bare))


def compose(c: Column) -> Column:
    """Canonical composition (NFC) of any text."""
    return forms.compose(c)


def repair_accents(c: Column) -> Column:
    """Loose accents joined to the letter before, else behind them."""
    c = F.translate(c, "ıİ", "iI")
    pairs = [("´", ACUTE), ("˜", TILDE)]
    for mark, letters in pairs:
        for plain, accented in letters.items():
            c = F.replace(c, F.lit(plain + mark), F.lit(accented))
    for mark, letters in pairs:
        for plain, accented in letters.items():
            c = F.replace(c, F.lit(mark + plain), F.lit(accented))
    return c


def clean(c: Column) -> Column:
    """Repair, bullets to blanks, words joined over hyphens at line ends,
    blanks and lines squeezed; the order of the steps matters."""
    c = F.translate(repair_accents(c), BULLETS, " " * len(BULLETS))
    c = F.regexp_replace(c, r"-\s*\n\s*", "")
    c = F.regexp_replace(c, "[ \\t\\r\\f\\x0B]+", " ")
    c = F.regexp_replace(c, "(?m)^ +| +$", "")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def fingerprint(c: Column) -> Column:
    """SHA-256 of the stripped text."""
    return F.sha2(strip(c).cast("binary"), 256)


def located(text: Column, pattern: str) -> Column:
    """End positions (code points) of all matches."""
    return F.transform(spans.matches(text, pattern), lambda x: x["start"] + F.length(x["match"]))
