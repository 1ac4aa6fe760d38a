"""Unicode normalisation forms as column expressions, JVM only.

The tables follow by rule from Python's `unicodedata`; Hangul syllables are
reckoned by their numbering. A text is cut where normalisation cannot reach
across, so that only pieces with something to do are taken apart; within a piece
all steps are linear in its length.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import chain
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbering of Hangul: first syllable, and the letters of each place.
SYLLABLES = 0xAC00
LEADS, VOWELS, TAILS = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
_PER_VOWEL, _LAST = len(TAILS) + 1, 0x10FFFF
_PER_LEAD = len(VOWELS) * _PER_VOWEL
_N_SYLLABLES = len(LEADS) * _PER_LEAD
_SEP = "\x01"
_PRIVATE = 0xF0000


class Tables(NamedTuple):
    order: dict  # mark -> combining class
    canonical: dict  # character -> full canonical decomposition
    folded: dict  # character -> full compatibility decomposition without marks
    pairs: dict  # two characters -> their composite
    late: frozenset  # starters that may join the one before
    reach: tuple  # characters, and late starters, that a composite takes in at most


@cache
def tables() -> Tables:
    order, canonical, folded, pairs = {}, {}, {}, {}
    # No decomposition or mark is assigned above these planes.
    for c in map(chr, chain(range(0xA0, SYLLABLES), range(SYLLABLES + _N_SYLLABLES, 0xD800), range(0xE000, 0x30000))):
        parts = unicodedata.decomposition(c)
        if unicodedata.combining(c):
            order[c] = unicodedata.combining(c)
        if not parts and c not in order:
            continue
        full = unicodedata.normalize("NFD", c)
        if full != c:
            canonical[c] = full
        folded[c] = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        two = parts.split()
        if len(two) == 2 and "<" not in parts and unicodedata.normalize("NFC", c) == c:
            pairs["".join(chr(int(x, 16)) for x in two)] = c
    late = frozenset(x[1] for x in pairs if x[1] not in order) | set(VOWELS + TAILS)
    made = [canonical[c] for c in pairs.values()]
    reach = max(len(x) for x in made) - 1, max(2, *(sum(y in late for y in x[1:]) for x in made))
    return Tables(order, canonical, folded, pairs, late, reach)


def _ranges(points) -> list[tuple[int, int]]:
    out: list = []
    for p in sorted(points):
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def _complement(ranges) -> list[tuple[int, int]]:
    low, out = 0, []
    for a, b in ranges:
        if a > low:
            out.append((low, a - 1))
        low = b + 1
    return out + ([(low, _LAST)] if low <= _LAST else [])


def _class(ranges, block: int = 16) -> str:
    """A character class whose blocks are passed over by their span: a character
    is not held against each range. A first range that begins at nought, which
    holds the Latin letters, is tried before the others."""
    if ranges[0][0] == 0:
        return f"[\\x{{0}}-\\x{{{ranges[0][1]:X}}}{_class(ranges[1:], block)}]"
    groups = [ranges[i : i + block] for i in range(0, len(ranges), block)]
    span = lambda g: f"\\x{{{g[0][0]:X}}}-\\x{{{g[-1][1]:X}}}"
    one = lambda g: "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in g)
    return f"[{span(ranges)}&&[" + "".join(f"[{span(g)}&&[{one(g)}]]" for g in groups) + "]]"


def _both(points) -> tuple[str, str]:
    """Classes of the characters, and of all others."""
    r = _ranges(points)
    return _class(r), _class(_complement(r))


@cache
def patterns() -> dict[str, str]:
    t = tables()
    moving = {ord(c) for c in chain(t.order, t.late, (c for c in t.canonical if unicodedata.normalize("NFC", c) != c))}
    touched, still = _both(moving)
    mark, starter = _both(map(ord, t.order))
    late, _ = _both(map(ord, t.late))
    _, first = _both(map(ord, chain(t.order, t.late)))
    long, short = _both(chain((ord(c) for c, x in t.folded.items() if len(x) > 1), range(SYLLABLES, SYLLABLES + _N_SYLLABLES)))
    return {
        "touched": touched,
        "pieces": f"{still}+(?!{touched})|{still}?{touched}+",
        "clusters": f"{first}{mark}*(?:{late}{mark}*){{0,{t.reach[1]}}}|{late}{mark}*|{mark}+",
        "groups": f"{starter}{mark}*|{mark}+",
        "long": long,
        "long_pieces": f"{long}|{short}+",
    }


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _listed(values) -> Column:
    return F.split(F.lit(_SEP.join(values)), _SEP)


def _chars(c: Column) -> Column:
    return F.split(c, "")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _place(c: Column, keys: str) -> Column:
    """Where a character stands in keys, null if it does not: translation hashes
    its table once, and a private-use character carries the place."""
    coded = F.translate(c, keys, "".join(chr(_PRIVATE + i) for i in range(len(keys))))
    return _let(coded, lambda x: F.when(x != c, F.ascii(x) - _PRIVATE))


def _looked_up(c: Column, table: dict) -> Column:
    """The entry of a character, null for any other."""
    return _let(_place(c, "".join(table)), lambda i: F.when(i.isNotNull(), F.get(_listed(table.values()), i)))


def _letters(c: Column) -> Column:
    """The letters of a Hangul syllable, null for other characters."""
    at = lambda s, i: F.substr(F.lit(s), i.cast("int") + 1, F.lit(1))
    tail = lambda n: F.when(n % _PER_VOWEL > 0, at(TAILS, n % _PER_VOWEL - 1)).otherwise("")
    body = lambda n: F.concat(at(LEADS, F.floor(n / _PER_LEAD)), at(VOWELS, F.floor(n % _PER_LEAD / _PER_VOWEL)), tail(n))
    return _let(F.ascii(c) - SYLLABLES, lambda n: F.when(n.between(0, _N_SYLLABLES - 1), body(n)))


def _character(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")


def _pair(a: Column, b: Column) -> Column:
    """The composite of two characters, or null."""
    t = tables().pairs
    firsts, seconds = ("".join(sorted({x[i] for x in t})) for i in (0, 1))
    grid = _listed(t.get(x + y, "") for x in firsts for y in seconds)
    at = _let(F.struct(_place(a, firsts).alias("a"), _place(b, seconds).alias("b")), lambda x: F.nullif(F.get(grid, x["a"] * len(seconds) + x["b"]), F.lit("")))
    n = F.ascii(a) - SYLLABLES
    syllable = n.between(0, _N_SYLLABLES - 1) & (n % _PER_VOWEL == 0)
    return (
        F.when(a.between(LEADS[0], LEADS[-1]) & b.between(VOWELS[0], VOWELS[-1]), _character(SYLLABLES + (F.ascii(a) - ord(LEADS[0])) * _PER_LEAD + (F.ascii(b) - ord(VOWELS[0])) * _PER_VOWEL))
        .when(syllable & b.between(TAILS[0], TAILS[-1]), _character(SYLLABLES + n + F.ascii(b) - ord(TAILS[0]) + 1))
        .otherwise(at)
    )


def _absorbed(cur: Column, marks: Column) -> Column:
    """(cur, marks, at): a starter with the marks that it takes in, left to right;
    a mark is reached unless one of its class, or of a higher one, stands before."""

    def step(s, _):
        free = lambda m, i: (i >= s["at"]) & ((i == 0) | (F.get(s["marks"], i - 1)["k"] < m["k"]))
        hits = F.transform(s["marks"], lambda m, i: F.struct(i.alias("i"), F.when(free(m, i), _pair(s["cur"], m["ch"])).alias("c")))
        hit = F.get(F.filter(hits, lambda h: h["c"].isNotNull()), F.lit(0))

        def taken(h):
            left = F.concat(F.slice(s["marks"], F.lit(1), h["i"]), F.slice(s["marks"], h["i"] + 2, F.size(s["marks"])))
            return F.when(h.isNull(), s).otherwise(F.struct(h["c"].alias("cur"), left.alias("marks"), h["i"].alias("at")))

        return _let(hit, taken)

    start = F.struct(cur.alias("cur"), marks.alias("marks"), F.lit(0).alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(tables().reach[0])), start, step)


def _ordered(group: Column) -> Column:
    """Characters of a starter and its marks, by combining class, else as they came."""
    k = lambda ch: F.coalesce(_looked_up(ch, {c: str(n) for c, n in tables().order.items()}).cast("int"), F.lit(0))
    return F.array_sort(F.transform(_chars(group), lambda ch, i: F.struct(k(ch).alias("k"), i.alias("i"), ch.alias("ch"))))


def _text(cur: Column, marks: Column) -> Column:
    return F.concat(cur, F.array_join(F.transform(marks, lambda m: m["ch"]), ""))


def _composed(cluster: Column) -> Column:
    """A first starter, its marks, and the late starters that may join it."""

    def step(s, chars):
        first, rest = F.get(chars, F.lit(0))["ch"], F.slice(chars, F.lit(2), F.size(chars))

        def joined(two):
            done = F.when(two.isNull(), F.concat(s["done"], _text(s["cur"], s["marks"]))).otherwise(s["done"])
            return _let(_absorbed(F.coalesce(two, first), rest), lambda a: F.struct(done.alias("done"), a["cur"].alias("cur"), a["marks"].alias("marks")))

        return _let(F.when((F.size(s["marks"]) == 0) & (s["cur"] != ""), _pair(s["cur"], first)), joined)

    none = F.array().cast("array<struct<k:int,i:int,ch:string>>")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("cur"), none.alias("marks"))
    groups = F.transform(_all(cluster, patterns()["groups"]), _ordered)
    return F.aggregate(groups, start, step, lambda s: F.concat(s["done"], _text(s["cur"], s["marks"])))


def _taken_apart(piece: Column) -> Column:
    one = lambda ch: F.coalesce(_looked_up(ch, tables().canonical), _letters(ch), ch)
    return F.array_join(F.transform(_chars(piece), one), "")


def compose(c: Column) -> Column:
    """Canonical composition (NFC); null stays null."""
    p = patterns()
    whole = lambda piece: F.array_join(F.transform(_all(_taken_apart(piece), p["clusters"]), _composed), "")
    # Most pieces are a letter and its mark: their composite, if any, is the form.
    two = lambda x: F.when(F.char_length(x) == 2, _pair(F.left(x, F.lit(1)), F.right(x, F.lit(1))))
    # A piece to be taken apart is one whose last character is touched.
    done = lambda x: F.when(F.right(x, F.lit(1)).rlike(p["touched"]), F.coalesce(two(x), whole(x))).otherwise(x)
    pieces = F.transform(_all(c, p["pieces"]), done)
    return F.when(c.rlike(p["touched"]), F.array_join(pieces, "")).otherwise(c)


def fold(c: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining marks; as all marks
    go, their order does not matter."""
    t, p = tables().folded, patterns()
    short = {k: v for k, v in t.items() if len(v) == 1}
    gone = "".join(k for k, v in t.items() if not v)
    several = {k: v for k, v in t.items() if len(v) > 1}
    # A piece of several characters is one without long decompositions.
    one = lambda x: F.when(F.char_length(x) == 1, F.coalesce(_letters(x), _looked_up(x, several), x)).otherwise(x)
    wide = F.when(c.rlike(p["long"]), F.array_join(F.transform(_all(c, p["long_pieces"]), one), "")).otherwise(c)
    return F.when(F.octet_length(c) > F.char_length(c), F.translate(wide, "".join(short) + gone, "".join(short.values()))).otherwise(c)
