"""Secret scan: known shapes plus entropy of candidate strings.

Base findings are regular expressions (assignments, access keys, hex runs).
The method adds candidate strings: runs of one character class over which a
20-character window slides. The window's character counts are carried along,
five bits each in a few longs; a step puts one character in and takes one out,
so two counts change and the sum of c * log2(c), kept in fixed point so that
nothing drifts, changes by four table entries. A candidate is reported if its
highest window reaches the class's limit and no allow-list pattern explains it.

Everything is SQL functions over the row: no shuffle, no Python. Time is linear
in a candidate's length and, up to millions, in a text's number of matches.

Cases: null text counts as empty and has no spans; offsets are code points;
repeated rows are scanned alike; null ids are kept; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.spans import let, matches

# The base patterns and their least lengths.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A run holds no second start that could be longer, so these two can ask for
# their least length in the pattern; an assignment cannot, as a short one hides
# what it covers.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
LEAST = 12
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates of the method: a whole run of this alphabet, of this length on.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Counts of the characters from + to z: bits of each, how many in a long, longs.
_FIRST, _BITS, _LANES = ord("+"), 5, 12
_WORDS = (ord("z") - _FIRST) // _LANES + 1
#: Fixed point of c * log2(c).
_UNIT, _NEVER = 1 << 40, (1 << 63) - 1
#: Character class (tested in order) and the entropy in bits its windows need.
CLASSES = (("^[0-9a-fA-F]+$", 3.01), ("^[A-Za-z0-9]+$", 3.51), ("", 3.61))
#: Runs that are not secrets: no digit or no letter, words joined by signs,
#: (no letter touches a digit; a repeated group would recurse in Java) and
#: identifiers such as UUIDs. Matched against the whole candidate.
ALLOW = ("^[^0-9]*$", "^[^A-Za-z]*$", "^(?!.*[A-Za-z][0-9])(?!.*[0-9][A-Za-z])[A-Za-z0-9][A-Za-z0-9+/_=-]*$", "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def _spans(found: Column, kind: str, keep=None) -> Column:
    kept = found if keep is None else F.filter(found, keep)
    return F.transform(
        kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), (x["start"] + F.length(x["match"])).alias("end"))
    )


def _window_steps(s: Column, window: int) -> Column:
    """For each character, where its count lies and where that of the character
    lies which leaves the window with it (-1: none yet)."""
    code = lambda ch: F.ascii(ch) - _FIRST
    place = lambda n: F.struct((n / _LANES).cast("int").alias("word"), (n % _LANES * _BITS).alias("shift"))
    none = F.array_repeat(F.struct(F.lit(-1).alias("word"), F.lit(0).alias("shift")), window)
    chars = F.transform(F.split(s, ""), lambda ch: place(code(ch)))
    left = lambda c: F.slice(F.concat(none, c), F.lit(1), F.size(c))
    return let(chars, lambda c: F.zip_with(c, left(c), lambda x, y: F.struct(x.alias("new"), y.alias("old"))))


def peak_entropy(s: Column, window: int = WINDOW) -> Column:
    """Highest entropy in bits of any window of the string (of the whole string
    if it is shorter), by incremental counts. For windows of up to 31 characters
    from + to z."""
    weights = F.array(*[F.lit(round(c * math.log2(c) * _UNIT) if c else 0).cast("long") for c in range(window + 2)])
    weight = lambda c: F.get(weights, c.cast("int"))
    count = lambda acc, x: F.call_function("shiftright", F.get(acc["counts"], x["word"]), x["shift"]).bitwiseAND(F.lit((1 << _BITS) - 1))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["shift"])

    def step(acc, x):
        new, old = x["new"], x["old"]
        full = old["word"] >= 0
        same = (new["word"] == old["word"]) & (new["shift"] == old["shift"])
        change = lambda v, j: v + F.when(new["word"] == j, one(new)).otherwise(F.lit(0)) - F.when(old["word"] == j, one(old)).otherwise(F.lit(0))
        moved = weight(count(acc, new) + 1) - weight(count(acc, new)) + F.when(full, weight(count(acc, old) - 1) - weight(count(acc, old))).otherwise(F.lit(0))
        total = F.when(same, acc["total"]).otherwise(acc["total"] + moved)
        n = acc["n"] + 1
        least = F.when((n < window) | (acc["least"] <= total), acc["least"]).otherwise(total)
        return F.struct(n.alias("n"), total.alias("total"), least.alias("least"), F.transform(acc["counts"], change).alias("counts"))

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("n"), zero.alias("total"), F.lit(_NEVER).alias("least"), F.array_repeat(zero, _WORDS).alias("counts"))
    wide = lambda acc: F.least(acc["n"], F.lit(window)).cast("double")
    sum_of = lambda acc: F.when(acc["n"] < window, acc["total"]).otherwise(acc["least"])
    return F.aggregate(_window_steps(s, window), start, step, lambda acc: F.log2(wide(acc)) - sum_of(acc) / _UNIT / wide(acc))


def suspicious(s: Column) -> Column:
    """Long enough, not allow-listed, and of high entropy for its class."""
    limit = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        limit = F.when(s.rlike(pattern), F.lit(bits)).otherwise(limit)
    odd = F.length(s) >= WINDOW
    for pattern in ALLOW:
        odd = odd & ~s.rlike(pattern)
    # CASE keeps the entropy off the many strings the cheap tests reject.
    return F.when(odd, peak_entropy(s) >= limit).otherwise(F.lit(False))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and base and spans: arrays of struct(start, order, end), order
    being the kind's place in KINDS, sorted."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    value = lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= LEAST
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    base = F.concat(_spans(matches(text, ASSIGN), "assign", value), _spans(matches(text, ACCESS), "access"), _spans(matches(text, HEX), "hex"))
    extra = _spans(matches(text, CANDIDATE), "entropy", lambda x: suspicious(x["match"]))
    rows = rows.select("doc_id", base.alias("base"), extra.alias("extra"))
    return rows.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", "extra")).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["order"]), x["start"], x["end"])), ",")
