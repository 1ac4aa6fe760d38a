"""Mix sources to target weights by Pareto order sampling.

A source's target is shared among its documents by grade, the number of bits
of a document's size: expected copies are in proportion to it, up to the most
that a document may have. Their whole part is taken for certain; the rest is
the inclusion probability p of one more copy. Each document draws u from a hash
and gets the Pareto rank (u / (1 - u)) / (p / (1 - p)); documents enter in rank
order until their words reach the words still missing.

The cut in that order is found without sorting a source in one task: ranks
are counted into 4096 buckets per level, only the bucket that holds the cut is
split further, and only its last few rows are ordered. The windows over sources
take one row per source, per source and grade, or per source and bucket.

Cases: null text has size 0 and is taken 0 words; a null source is a source
of its own, last; sources without words have target 0; u is drawn from id, text
and, where rows of a source agree in both, their number, so repeated and null
ids draw apart and equal rows enter by count, whichever of them it is; null ids
count as an empty id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.store import broadcast_if_small, written

#: Most copies of one document, and so of a source's size in its target.
MAX_COPIES = 3
#: Relative weights, dealt to the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
_LEVELS = 2
_FAN = 4096
#: Rows that are numbered together.
_BLOCK = 4096
_SPACE = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null has none."""
    text = F.coalesce(text, F.lit(""))
    edge = lambda c: F.when(c.rlike(_SPACE), 1).otherwise(0)
    pieces = F.size(F.split(text, _SPACE + "+", -1)) - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1))
    return F.when(F.length(text) == 0, 0).otherwise(pieces).cast("long")


def uniform(key: Column) -> Column:
    """A fraction in (0, 1) from 52 bits of the key's MD5; the same each run."""
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: source_size, target. Works on sources only.

    Capped sharing has a level L with target = min(cap, L * weight); sources
    are capped in order of cap / weight, so running sums give the level.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("w", dealt).withColumn("cap", F.col("source_size").cast("double") * max_copies)
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum(F.col("source_size")).over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight)
    # The first source in that order whose cap is not below the level sets it.
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    per = per.withColumn("level", F.min_by(fits, F.when(fits.isNotNull(), F.col("cap") / F.col("w"))).over(everything))
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.lit(0.0)).alias("target"))


def grade(size: Column) -> Column:
    """A document's share of copies next to others of its source: the bits of
    its size, so that longer texts have higher odds, but no text dominates."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")


def shares(sized: DataFrame, per: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source and grade: whole copies, and the odds p of one more.
    Expected copies are level * grade, at most max_copies, with the level that
    meets the source's target; missing is what the whole copies leave of it."""
    cells = sized.where("size > 0").groupBy("source", "grade").agg(F.sum("size").alias("words")).join(
        per.select(F.col("source").alias("_source"), "target"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    higher = Window.partitionBy("source").orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy("source").orderBy(F.col("grade").desc()).rowsBetween(0, Window.unboundedFollowing)
    own = Window.partitionBy("source")
    left = F.col("target") - F.coalesce(F.sum("words").over(higher), F.lit(0)).cast("double") * max_copies
    cells = cells.withColumn("level", left / F.sum(F.col("grade") * F.col("words")).over(lower).cast("double"))
    # The highest grade whose copies are not above the most sets the level.
    fits = F.when(F.col("level") * F.col("grade") <= max_copies, F.col("level"))
    cells = cells.withColumn("level", F.max_by(fits, F.when(fits.isNotNull(), F.col("grade"))).over(own))
    cells = cells.withColumn("expected", F.coalesce(F.least(F.lit(float(max_copies)), F.col("level") * F.col("grade")), F.lit(float(max_copies))))
    cells = cells.withColumn("whole", F.floor(F.col("expected") + F.lit(1e-9)).cast("long"))
    p = F.col("expected") - F.col("whole")
    missing = F.greatest(F.col("target") - F.sum(F.col("whole") * F.col("words")).over(own), F.lit(0.0))
    return cells.select("source", "grade", "whole", F.when(p > 1e-9, p).otherwise(F.lit(0.0)).alias("p"), missing.alias("missing"))


def _occurrences(held: DataFrame) -> DataFrame:
    """held with nth: the number of each row among equal ones (source, id and
    text), from 0. Only rows that have equals are numbered, in blocks of the
    order in which they were written."""
    tied = written(held.groupBy("_tie").agg(F.count("*").alias("n")).where("n > 1").select("_tie"))
    n = tied.count()
    if n == 0:
        return held.withColumn("nth", F.lit(0).cast("long"))
    mark = broadcast_if_small(tied, n)
    some = held.join(mark, "_tie", "left_semi").select("_row", "_tie", F.floor(F.col("_row") / _BLOCK).alias("_block"))
    some = written(some)
    run = Window.partitionBy("_tie").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = some.groupBy("_tie", "_block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_tie", "_block").orderBy("_row")) - 1
    numbers = some.withColumn("within", within).join(blocks, ["_tie", "_block"]).select("_row", (F.col("before") + F.col("within")).alias("nth"))
    both = held.join(mark, "_tie", "left_semi").join(written(numbers), "_row")
    return held.join(mark, "_tie", "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(both)


def pareto_mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, id_col="doc_id", text_col="text", source_col="source", keep=()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, and the columns in keep."""
    kept = [f"_keep_{i}" for i in range(len(keep))]
    text = F.substring(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), 1, 16)
    held = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), text.alias("_text"), *[F.col(c).alias(k) for c, k in zip(keep, kept)]
    )
    # Written once: sizes are counted once, rows get a number that stays, and
    # the passes below read a few narrow columns.
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_text")
    held = held.select("doc_id", "source", "size", grade(F.col("size")).alias("grade"), name.alias("_name"), F.xxhash64(name, "source", F.col("source").isNull()).alias("_tie"), F.monotonically_increasing_id().alias("_row"), *kept)
    held = written(held)
    per = _hinted(targets(held, weights, max_copies))
    plan = _hinted(shares(held, per, max_copies))

    def join(a: DataFrame, b: DataFrame, *also: str) -> DataFrame:
        b = b.withColumnsRenamed({c: f"_b_{c}" for c in ("source", *also)})
        same = F.col("source").eqNullSafe(F.col("_b_source"))
        for c in also:
            same = same & (F.col(c) == F.col(f"_b_{c}"))
        return a.join(b, same, "left").drop(*[f"_b_{c}" for c in ("source", *also)])

    def ranked(df):
        """rank: the Pareto rank, for documents that may get one more copy;
        key tells them apart; u is the rank on a scale from 0 to 1."""
        key = F.concat_ws("|", "_name", F.col("nth").cast("string"))
        df = join(df, plan, "grade").withColumn("key", key).withColumn("draw", uniform(key))
        odds = (F.col("draw") / (1 - F.col("draw"))) / (F.col("p") / (1 - F.col("p")))
        df = df.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds))
        return df.withColumn("u", F.col("rank") / (1 + F.col("rank"))).drop("draw")

    rows = _occurrences(held)
    light = ranked(rows.select("source", "size", "grade", "_name", "nth")).where(F.col("u").isNotNull()).select("source", "size", "key", "u", "rank", "missing")
    cut = light.groupBy("source").agg(F.max("missing").alias("missing")).select("source", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("words_before"), "missing")
    scale = 1
    for _ in range(_LEVELS):
        coarse, scale = scale, scale * _FAN
        cut = _hinted(cut)
        inside = join(light.drop("missing"), cut).where(F.floor(F.col("u") * coarse) == F.col("cell"))
        cells = inside.groupBy("source", F.floor(F.col("u") * scale).alias("fine")).agg(F.sum("size").alias("words"), F.max("words_before").alias("words_before"), F.max("missing").alias("missing"))
        run = Window.partitionBy("source").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("words_before", F.col("words_before") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        cut = cells.where(F.col("words_before") <= F.col("missing")).groupBy("source").agg(
            F.max("fine").alias("cell"), F.max_by("words_before", "fine").alias("words_before"), F.max("missing").alias("missing")
        )
    cut = _hinted(cut)
    # Within the last cell: rows in rank order, while the words so far stay below half of the next row past the goal.
    last = join(light.drop("missing"), cut).where(F.floor(F.col("u") * scale) == F.col("cell"))
    run = Window.partitionBy("source").orderBy("rank", "key").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("so_far", F.col("words_before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    enters = last.where(F.col("so_far") + F.col("size") / 2.0 <= F.col("missing"))
    enters = enters.groupBy("source").agg(F.max(F.struct("rank", "key")).alias("last_row"))
    bounds = _hinted(join(cut.select("source", "cell"), enters).select("source", "cell", "last_row"))
    out = join(join(ranked(rows), bounds), per)
    cell = F.floor(F.col("u") * scale)
    extra = F.when(F.col("u").isNull(), 0).when(cell < F.col("cell"), 1).when((cell == F.col("cell")) & (F.struct("rank", "key") <= F.col("last_row")), 1).otherwise(0)
    copies = (F.coalesce(F.col("whole"), F.lit(0)) + F.coalesce(extra, F.lit(0))).cast("long")
    return out.select(
        "doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(k).alias(c) for c, k in zip(keep, kept)]
    )


def _hinted(per_source: DataFrame) -> DataFrame:
    """A table of sources, written so that its size can be checked."""
    table = written(per_source)
    return broadcast_if_small(table, table.count())
