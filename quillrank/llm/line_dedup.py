"""Cross-site line dedup by distinct-site spread.

A line (spaces and tabs trimmed) is boilerplate if it stands in the documents
of at least ``min_sites`` sites. One aggregation merges a HyperLogLog++ sketch
of the sites of every line hash and counts its occurrences. Fewer occurrences
than min_sites settle a line exactly, an estimate of twice min_sites or more
does too (an estimate in the sketch's linear-counting range cannot be that
high otherwise); every line between is near the threshold and gets an exact
distinct count of its sites.

Lines are known by 64-bit hashes in the aggregations, and the text of a removed
line is compared with the text counted, so a collision cannot remove a line.

Cases: null text counts as empty, and an empty text has no lines; blank lines
are never boilerplate and stay; a null site counts as one site of its own;
repeated lines of one site count once; null ids are kept; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.store import broadcast_if_small, written

MIN_SITES = 5
#: Relative error of the sketch: 64 registers, 7 longs a line in aggregation.
SKETCH_ERROR = 0.138


def lines_of(text: Column) -> Column:
    """Lines parted by U+000A; none for a null or empty text."""
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    return F.when(empty, F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def _known(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """h, line, n_sites for every line of at least min_sites sites (n_sites is
    the sketch's estimate where that alone decided)."""
    # The outer form adds no filter on the array, which would split texts again.
    lines = docs.select(F.explode_outer(lines_of(F.col(text_col))).alias("line"), F.xxhash64(F.col(site_col), F.col(site_col).isNull()).alias("site"))
    lines = lines.select(_known(F.col("line")).alias("line"), "site").where("line <> ''")
    hashed = lines.select(F.xxhash64("line").alias("h"), "site")
    sketched = hashed.groupBy("h").agg(F.count("*").alias("n"), F.approx_count_distinct("site", SKETCH_ERROR).alias("spread"))
    sketched = written(sketched.where(F.col("n") >= min_sites))
    sure = sketched.where(F.col("spread") >= 2 * min_sites).select("h", F.col("spread").cast("long").alias("n_sites"))
    close = sketched.where(F.col("spread") < 2 * min_sites).select("h")
    close = broadcast_if_small(close, close.count())
    # Sites per close line: a row per (line, site) leaves each task.
    exact = hashed.join(close, "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("n_sites"))
    found = written(sure.unionAll(exact.where(F.col("n_sites") >= min_sites)))
    found = broadcast_if_small(found, found.count())
    named = lines.select("line", F.xxhash64("line").alias("h")).join(found, "h")
    return written(named.groupBy("h", "line").agg(F.max("n_sites").alias("n_sites")))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The columns of docs with the text cleaned (an untouched text stays as it
    is, null included), and n_lines, n_removed, which win over further columns
    of these names."""
    # Further columns go by names of their own meanwhile.
    extra = {c: f"__extra_{i}" for i, c in enumerate(docs.columns) if c not in (id_col, text_col, site_col)}
    docs = docs.withColumnsRenamed(extra)
    bad = boilerplate_lines(docs, min_sites, text_col, site_col).select("h", F.col("line").alias("__line"))
    bad = broadcast_if_small(bad, bad.count())
    # Rows are known by id and text: equal rows lose equal lines.
    key = [F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__text")]
    at = docs.select(*key, F.posexplode_outer(lines_of(F.col(text_col))).alias("pos", "line"))
    at = at.select("__id", "__text", "pos", _known(F.col("line")).alias("line")).where("line <> ''")
    hit = at.withColumn("h", F.xxhash64("line")).join(bad, "h").where(F.col("line") == F.col("__line"))
    hit = hit.groupBy("__id", "__text").agg(F.collect_set("pos").alias("__gone"))
    whole = docs.withColumn("__text", F.xxhash64(F.col(text_col))).withColumn("__id", F.col(id_col))
    same = whole["__id"].eqNullSafe(hit["__id"]) & (whole["__text"] == hit["__text"])
    both = whole.join(hit.hint("merge"), same, "left").select(*[whole[c] for c in docs.columns], hit["__gone"])
    both = both.withColumn("__lines", lines_of(F.col(text_col)))
    # The stretches between removed lines, each cut out once.
    edges = F.concat(F.array(F.lit(-1)), F.sort_array("__gone"), F.array(F.size("__lines")))
    both = both.withColumn("__edges", F.when(F.col("__gone").isNotNull(), edges))
    cut = lambda j: F.slice("__lines", F.get("__edges", j) + 2, F.get("__edges", j + 1) - F.get("__edges", j) - 1)
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("__edges") - 2), cut)), "\n")
    both = both.withColumns(
        {
            "n_lines": F.size("__lines").cast("long"),
            "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
            text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept),
        }
    )
    won = ("n_lines", "n_removed")
    both = both.drop("__gone", "__lines", "__edges", *[v for k, v in extra.items() if k in won])
    return both.withColumnsRenamed({v: k for k, v in extra.items() if k not in won})
