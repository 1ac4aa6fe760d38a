"""Scores and rankings of candidates for offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import rules
from quillrank.functions.present import percent
from quillrank.functions.vectors import cosine, norm
from quillrank.sources.staging import written

#: Offers that may be broadcast against all candidates at once.
OFFER_ROWS = 10_000
#: Numbers in the vectors of a block.
OFFER_NUMBERS = 4 << 20
#: Candidates of an offer that are ordered in one task.
PLAIN_ROWS = 1 << 17


def few(df: DataFrame, rows: int = OFFER_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than are needed."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = OFFER_ROWS) -> DataFrame:
    """Broadcast where a count has shown that df is small."""
    return F.broadcast(df) if few(df, rows) else df


def score_pairs(offers: DataFrame, candidates: DataFrame, block: int = OFFER_ROWS, more: dict[str, Column] | None = None) -> DataFrame:
    """(offer_id, cand_id, score). offers(offer_id, v) go to every candidate
    row, in blocks that may be broadcast: so many rows, and numbers in them. Further
    columns of a pair are told where it is met: by the candidate's columns, and by o,
    the offer's vector."""
    more = more or {}
    left = offers.select("offer_id", F.col("v").alias("o"), norm(F.col("v")).alias("on"))
    right = candidates.select("cand_id", "v", norm(F.col("v")).alias("cn"), *([c for c in candidates.columns if c not in ("cand_id", "v")] if more else []))
    said = offers.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("wide")).first()
    blocks = max(1, -(-said["n"] // max(1, min(block, OFFER_NUMBERS // max(said["wide"] or 1, 1)))))
    out = None
    for i in range(blocks):
        own = left if blocks == 1 else left.where(F.pmod(F.xxhash64("offer_id"), F.lit(blocks)) == i)
        part = right.crossJoin(F.broadcast(own)).select("offer_id", "cand_id", cosine(F.col("o"), F.col("v"), F.col("on"), F.col("cn")).alias("score"), *[c.alias(name) for name, c in more.items()])
        out = part if out is None else out.unionAll(part)
    return out


def position(by: Column, tie: str, per: str = "offer_id") -> Column:
    return F.row_number().over(Window.partitionBy(per).orderBy(by.desc(), F.col(tie)))


def top_k(scored: DataFrame, k: int, score: str = "score", tie: str = "cand_id", per: str = "offer_id") -> DataFrame:
    """The first k per offer, at least one; Spark prunes below the shuffle."""
    return scored.withColumn("posicion", position(F.col(score), tie, per)).where(F.col("posicion") <= max(k, 1))


def adjust(scored: DataFrame, requirements: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Adds penalizacion, avisos and score_ajustado; the score stays as it is.
    requirements(offer_id, ...) and profiles(cand_id, ...), unless scored has these."""
    names = list(rules.PENALTIES)
    requirements = hinted(requirements)
    both = scored.join(requirements.withColumnsRenamed({n: f"r_{n}" for n in names}), "offer_id", "left")
    both = both if profiles is None else both.join(profiles, "cand_id", "left")
    found = rules.verdict({n: F.col(f"r_{n}") for n in names}, {n: F.col(n) for n in names})
    both = both.withColumn("v", found).withColumns({"penalizacion": F.col("v.penalizacion"), "avisos": F.col("v.avisos")})
    return both.withColumn("score_ajustado", F.col("score") - F.col("penalizacion")).drop("v")


def ranged(scored: DataFrame, by: str, tie: str, per: str, parts: int) -> DataFrame:
    """scored with __part and __at: its rows by range of (per, score, tie), cut at
    quantiles of Spark's bounded sample, and each row's place in its range. Ties of
    the score are cut as well, so a range is as large as the others whatever the
    scores are. Written once, so both stay as they are."""
    keys = [F.col(per), F.col(by).desc(), F.col(tie)]
    own = scored.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    return written(own.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"))


def _placed(scored: DataFrame, by: str, name: str, tie: str, per: str, parts: int) -> DataFrame:
    held = ranged(scored, by, tie, per, parts)
    # A range holds a run of offers: rows for parts and offers together.
    runs = held.groupBy(per, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(per).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(per, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    out = held.join(hinted(runs), [per, "__part"]).withColumn(name, (F.col("__at") + F.col("__shift")).cast("int"))
    return out.drop("__part", "__at", "__shift")


def places(scored: DataFrame, names: dict[str, str], tie: str = "cand_id", per: str = "offer_id", plain: int = PLAIN_ROWS, parts: int | None = None) -> DataFrame:
    """scored with each row's place by one or more scores, from 1: names has the
    new column of each. Rows are scored and written once. Where no offer has more
    than ``plain`` of them, each offer is ordered in its task; beyond it rows are
    ordered by ranges, so no offer's candidates, nor its ties, meet in one task."""
    held = written(scored)
    most = held.groupBy(per).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= plain:
        return held.withColumns({name: position(F.col(by), tie, per) for name, by in names.items()})
    parts = parts or int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, by in names.items():
        held = _placed(held, by, name, tie, per, parts)
    return held


def positions(scored: DataFrame, by: str, name: str, tie: str = "cand_id", per: str = "offer_id") -> DataFrame:
    """scored with each row's place by one score."""
    return places(scored, {name: by}, tie, per)


def rank_shift(adjusted: DataFrame) -> DataFrame:
    """Positions by raw and by adjusted score, and the places lost."""
    out = places(adjusted, {"raw_pos": "score", "adj_pos": "score_ajustado"})
    return out.withColumn("shift", F.col("adj_pos") - F.col("raw_pos"))


def leader(ranked: DataFrame, score: str = "score_ajustado") -> DataFrame:
    """ranked with es_lider for the first of each offer and percent, the width
    of a score's bar."""
    return ranked.withColumns({"es_lider": F.col("posicion") == 1, "percent": percent(F.col(score))})


def best_scores(scored: DataFrame, keys: tuple[str, ...], k: int, tie: str = "cand_id", score: str = "score") -> DataFrame:
    """(keys, n, mean, top): of each group the mean score and its k best ones,
    best first, without gathering the group."""
    mean = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie)))
    top = scored.withColumn("__p", place).where(F.col("__p") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list(score), asc=False).alias("top"))
    return mean.join(top, list(keys))
