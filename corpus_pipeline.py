"""Corpus pipeline: five stages from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and reread as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.llm import decontaminate, line_dedup, mixing, near_copies, toxicity
from quillrank.llm.store import broadcast_if_small, discard, scratch, written


_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(stage):
    """Run a stage with any further columns under names of their own, so that
    none can clash with what the stage computes. Columns that the last stage
    adds win over further columns of the same name."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extra = {f"__extra_{i}": c for i, c in enumerate(docs.columns) if c not in _OWN}
        held = docs.withColumnsRenamed({v: k for k, v in extra.items()})
        out = stage(spark, held, sf_dir)
        taken = set(out.columns) - set(held.columns)
        return out.drop(*[k for k, v in extra.items() if v in taken]).withColumnsRenamed(extra)

    return run


@_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(model, F.col("text")) < toxicity.THRESHOLD)


@_apart
def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its cross-site lines; n_chars follows the text."""
    out = line_dedup.remove_boilerplate(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))).select(*docs.columns)


@_apart
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of texts with a similarity of 0.8 or
    more, once; of its texts, one. Rows are told apart by doc_id and shingle
    set, so another text under a dropped id stays. Rows without a doc_id cannot
    stand for a group and stay."""
    groups, key = near_copies.near_copy_groups(docs), ["doc_id", "node"]
    gone = written(groups.where(F.col("doc_id").isNotNull() & ~F.col("keep")).select(*key).distinct())
    left = near_copies.numbered(docs).join(broadcast_if_small(gone, gone.count()), key, "left_anti")
    # Rows that repeat a doc_id and its text: only those need an order.
    twice = written(groups.where("keep").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
    n = twice.count()
    if n == 0:
        return left.select(*docs.columns)
    mark = broadcast_if_small(twice, n)
    order = Window.partitionBy(*key).orderBy(F.xxhash64("text"), F.xxhash64(*[c for c in _OWN if c in docs.columns]))
    once = left.join(mark, key, "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return left.join(mark, key, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


@_apart
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth repeats benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark, keep=tuple(c for c in docs.columns if c != "doc_id"), proximity=False)
    return found.where(~F.col("contaminated")).select(*docs.columns)


@_apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many copies of each."""
    keep = tuple(c for c in docs.columns if c != "doc_id")
    out = mixing.pareto_mix(docs, keep=keep).where("copies > 0")
    return out.select(*docs.columns, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Toxicity and shingle similarity have no SQL form; tests/llm holds run() against
#: a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. A stage's tables go as soon as its result is written,
    and that once the next one's is; the last result still reads its own."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch() as tables:
            docs = tables.keep(written(stage(spark, docs, sf_dir)))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
