"""Benchmark decontamination with a positional inverted index.

The index is a stored table of postings (term, document, position) of training
tokens. It holds the terms that some test window or item is looked up by: its
rarest ones, by document tokens counted over the whole corpus, so no list of a
term is built that is frequent where a rarer one would do. A lookup starts from
a window's rarest term, shifts its list by the term's offset in the window, and
intersects it with the shifted list of the next rarest one: what stays are
starts at which both stand in place. Windows with further words are then held
against the document's words at these starts.

Exact phrases mark the document words of every occurrence. Proximity matches
are items whose three rarest terms stand within a span of 30 words of a
document, in any order. They are found from the same index.

Cases: null and empty texts have no words; items without words match nothing;
an item shorter than the window is one window; items or documents that repeat
are each reported (rows that share doc_id and text share their hits, which
are the same); null ids are kept, and the items without an id count as one with
an empty id; terms and windows of any frequency are dealt over tasks where they
are not sent (dealt); extra columns are ignored; an empty table of either kind gives no
hits; a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm import dealt
from quillrank.llm.store import broadcast_if_small, scratch, written

WINDOW = 13
#: Terms whose lists are intersected for a window; terms of an item that must
#: stand together for a proximity match, and within how many words.
RAREST, TOGETHER, SPAN = 2, 3, 30
#: Rows of the test side that may be broadcast to the postings; terms, likewise, to
#: the texts. Beyond it both are shuffled and hot terms or windows are dealt.
LOOKUPS, TERMS = 20_000, 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z lowered; runs of 0-9, a-z and characters from U+0080."""
    pieces = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK, -1)
    # Only the first and the last piece can be empty.
    n = F.size(pieces)
    skip = F.when(F.get(pieces, F.lit(0)) == "", 1).otherwise(0)
    end = F.when((n > 1) & (F.get(pieces, n - 1) == ""), 1).otherwise(0)
    return F.slice(pieces, skip + 1, n - skip - end)


def test_windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win, words), and which items hold them (win, item_id)."""
    items = benchmark.select(_item(id_col), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    cut = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    cut = cut.select("item_id", F.slice("w", F.col("at") + 1, F.lit(size)).alias("words"))
    # The joined words identify a window; words hold no spaces.
    cut = written(cut.select("item_id", F.array_join("words", " ").alias("joined"), "words"))
    windows = written(cut.select("joined", "words").dropDuplicates(["joined"]).withColumn("win", F.monotonically_increasing_id()))
    holders = cut.select("joined", "item_id").distinct().join(windows.select("joined", "win"), "joined")
    return windows.select("win", "words"), written(holders.select("win", "item_id"))


def _item(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id")


def whole_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(win, item_id, words): each item's text as one window, for proximity."""
    items = benchmark.select(_item(id_col), words(F.col(text_col)).alias("words")).where(F.size("words") > 0).distinct()
    return written(items.select(F.monotonically_increasing_id().alias("win"), "item_id", "words"))


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): tokens of the whole corpus for each of the given terms."""
    # The outer form adds no filter on the array, which would split texts again.
    tokens = docs.select(words(F.col(text_col)).alias("w")).select(F.explode_outer("w").alias("term"))
    sent, count = broadcast_if_small(terms, terms.count(), TERMS), F.count("*").alias("n")
    # Terms that are too many to send meet counts, which combine before the shuffle.
    own = tokens.groupBy("term").agg(count).join(terms, "term") if sent is terms else tokens.join(sent, "term").groupBy("term").agg(count)
    return terms.join(own, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def lookups(windows: DataFrame, counts: DataFrame, rarest: int = RAREST, whole: bool = True) -> DataFrame:
    """(win, term, offset, place, need): each window's rarest terms, the rarest
    at place 0, and how many are taken. With whole, a window with a term that the
    corpus lacks occurs nowhere and is left out; else such terms are passed over,
    and a window that has too few others is left out."""
    spread = windows.select("win", F.posexplode("words").alias("offset", "term"))
    spread = spread.groupBy("win", "term").agg(F.min("offset").alias("offset")).join(counts, "term", "left")
    own = Window.partitionBy("win")
    spread = spread.withColumns({"least": F.min(F.coalesce("n", F.lit(0))).over(own), "need": F.least(F.count("*").over(own), F.lit(rarest)).cast("int")})
    spread = spread.where("least > 0" if whole else "n > 0")
    spread = spread.withColumns({"place": F.row_number().over(own.orderBy("n", "offset")) - 1, "have": F.count("*").over(own)})
    return spread.where((F.col("place") < rarest) & (F.col("have") >= F.col("need"))).select("win", "term", "offset", "place", "need")


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of these terms: (_id, _text, term, pos), positions from 0."""
    held = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text"), words(F.col(text_col)).alias("w"))
    tokens = held.select("_id", "_text", F.posexplode_outer("w").alias("pos", "term"))
    sent = broadcast_if_small(terms, terms.count(), TERMS)
    return (dealt.join(tokens, terms, "term") if sent is terms else tokens.join(sent, "term")).select("_id", "_text", "term", "pos")


def intersected(index: DataFrame, looked: DataFrame) -> DataFrame:
    """(_id, _text, win, start): starts at which all of a window's terms stand
    at their offsets."""
    at = _met(index, looked, "term").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    # Rows that repeat (id, text) give the same postings, so places count as bits.
    both = at.groupBy("_id", "_text", "win", "start").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("place"))).alias("met"), F.max("need").alias("need"))
    return both.where(F.col("met") == F.call_function("shiftleft", F.lit(1), F.col("need")) - 1).select("_id", "_text", "win", "start")


def _small(table: DataFrame) -> DataFrame:
    return broadcast_if_small(table, table.count(), LOOKUPS)


def _met(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The join of rows that grow with the documents and rows of the test side,
    which are sent where they are few; else hot keys are dealt."""
    sent = _small(few)
    if sent is not few:
        return many.join(sent, key)
    return dealt.join(many if hasattr(many, "_shared_path") else written(many), few, key)


def _same(a: DataFrame, b: DataFrame):
    return a["_id"].eqNullSafe(b["_id"]) & (a["_text"] == b["_text"])


def phrase_matches(docs: DataFrame, windows: DataFrame, index: DataFrame, looked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, win, start, len): every exact occurrence of a window."""
    sizes = windows.select("win", F.size("words").alias("len"), F.size(F.array_distinct("words")).alias("terms"))
    found = written(_met(intersected(index, looked), written(sizes), "win"))
    # Windows that the lookup covers word by word need no further look.
    covered = (F.col("terms") == F.col("len")) & (F.col("len") <= RAREST)
    sure = found.where(covered).select("_id", "_text", "win", "start", "len")
    rest = written(found.where(~covered).groupBy("_id", "_text").agg(F.collect_list(F.struct("win", "start", "len")).alias("c")))
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text"), F.col(text_col).alias("_t"))
    own = own.join(_small(rest), _same(own, rest)).select(rest["_id"], rest["_text"], "c", F.array(words(F.col("_t"))).alias("w"))
    # The outer generators add no filters, which would split all texts, and keep
    # the split out of what is done per candidate.
    own = own.select("_id", "_text", "c", F.explode_outer("w").alias("w"))
    said = lambda x: F.struct(x["win"].alias("win"), x["start"].alias("start"), x["len"].alias("len"), F.array_join(F.slice(F.col("w"), x["start"] + 1, x["len"]), " ").alias("said"))
    own = own.select("_id", "_text", F.explode_outer(F.transform("c", said)).alias("x")).select("_id", "_text", "x.*")
    spelled = written(windows.select("win", F.array_join("words", " ").alias("joined")))
    own = _met(own, spelled, "win").where("said = joined").select("_id", "_text", "win", "start", "len").distinct()
    return sure.unionAll(own)


def near_items(index: DataFrame, looked: DataFrame, span: int = SPAN) -> DataFrame:
    """(_id, _text, win): items whose looked-up terms all stand within span
    words, in any order."""
    at = _met(index, looked, "term").groupBy("_id", "_text", "win").agg(
        F.sort_array(F.collect_set(F.struct("pos", "place"))).alias("at"), F.max("need").alias("need")
    )
    never = -(1 << 30)
    start = F.struct(F.array_repeat(F.lit(never), TOGETHER).alias("last"), F.lit(1 << 30).alias("best"))

    def step(acc, x):
        # The last position of every term so far; unused places follow along.
        last = F.transform(acc["last"], lambda v, i: F.when(i == x["place"], x["pos"]).otherwise(v))
        return F.struct(last.alias("last"), F.least(acc["best"], x["pos"] - F.array_min(F.slice(last, F.lit(1), F.col("need"))) + 1).alias("best"))

    best = F.aggregate("at", start, step, lambda acc: acc["best"])
    return at.where(best <= span).select("_id", "_text", "win")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id): items whose rarest terms all stand within span words."""
    items = whole_items(benchmark)
    terms = items.select(F.explode("words").alias("term")).distinct()
    looked = written(lookups(items.select("win", "words"), term_counts(docs, terms, text_col), TOGETHER, whole=False))
    index = written(postings(docs, looked.select("term").distinct(), id_col, text_col))
    found = _met(near_items(index, looked, span), items.select("win", "item_id"), "win")
    return found.select(F.col("_id").alias("doc_id"), F.col("item_id").cast(dict(benchmark.dtypes)["item_id"]).alias("item_id")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), proximity: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings), contaminated, near
    (sorted ids of items with a proximity match; none are looked for without
    proximity), and the columns in keep."""
    with scratch() as tables:
        windows, holders = test_windows(benchmark, size)
        items = whole_items(benchmark)
        terms = written(items.select(F.explode("words").alias("term")).distinct())
        counts = written(term_counts(docs, terms, text_col))
        looked = written(lookups(windows, counts))
        by_item = written(lookups(items.select("win", "words"), counts, TOGETHER, whole=False)) if proximity else looked.where("false")
        keys = written(looked.select("term").unionAll(by_item.select("term")).distinct())
        index = written(postings(docs, keys, id_col, text_col))
        found = written(phrase_matches(docs, windows, index, looked, id_col, text_col))
        # Words under any occurrence: the union of the spans, in order.
        spans = found.groupBy("_id", "_text").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"))
        step = lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], x["end"]).alias("upto")
        )
        covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), step, lambda acc: acc["n"])
        spans = spans.select("_id", "_text", covered.cast("long").alias("n_hit"))
        ids = lambda df, by, name: _met(df.select("_id", "_text", "win").distinct(), by, "win").groupBy("_id", "_text").agg(F.sort_array(F.collect_set("item_id")).alias(name))
        nothing = lambda kind: F.lit(None).cast(kind)
        parts = spans.select("_id", "_text", "n_hit", nothing("array<string>").alias("items"), nothing("array<string>").alias("near"))
        parts = parts.unionAll(ids(found, holders, "items").select("_id", "_text", nothing("long"), "items", nothing("array<string>")))
        if proximity:
            close = near_items(index, by_item)
            parts = parts.unionAll(ids(close, items.select("win", "item_id"), "near").select("_id", "_text", nothing("long"), nothing("array<string>"), "near"))
        # One of the (at most three) rows of a document has each column.
        hits = tables.keep(written(parts.groupBy("_id", "_text").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n_hit", "items", "near")])))
    # Where the hits are few, rows stay where they are read.
    base = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text"), F.size(words(F.col(text_col))).cast("long").alias("n_words"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    hits = broadcast_if_small(hits, hits.count())
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return base.join(hits, _same(base, hits), "left").select(
        base["_id"].alias("doc_id"), "n_words", n_hit.alias("n_hit"), listed("items"), ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), listed("near"),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
    )
