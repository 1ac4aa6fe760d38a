"""Near copies by exact similarity of shingle sets: operator 9's form for stages.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. SimHash fingerprints of these sets, linked by the
generalised pigeonhole search, propose most close copies. Their distances do not
bound the similarity, so prefix filtering completes them: in any one order of all
shingles, two similar sets share a shingle among the first s - ceil(0.8 s) + 1 of
each. The order puts rare shingles first, by counts in a table that shingles share
by hash. All pairs are verified on the sets themselves.

In large inputs a counter has many shingles, and a passage of many unlike texts can
stand in front of rarer ones. Such shingles are known from the first prefixes: those
in more than WIDE of them, and those that would move up for them in the same texts,
come last in the order, and the prefixes are taken anew. The order is still one for
all sets, so no link is lost. Without it the large groups that share a passage, whose
sets differ in nearly all they have, would meet by these differences.

Only shingles that stand in the prefixes of two sets go on: smallest and largest
set per shingle tell, which combines before the shuffle. How the members of a
shingle meet, and how pairs are ruled out, is said in shingle_sets.

Cases: shingles are known by 64-bit hashes of words in lower case (ASCII), equal
sets are one node; a text of less than five words is one shingle; null and blank
texts have the empty set and are linked to each other; a null doc_id is never the
smallest; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import shingle_sets as ss
from quillrank.llm import simhash_dedup
from quillrank.llm import textnum as tn
from quillrank.llm.store import scratch, written

SHINGLE = 5
#: Least similarity: NUM / DEN.
NUM, DEN = 4, 5
#: Counters that order the shingles; any size gives the same links.
COUNTERS = 1 << 17
#: The level of shingles that come last.
LAST = np.iinfo(np.uint16).max
#: Bits in which fingerprints of linked texts may differ.
TAU = 2
RULE = ss.Rule(SHINGLE, NUM, DEN)


def _number(batches):
    """The batch's columns with the node behind them; text is the last one."""
    for b in batches:
        found = [ss.nodes_of(*ss.sets_of(c, SHINGLE)) for c in tn.chunks(b.column(b.num_columns - 1))]
        node = np.concatenate(found) if found else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node)], [*b.schema.names, "node"])


def _inform(batches):
    """(doc_id, node, size, fp, short sketch, long sketch) of every row."""
    for b in batches:
        cols, big = [[] for _ in range(3 + ss.SKETCH)], []
        for c in tn.chunks(b.column(1)):
            h, bounds = ss.sets_of(c, SHINGLE)
            longs, first = ss.sketches(h, bounds)
            big.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(longs)))
            for to, x in zip(cols, (ss.nodes_of(h, bounds), np.diff(bounds).astype(np.int32), simhash_dedup.majority(h, bounds).view(np.int64), *ss.folded(longs, first).T)):
                to.append(x)
        if big:
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.concatenate(x)) for x in cols], pa.concat_arrays(big)], ["doc_id", "node", "size", "fp", *ss.INFO, "sketch"])


def _count(batches):
    total = np.zeros(COUNTERS, np.int64)
    for b in batches:
        for c in tn.chunks(b.column(0)):
            total += np.bincount((ss.sets_of(c, SHINGLE)[0] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def _levels(docs: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur, in eighths of doublings."""
    got = docs.select("text").mapInArrow(tn.trimmed(_count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.uint16)  # at most COUNTERS rows, whatever the input
    out[got.column("cell").to_numpy()] = (8 * np.log2(got.column("n").to_numpy())).astype(np.uint16)
    return out


def _prefixes(sent, shared=None, late=None, ahead=False):
    """(h, node, size, place) of each set's first shingles in the order; only
    those that are shared, where these are given. Those that are late come last.
    ahead: of sets that have late ones, those that may move up into the prefix."""

    def run(batches):
        levels = sent.value
        for b in batches:
            for c in tn.chunks(b.column(0)):
                h, bounds = ss.sets_of(c, SHINGLE)
                size, node = np.diff(bounds), ss.nodes_of(h, bounds)
                _, once = np.unique(node, return_index=True)
                doc = np.repeat(np.arange(len(size)), size)
                level = levels[(h % np.uint64(COUNTERS)).astype(np.int64)]
                moved = np.zeros(len(h), bool) if late is None else ss.held(h.view(np.int64), late.value)
                level[moved] = LAST
                order = np.lexsort((h, level, doc))
                place = np.arange(len(h)) - bounds[:-1][doc]
                most = np.zeros(len(size), np.int64)
                most[once] = (size - (-(-NUM * size // DEN)) + 1)[once]
                if ahead:
                    n = np.bincount(doc[moved], minlength=len(size))
                    own = np.flatnonzero((n[doc] > 0) & (place >= (most - n)[doc]) & (place < 2 * most[doc]))
                else:
                    own = np.flatnonzero(place < most[doc])
                key = h[order][own].view(np.int64)
                if shared is not None:
                    hit = ss.held(key, shared.value)
                    own, key = own[hit], key[hit]
                cols = (key, node[doc[own]], size[doc[own]].astype(np.int32), place[own].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["h", "node", "size", "place"])

    return run


def _may_link(x, y):
    """Whether two members of a shingle can still be similar enough: the
    shared shingles are those behind it at most. A node is not its own copy."""
    behind = F.least(x["size"] - x["place"], y["size"] - y["place"])
    return ((F.least(x["place"], y["place"]) + behind) * (NUM + DEN) >= (x["size"] + y["size"]) * NUM) & (x["node"] != y["node"])


def _proposed(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes whose SimHash fingerprints are linked, through the
    smallest node of each fingerprint."""
    low = written(nodes.groupBy("fp").agg(F.min("node").alias("low")))
    same = nodes.join(low, "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    edges = simhash_dedup.links(low.select("fp"), TAU).distinct()
    ends = lambda key: low.select(F.col("fp").alias(key), F.col("low").alias(f"low_{key}"))
    linked = edges.join(ends("a"), "a").join(ends("b"), "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    return same.unionAll(linked)


def _shared(entries: DataFrame) -> DataFrame:
    """(h, n): the shingles in the prefixes of several nodes, and in how many
    entries; written()."""
    ends = entries.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
    return written(ends.where("low < high").select("h", "n"))


def _late(counts: DataFrame) -> np.ndarray:
    """The shingles in more than WIDE of the entries counted (h, n): all, or the
    most frequent, as many as can be sent to every task."""
    wide = written(counts.where(F.col("n") > ss.WIDE).select("h", "n"))
    steps = wide.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count("*").alias("keys"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for step in sorted(steps, key=lambda r: -r["step"]):  # doublings, so a few dozen rows
        total += step["keys"]
        if total > ss.SENT:
            break
        least = step["least"]
    return np.empty(0, np.int64) if least is None else wide.where(F.col("n") >= least).select("h").toArrow().column(0).to_numpy()


def _members(texts: ss.Texts) -> DataFrame:
    """(h, x): for every prefix shingle of several nodes, each of them."""
    docs, nodes, _ = texts
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(_levels(docs))
    schema = "h long, node long, size int, place int"
    first = lambda *known: docs.select("text").mapInArrow(tn.trimmed(_prefixes(sent, *known)), schema)
    late, entries = None, first()
    shared = _shared(entries)
    wide = _late(shared)
    if len(wide):
        moved = first(None, sc.broadcast(np.sort(wide)), True).groupBy("h").agg(F.count("*").alias("n"))
        late = sc.broadcast(np.unique(np.append(wide, _late(moved))))
        entries = first(None, late)
        shared = _shared(entries)
    shared = shared.select("h")
    keys = ss.keys_sent(shared, "h")
    own = first(keys, late) if keys is not None else entries.join(shared, "h", "left_semi")
    own = own.dropDuplicates(["h", "node"])
    return own.join(nodes.select("node", *ss.INFO), "node").select("h", F.struct("node", "size", "place", *ss.INFO).alias("x"))


def links(texts: ss.Texts) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all links."""
    return ss.links(written(_members(texts)), texts, _may_link, _proposed(texts.nodes))


def numbered(docs: DataFrame) -> DataFrame:
    """The rows of docs and the node of their text."""
    rows = docs.select(*[c for c in docs.columns if c != "text"], "text")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", node long"
    return rows.mapInArrow(tn.trimmed(_number), schema)


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """doc_id, node, component_id: the smallest doc_id reachable over links, and
    keep: whether the row's doc_id and node are the component's smallest."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, node long, size int, fp long, " + ", ".join(f"{s} long" for s in ss.INFO) + ", sketch array<long>"
    with scratch() as tables:
        rows = tables.keep(written(docs.mapInArrow(tn.trimmed(_inform), schema)))
        # A node's rows agree in size, fingerprint and sketches.
        nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("size", "fp", *ss.INFO, "sketch")]))
        table = tables.keep(ss.grouped(nodes, links(ss.Texts(docs, nodes, RULE))))
    return rows.select("doc_id", "node").join(table, "node").select("doc_id", "node", "component_id", (F.col("own") & (F.col("doc_id") == F.col("component_id"))).alias("keep"))
