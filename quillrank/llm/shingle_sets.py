"""Sets of word shingles and the links between similar ones.

Texts are nodes: one for each distinct set of shingle hashes. What proposes pairs
of nodes is left to the operator (``members``); here pairs are ruled out by sizes
and parity sketches, verified on the sets themselves, and the members of a key are
met without all pairs of a group.

Parity sketches: every shingle that only one of two sets has flips one of a
sketch's bits, so their sketches differ in no more bits than the sets in shingles.
A short sketch goes along with the members of a key; a long one, of at least two
bits a shingle, leaves few pairs that are not links.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import textnum as tn
from quillrank.llm.components import components
from quillrank.llm.store import broadcast_if_small, written

#: Longs of the short parity sketch, and least longs of the long one.
SKETCH = 4
#: Most keys, or sets to verify, whose numbers are sent to every task; beyond it
#: they are joined.
SENT = 1 << 21
#: Members of a key beyond which the smallest is held against the others first.
HOT = 2
#: Members of a key beyond which those of several components are not held against
#: each other, but met by their differences from a common set.
WIDE = 16
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Rule(NamedTuple):
    """Words of a shingle, and the least Jaccard similarity, num / den, of a link."""

    shingle: int
    num: int
    den: int


def sets_of(c: tn.Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, and each one's first."""
    w = tn.words_of(c)
    h = tn.word_hash(tn.ascii_lower(c.data), w.starts, w.ends, 0)
    per_doc = np.diff(w.doc_start)
    count = np.where(per_doc == 0, 0, np.maximum(per_doc - shingle + 1, 1))
    doc = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    at = np.arange(len(doc)) + np.repeat(w.doc_start[:-1] - first, count)
    end = np.repeat(w.doc_start[1:], count)
    total = np.zeros(len(doc), np.uint64)
    for j, odd in enumerate(_ODD[:shingle]):
        inside = at + j < end
        total[inside] += h[at[inside] + j] * np.uint64(odd)
    total = tn.mix(total)
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])
    total, doc = total[new], doc[new]
    return total, np.searchsorted(doc, np.arange(len(count) + 1))


def nodes_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number per set, from the sum of its mixed hashes and its size."""
    run = np.append(np.uint64(0), np.cumsum(tn.mix(hashes ^ np.uint64(_ODD[0])), dtype=np.uint64))
    return tn.mix(run[bounds[1:]] - run[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * np.uint64(_ODD[1])).view(np.int64)


INFO = [f"s{i}" for i in range(SKETCH)]


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity sketches of all sets in a row, and each one's first long. Lengths
    are powers of two, so a longer one folds onto a shorter one."""
    size = np.diff(bounds)
    longs = SKETCH << np.ceil(np.log2(np.maximum(size / (32 * SKETCH), 1))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(longs)])
    where = tn.mix(hashes ^ np.uint64(_ODD[2])) & np.repeat((64 * longs - 1).astype(np.uint64), size)
    odd = np.bincount(np.repeat(64 * first[:-1], size) + where.astype(np.int64), minlength=int(64 * first[-1])) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"), first


def folded(longs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SKETCH longs of each sketch."""
    n = np.diff(first) // SKETCH
    at = first[:-1][:, None] + np.arange(SKETCH)
    out = np.zeros((len(n), SKETCH), np.int64)
    for k in range(int(n.max(initial=0))):
        own = n > k
        out[own] ^= longs[at[own] + k * SKETCH]
    return out


def held(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def keys_sent(df: DataFrame, name: str):
    """The sorted distinct values of a long column as a broadcast, or None
    where they are too many."""
    if df.count() > SENT:
        return None
    got = np.sort(df.select(name).toArrow().column(0).to_numpy())
    return df.sparkSession.sparkContext.broadcast(got)


def _spelled(shingle, wanted):
    """(node, sh) with the set itself: of the wanted nodes, or of all."""

    def run(batches):
        for b in batches:
            for c in tn.chunks(b.column(0)):
                h, bounds = sets_of(c, shingle)
                node = nodes_of(h, bounds)
                _, own = np.unique(node, return_index=True)
                if wanted is not None:
                    own = own[held(node[own], wanted.value)]
                if len(own):
                    sets = pa.array([h[bounds[i] : bounds[i + 1]].view(np.int64) for i in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(node[own]), sets], ["node", "sh"])

    return run


class Texts(NamedTuple):
    """docs (doc_id, text); nodes: a row per node with rep, its smallest doc_id,
    size and sketches."""

    docs: DataFrame
    nodes: DataFrame
    rule: Rule


def _within(rule, bits, x, y):
    """Whether sizes, and bits in which sketches differ, allow two sets to be
    similar enough: they differ in at most (den - num) / (den + num) of both sizes."""
    sizes = F.least(x["size"], y["size"]) * rule.den >= F.greatest(x["size"], y["size"]) * rule.num
    return sizes & (bits * (rule.num + rule.den) <= (x["size"] + y["size"]) * (rule.den - rule.num))


def _near(rule, x, y):
    """_within by the short sketches."""
    return _within(rule, sum((F.bit_count(x[s].bitwiseXOR(y[s])) for s in INFO[1:]), F.bit_count(x[INFO[0]].bitwiseXOR(y[INFO[0]]))), x, y)


def _close(rule, x, y):
    """_within by the long ones: sizes that may be linked have sketches of the
    same length, or one of twice the other's."""
    n = F.least(F.size(x["sketch"]), F.size(y["sketch"]))
    half = lambda v, at: F.slice(v, at, n)
    fold = lambda v: F.when(F.size(v) > n, F.zip_with(half(v, F.lit(1)), half(v, n + 1), lambda a, b: a.bitwiseXOR(b))).otherwise(v)
    bits = F.aggregate(F.zip_with(fold(x["sketch"]), fold(y["sketch"]), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + c)
    return F.when(F.least(x["size"], y["size"]) * rule.den >= F.greatest(x["size"], y["size"]) * rule.num, _within(rule, bits, x, y)).otherwise(F.lit(False))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _closer(pairs: DataFrame, texts: Texts) -> DataFrame:
    """The pairs (a, b) that long sketches allow; written()."""
    nodes, rule = texts.nodes, texts.rule
    info = F.struct("size", "sketch")
    side = lambda key, name: nodes.select(F.col("node").alias(key), info.alias(name))
    return written(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_close(rule, F.col("x"), F.col("y"))).select("a", "b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))


def spelled(wanted: DataFrame, texts: Texts) -> DataFrame:
    """(node, sh), the sets of the wanted nodes, each once; written()."""
    docs, nodes, rule = texts
    wanted = written(wanted.distinct())
    n = wanted.count()
    reps = written(wanted.join(nodes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id")).distinct())
    sent = keys_sent(wanted, "node")
    # Of each node the rows of its smallest id are spelled out, or those without one.
    some = docs.join(broadcast_if_small(reps, n), "doc_id", "left_semi")
    if reps.where("doc_id is null").count():
        some = some.unionByName(docs.where("doc_id is null"))
    sets = some.select("text").mapInArrow(tn.trimmed(_spelled(rule.shingle, sent)), "node long, sh array<long>")
    sets = written(sets if sent is not None else sets.join(wanted, "node", "left_semi"))
    return written(sets.dropDuplicates(["node"])) if sets.count() > n else sets


def _similar(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    left, right = sets.select(F.col("node").alias("a"), F.col("sh").alias("x")), sets.select(F.col("node").alias("b"), F.col("sh").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(shared * (rule.num + rule.den) >= (F.size("x") + F.size("y")) * rule.num).select("a", "b")


def verified(pairs: DataFrame, texts: Texts) -> DataFrame:
    """The pairs (a, b), each once, whose sets are similar enough."""
    pairs = _closer(pairs, texts)
    return _similar(pairs, spelled(_ends(pairs), texts), texts.rule)


def _apart(x: str, y: str):
    return F.concat(F.array_except(x, y), F.array_except(y, x))


def around(group: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of which the links within each hub's members (hub, node, of)
    join the same components as all links between those that differ in ``of``.

    Sets are told by what they differ in from the hub's centre, the hub's set with
    whatever most members have otherwise. Of differences d and size n a set has the
    reach f = (num + den) |d| - (den - num) n, and two sets are linked if and only if
    f(x) + f(y) <= 2 (num + den) |d(x) & d(y)|. So all pairs with f(x) + f(y) <= 0 are
    linked, and the member of least f with both of them: that star replaces them. Of
    any other pair one lies outside the star, and both share differences, of which the
    first in the order of rarity stands within a prefix of either.
    """
    unit, slack = rule.num + rule.den, rule.den - rule.num
    own = group.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("sh").alias("its")), "hub")
    own = written(own.select("hub", "node", "of", F.size("sh").alias("size"), _apart("sh", "its").alias("d")))
    # An element that differs in one member only is shared by no two, and needs no row but here.
    counts = own.select("hub", F.explode("d").alias("e")).groupBy("hub", "e").agg(F.count("*").alias("c")).where("c > 1")
    counts = written(counts.join(group.groupBy("hub").agg(F.count("*").alias("n")), "hub"))
    centre = counts.where("2 * c > n").groupBy("hub").agg(F.collect_list("e").alias("m"))
    own = own.join(centre, "hub", "left").withColumn("d", F.when(F.col("m").isNull(), F.col("d")).otherwise(_apart("d", "m")))
    # Written, so that the least of a hub is taken by tasks before its members meet.
    own = written(own.select("hub", "node", "of", "size", "d", (F.size("d") * unit - F.col("size") * slack).alias("f")))
    own = own.join(written(own.groupBy("hub").agg(F.min(F.struct("f", "node", "of")).alias("mid"))), "hub")
    least = F.col("mid.f")
    star = own.where((F.col("f") + least <= 0) & (F.col("of") != F.col("mid.of"))).select(F.col("mid.node").alias("a"), F.col("node").alias("b"))
    rare = counts.select("hub", "e", F.least("c", F.col("n") - F.col("c")).alias("r")).where("r > 1")
    told = own.select("hub", "node", F.explode("d").alias("e")).join(rare, ["hub", "e"])
    told = told.groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("r", "e"))).alias("known"))
    told = own.withColumn("n", F.size("d")).drop("d").join(told, ["hub", "node"]).withColumn("stray", F.col("f") + least > 0)
    # Differences that both must share: at least so many with any partner outside the star, or with any.
    shared = lambda f: F.greatest(F.ceil(f / (2 * unit)), F.lit(1)).cast("int")
    last = lambda f: F.col("n") - shared(F.col("f") + f)
    told = told.withColumn("to", F.when(F.col("stray"), last(least)).otherwise(last(F.lit(1) - least)))
    # Those of one member alone come first in the order.
    alone = F.col("n") - F.size("known")
    told = told.select("hub", F.struct("node", "of", "size", "f", "stray", "n").alias("x"), "to", alone.alias("alone"), F.posexplode("known").alias("at", "d"))
    told = written(told.withColumn("at", F.col("at") + F.col("alone")).where("at <= to").select("hub", F.col("d.e").alias("e"), "x", "at"))
    x, y = F.col("x"), F.col("y")
    other = told.where("x.stray").select("hub", "e", F.col("x").alias("y"), F.col("at").alias("its"))
    both = shared(x["f"] + y["f"])
    meets = (x["of"] != y["of"]) & (~x["stray"] | (x["node"] < y["node"])) & (F.least(x["size"], y["size"]) * rule.den >= F.greatest(x["size"], y["size"]) * rule.num)
    met = told.join(other, ["hub", "e"]).where(meets & (F.col("at") <= x["n"] - both) & (F.col("its") <= y["n"] - both))
    return star.unionAll(met.select(x["node"].alias("a"), y["node"].alias("b")))


def links(members: DataFrame, texts: Texts, may_link=None, proposed: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all links among
    the members (h, x) of each key, x a struct of node, size and the short sketch.
    The members of a key are first held against the smallest of them, and then
    only across the components this gives: each outside the largest against all, or,
    where a key has more than WIDE, around that largest component (``around``). So
    large groups of copies or of near copies cost rows in proportion to their members,
    and no link between components is left out. may_link rules out further pairs,
    proposed (a, b) adds some; all are verified."""
    rule = texts.rule
    groups = written(members.groupBy("h").agg(F.count("*").alias("n"), F.min("x.node").alias("low")))
    few, hot = groups.where(F.col("n") <= HOT).select("h"), groups.where(F.col("n") > HOT)
    pairs = lambda df: df.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    own = members.join(few, "h", "left_semi")
    x, y = F.col("x"), F.col("y")
    allowed = _near(rule, x, y) if may_link is None else may_link(x, y) & _near(rule, x, y)
    direct = own.join(own.withColumnRenamed("x", "y"), "h").where((x["node"] < y["node"]) & allowed)
    star = members.join(hot, "h").where("x.node <> low").select(F.col("low").alias("a"), F.col("x.node").alias("b"))
    found = pairs(direct).unionAll(star)
    found = written(verified(_ordered(found if proposed is None else found.unionAll(proposed)), texts))
    if hot.isEmpty():
        return found
    known = components(found)
    own = members.join(hot.select("h"), "h", "left_semi").withColumn("node", F.col("x.node"))
    own = written(own.join(known, "node", "left").select("h", "x", F.coalesce("component", "node").alias("of")))
    main = own.groupBy("h", "of").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("of", F.struct("n", "of")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    main = written(main.where("parts > 1"))
    small, wide = main.where(F.col("n") <= WIDE), main.where(F.col("n") > WIDE)
    stray = own.join(small, "h").where("of <> main").select("h", F.col("x").alias("y"), F.col("of").alias("its"))
    across = stray.join(own.join(small.select("h"), "h", "left_semi"), "h").where((F.col("of") != F.col("its")) & allowed & (x["node"] != y["node"]))
    across = _closer(_ordered(pairs(across)), texts)
    group = written(own.join(wide, "h").select(F.col("main").alias("hub"), x["node"].alias("node"), "of").distinct())
    sets = spelled(_ends(across).unionAll(group.select("node")).unionAll(group.select("hub")), texts)
    if not group.isEmpty():
        across = across.unionAll(_closer(_ordered(around(group, sets, rule)), texts)).distinct()
    return found.unionAll(_similar(across, sets, rule))


def grouped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component_id, own): of every node the smallest doc_id (rep) of its
    component, and whether the node is that doc_id's; written()."""
    named = components(edges).join(nodes, "node").select("node", "component", "rep")
    low = named.groupBy("component").agg(F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "node"))).alias("low"))
    moved = named.join(low, "component").select("node", "low")
    low = F.coalesce("low", F.struct("rep", "node"))
    return written(nodes.join(moved, "node", "left").select("node", low["rep"].alias("component_id"), (low["node"] == F.col("node")).alias("own")))
