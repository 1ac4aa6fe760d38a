"""N-gram Jaccard join by PartEnum signatures.

Two texts are linked if the Jaccard similarity of their sets of word n-grams is
at least num / den. Sizes are cut into bands such that linked sets lie in the same
or in neighbouring ones; a set signs for its own band and for the next, each an
instance with sets of almost equal size. In an instance linked sets differ in at
most K shingles, and signatures are made for that:

* the domain of shingles is cut into n1 partitions by hash, each into n2 parts;
* for each partition every choice of n2 - k2 of its parts gives a signature, the
  hash of all shingles of the set that fall into them.

At most K // (k2 + 1) partitions can hold more than k2 differences. With
n1 = K // (k2 + 1) + 1 + spare, linked sets have at least 1 + spare partitions
with k2 or fewer, and so agree in a signature of each of them.

A thin signature, of no shingle or one, says little, and all unlike sets that have
it meet. Those of less than ``least`` shingles are left out where a set has them in
at most ``spare`` partitions: one of the 1 + spare agreeing partitions then has
none, and both sets send the signature they share there. Only sets with more such
partitions send them as well, and any two of these meet in them. So no link is
lost. ``plan`` weighs the number of signatures against the sets that meet in thin
ones, so more texts get more signatures; the links are the same under any plan.

Signatures held by two sets go on; how their members meet, and how pairs are ruled
out and verified on the whole sets, is said in shingle_sets.

Cases: words are in lower case (ASCII); a text of fewer words than n is one
shingle; null and blank texts have no shingles and are linked with nothing; equal
sets are linked, as repeated rows are; a null doc_id is never the smallest, and its
component_id is that of its links or null; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb, exp, factorial, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import shingle_sets as ss
from quillrank.llm import textnum as tn
from quillrank.llm.store import scratch, written

RULE = ss.Rule(4, 17, 20)
#: Of all sets, the share in one instance, and of sets with one shingle in a
#: signature, the share that has the same: what plan() supposes.
IN_BAND, ALIKE = 1 / 20, 1 / 10
_DOMAIN, _BODY = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


class Plan(NamedTuple):
    """n1 partitions of n2 parts, signatures over n2 - k2 of them, shingles from
    which a signature is always sent, and partitions to spare."""

    n1: int
    n2: int
    k2: int
    least: int
    spare: int


@lru_cache(None)
def bands(num: int, den: int, longest: int = 1 << 31) -> np.ndarray:
    """The largest size of each band."""
    tops, low = [], 1
    while low <= longest:
        tops.append(low * den // num)
        low = tops[-1] + 1
    return np.array(tops)


def differences(top: int, rule: ss.Rule) -> int:
    """Most shingles in which linked sets of up to top shingles differ."""
    return 2 * top * (rule.den - rule.num) // (rule.den + rule.num)


def _below(mean: float, n: int) -> float:
    """The chance of fewer than n where mean are expected."""
    return sum(exp(-mean) * mean**i / factorial(i) for i in range(n))


@lru_cache(None)
def plan(k: int, small: int, sets: float) -> Plan:
    """The least estimated work for sets of ``small`` shingles and more, of which
    there are so many, that differ in up to k: signatures, and pairs that meet in
    thin ones."""
    best = None
    for k2 in range(1, min(k, 3) + 1):
        for n2 in range(k2 + 2, k2 + 6):
            for spare in range(0, 4):
                n1 = k // (k2 + 1) + 1 + spare
                each = n1 * comb(n2, k2)
                mean = small * (n2 - k2) / (n1 * n2)
                none, one = exp(-mean), mean * exp(-mean) * ALIKE
                for least in (1, 2):
                    prone = min(each * _below(mean, least), 50.0)
                    most = 1 - _below(prone, spare)  # of the sets with one thin signature, those with too many
                    met = (none + one) * most if least == 2 else none * most + one
                    found = (each * (1 + sets * met * met), Plan(n1, n2, k2, least, spare))
                    best = found if best is None else min(best, found)
    return best[1]


def signatures(h: np.ndarray, bounds: np.ndarray, rule: ss.Rule = RULE, sets: float = 1e4) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of the sets h[bounds[i] : bounds[i + 1]], and each one's set;
    planned for so many sets in an instance."""
    size, tops = np.diff(bounds), bands(rule.num, rule.den)
    band = np.searchsorted(tops, size)
    keys, owners = [], []
    for t in np.unique(np.concatenate([band[size > 0], band[size > 0] + 1])):
        k = differences(int(tops[t]), rule)
        if k == 0:  # only equal sets, which are one node
            continue
        own = np.flatnonzero((size > 0) & ((band == t) | (band + 1 == t)))
        n1, n2, k2, least, spare = plan(k, int(tops[t - 2]) + 1 if t > 1 else 1, sets)
        n = size[own]
        at = np.repeat(bounds[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        doc = np.repeat(np.arange(len(own)), n)
        u = tn.mix(h[at] ^ _DOMAIN)
        first = ((u >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)
        second = ((u & np.uint64(0xFFFFFFFF)) * np.uint64(n2)) >> np.uint64(32)
        cell = (doc * n1 + first.astype(np.int64)) * n2 + second.astype(np.int64)
        order = np.argsort(cell, kind="stable")
        run = np.append(np.uint64(0), np.cumsum(tn.mix(h[at[order]] + _BODY), dtype=np.uint64))
        ends = np.searchsorted(cell[order], np.arange(len(own) * n1 * n2 + 1))
        sums = (run[ends[1:]] - run[ends[:-1]]).reshape(len(own), n1, n2)
        counts = np.diff(ends).reshape(len(own), n1, n2)
        choices = list(combinations(range(n2), n2 - k2))
        body = np.stack([sums[:, :, c].sum(axis=2, dtype=np.uint64) for c in choices], axis=2)
        held = np.stack([counts[:, :, c].sum(axis=2) for c in choices], axis=2)
        thin = held < least
        all_of = thin.any(axis=2).sum(axis=1) > spare
        place = (np.uint64(t) << np.uint64(40)) + np.arange(n1 * len(choices), dtype=np.uint64).reshape(1, n1, len(choices))
        sig = tn.mix(tn.mix(body + held.astype(np.uint64)) ^ tn.mix(np.broadcast_to(place, body.shape)))
        send = ~thin | all_of[:, None, None]
        keys.append(sig[send])
        owners.append(own[np.nonzero(send)[0]])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _signed(rule, sets, shared=None):
    """(h, node) of all signatures, or of those that are shared."""

    def run(batches):
        for b in batches:
            for c in tn.chunks(b.column(0)):
                h, bounds = ss.sets_of(c, rule.shingle)
                node = ss.nodes_of(h, bounds)
                _, once = np.unique(node, return_index=True)
                size = np.diff(bounds)[once]
                at = np.repeat(bounds[once] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                key, owner = signatures(h[at], np.append(0, np.cumsum(size)), rule, sets)
                key, node = key.view(np.int64), node[once][owner]
                if shared is not None:
                    hit = ss.held(key, shared.value)
                    key, node = key[hit], node[hit]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], ["h", "node"])

    return run


def _inform(rule):
    """(doc_id, node, size, short sketch, long sketch) of every row."""

    def run(batches):
        for b in batches:
            cols, big = [[] for _ in range(2 + ss.SKETCH)], []
            for c in tn.chunks(b.column(1)):
                h, bounds = ss.sets_of(c, rule.shingle)
                size = np.diff(bounds)
                w = tn.words_of(c)
                size[np.diff(w.doc_start) == 0] = 0
                longs, first = ss.sketches(h, bounds)
                big.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(longs)))
                for to, x in zip(cols, (ss.nodes_of(h, bounds), size.astype(np.int32), *ss.folded(longs, first).T)):
                    to.append(x)
            if big:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.concatenate(x)) for x in cols], pa.concat_arrays(big)], ["doc_id", "node", "size", *ss.INFO, "sketch"])

    return run


def _members(docs: DataFrame, nodes: DataFrame, rule: ss.Rule) -> DataFrame:
    """(h, x): for every signature of several nodes, each of them."""
    sets = 2.0 ** round(log2(max(nodes.count(), 1))) * IN_BAND
    entries = docs.select("text").mapInArrow(tn.trimmed(_signed(rule, sets)), "h long, node long")
    ends = entries.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = written(ends.select("h"))
    keys = ss.keys_sent(shared, "h")
    own = docs.select("text").mapInArrow(tn.trimmed(_signed(rule, sets, keys)), "h long, node long") if keys is not None else entries.join(shared, "h", "left_semi")
    own = own.dropDuplicates(["h", "node"])
    return own.join(nodes.select("node", "size", *ss.INFO), "node").select("h", F.struct("node", "size", *ss.INFO).alias("x"))


def jaccard_groups(docs: DataFrame, rule: ss.Rule = RULE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, node long, size int, " + ", ".join(f"{s} long" for s in ss.INFO) + ", sketch array<long>"
    with scratch() as tables:
        rows = tables.keep(written(docs.mapInArrow(tn.trimmed(_inform(rule)), schema)))
        # A node's rows agree in size and sketches. Sets without shingles are no nodes.
        nodes = written(rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("size", *ss.INFO, "sketch")]))
        edges = ss.links(written(_members(docs, nodes, rule)), ss.Texts(docs, nodes, rule))
        table = tables.keep(ss.grouped(nodes, edges))
    full = rows.where("size > 0").select("doc_id", "node", "size").join(table, "node")
    found = full.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")
    return found.unionAll(rows.where("size = 0").select("doc_id", F.lit(0).cast("long"), F.col("doc_id")))
