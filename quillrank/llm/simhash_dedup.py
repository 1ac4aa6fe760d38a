"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits, each set if over half of a document's 3-word shingle
hashes have it. The link search works on distinct fingerprints:

* bits are grouped into m partitions by their correlation, measured over all
  fingerprints;
* thresholds t_i with sum(t_i + 1) = tau + 1 are allocated to partitions by
  dynamic programming on estimated candidate counts, so a partition may be
  probed within a radius or not at all. Numbers of partitions are weighed up the
  same way: few fingerprints are best met by exact values of narrow partitions,
  many by wide ones within a radius, where a narrow value would be shared by
  many fingerprints that are far apart;
* probes meet the index on (partition, value) and pairs are verified.

Candidate counts are estimated from a sample of fingerprints, and from what
evenly spread ones would give where the sample is too small to tell. They only
steer the plan; any allocation finds all links.

A value that many fingerprints share is not paired up. Two fingerprints are
within 2 bits exactly if some 64-bit value lies within 1 bit of both, so its
members, and those whose probes meet it, send their 65 neighbours (for tau = 2)
and meet in stars: 65 rows a fingerprint, however large the group, and no link
is lost.

Cases: null and blank texts have fingerprint 0 and are linked like any other;
a text of one or two words is one shingle; repeated rows are linked to
themselves only; a null doc_id is reported without a component of its own
(the smallest linked id, else null); extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import textnum as tn
from quillrank.llm.components import components
from quillrank.llm.store import broadcast_if_small, scratch, written

BITS = 64
TAU = 2
SHINGLE = 3
SEED = 42
#: Members of a (partition, value) beyond which stars replace pairs.
HOT = 32
#: Rows from which a fingerprint's component is sent to every task, and most such
#: fingerprints; beyond it all are joined.
MANY, SENT = 1000, 200_000
#: Fingerprints from which candidate counts are estimated.
SAMPLE = 1 << 14


def _shingle_hashes(chunk: tn.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the chunk, and each document's first one."""
    w = tn.words_of(chunk)
    data = tn.ascii_lower(chunk.data)
    # Words joined by one space each: drop separators, then put one behind each word.
    lengths = w.ends - w.starts
    at = np.cumsum(lengths + 1) - (lengths + 1)
    joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
    inside = np.repeat(w.starts - at, lengths + 1) + np.arange(len(joined))
    body = np.ones(len(joined), bool)
    body[at + lengths] = False
    joined[body] = data[inside[body]]
    per_doc = np.diff(w.doc_start)
    count = np.where(per_doc == 0, 0, np.maximum(per_doc - n + 1, 1))
    first = np.cumsum(count) - count
    idx = np.repeat(w.doc_start[:-1] - first, count) + np.arange(int(count.sum()))
    last = np.minimum(idx + n, np.repeat(w.doc_start[1:], count)) - 1
    raw, hashed = joined.tobytes(), xxhash.xxh64_intdigest
    stops = at[last] + lengths[last] if len(idx) else idx
    out = np.fromiter((hashed(raw[a:b], SEED) for a, b in zip(at[idx].tolist(), stops.tolist())), np.uint64, len(idx))
    return out, np.append(first, len(out))


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each document from its run of hashes."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    if not len(hashes):
        return out
    for lo in range(0, len(out), 64):
        hi = min(lo + 64, len(out))
        own = hashes[bounds[lo] : bounds[hi]]
        if not len(own):
            continue
        sizes = np.diff(bounds[lo : hi + 1])
        full = np.flatnonzero(sizes)
        bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, (bounds[lo:hi] - bounds[lo])[full], axis=0, dtype=np.int32)
        on = (2 * sums > sizes[full][:, None]).astype(np.uint8)
        out[lo + full] = np.packbits(on, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _fingerprints(n: int):
    def run(batches):
        for b in batches:
            found = [majority(*_shingle_hashes(c, n)) for c in tn.chunks(b.column(1))]
            fp = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tn.trimmed(_fingerprints(shingle)), "doc_id long, fp long"
    )


def _bit_sums(batches):
    """Counts of each pair of set bits: 64 x 64 numbers for a whole task."""
    total = np.zeros((BITS, BITS))
    n = 0
    for b in batches:
        raw = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        for own in np.array_split(raw, max(1, len(raw) // 65536)):
            x = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += x.T @ x
            n += len(own)
    at = np.arange(BITS * BITS + 1)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total.ravel(), n))], ["cell", "n"])


def bit_correlation(fps: DataFrame) -> np.ndarray:
    rows = fps.mapInArrow(_bit_sums, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:  # 4097 rows, whatever the input
        flat[r["cell"]] = r["n"]
    n = max(flat[-1], 1.0)
    both = flat[:-1].reshape(BITS, BITS) / n
    p = np.diag(both).copy()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of even width; each grows by its most correlated free bit."""
    free, groups = set(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        seed = max(sorted(free), key=lambda i: sum(corr[i][j] for j in free if j != i))
        own = [seed]
        free.remove(seed)
        while len(own) < width:
            best = max(sorted(free), key=lambda i: sum(corr[i][j] for j in own))
            own.append(best)
            free.remove(best)
        groups.append(sorted(own))
    return groups


def allocate(costs: list[list[float]], tau: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = tau + 1 of least total cost.

    costs[i][t + 1] is the cost of probing partition i within t bits.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, tau - used + 1):
                key = used + t + 1
                if key <= tau + 1 and t + 1 < len(cost):
                    found = (total + cost[t + 1], [*chosen, t])
                    if key not in after or found < after[key]:
                        after[key] = found
        best = after
    return best[tau + 1][1]


@lru_cache(None)
def flips(bits: tuple[int, ...], radius: int) -> list[int]:
    """Masks (as signed longs) of at most radius of the given bits."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def expected_pairs(sample: np.ndarray, bits: list[int], radius: int, n: float) -> float:
    """Pairs among n fingerprints that agree in these bits but for radius of
    them: what the sample shows, scaled up, or even spread if that is more."""
    even = n * n / 2 * comb_sum(len(bits), radius) / 2.0 ** len(bits)
    s = len(sample)
    if s < 2 or radius > 1:  # wider radii: even spread, times what radius 1 shows beyond it
        if s < 2:
            return even
        near = n * n / 2 * comb_sum(len(bits), 1) / 2.0 ** len(bits)
        return even * max(1.0, expected_pairs(sample, bits, 1, n) / near)
    values, counts = np.unique(sample & np.uint64(sum(1 << b for b in bits)), return_counts=True)
    met = float((counts * (counts - 1.0)).sum() / 2)
    if radius:
        for b in bits:
            flipped = values ^ np.uint64(1 << b)
            at = np.minimum(np.searchsorted(values, flipped), len(values) - 1)
            met += float((counts * counts[at] * (values[at] == flipped)).sum() / 2)
    return max(even, met * n * (n - 1) / (s * (s - 1.0)))


def plan(corr: np.ndarray, sample: np.ndarray, n: float, tau: int, sizes=None) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of the least estimated cost: rows of index and
    probes, and candidates."""
    best = None
    for m in sizes or range(1, tau + 3):
        parts = group_bits(corr, m)
        costs = [[0.0] + [n + comb_sum(len(p), t) * n + expected_pairs(sample, p, t, n) for t in range(tau + 1)] for p in parts]
        chosen = allocate(costs, tau)
        cost = sum(c[t + 1] for c, t in zip(costs, chosen))
        if best is None or cost < best[0]:
            best = (cost, parts, chosen)
    return best[1:]


def links(fps: DataFrame, tau: int = TAU, m: int | None = None, found=None) -> DataFrame:
    """Edges (a, b) between fingerprints whose components are those of all
    links at tau or fewer bits. fps holds distinct fingerprints (fp). m fixes the
    number of partitions, found partitions and thresholds."""
    if found is None:
        sample = fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).toArrow().column(0).to_numpy().view(np.uint64)
        found = plan(bit_correlation(fps), sample, float(fps.count()), tau, [m] if m else None)
    parts, thresholds = found
    probed = [i for i, t in enumerate(thresholds) if t >= 0]
    masks = [_signed(sum(1 << b for b in p)) for p in parts]
    values = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(masks[i])).alias("value")) for i in probed])
    spread = fps.select("fp", F.explode(values).alias("v")).select("fp", "v.part", "v.value")
    sizes = written(spread.groupBy("part", "value").agg(F.count("*").alias("n")).where("n > 1"))
    # Values shared by a few: pair up within the value. Shared by many: stars.
    own = written(spread.join(sizes, ["part", "value"]).select("fp", "part", "value", "n"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= tau
    few = own.where(F.col("n") <= HOT)
    left, right = few.select(F.col("fp").alias("a"), "part", "value"), few.select(F.col("fp").alias("b"), "part", "value")
    out = left.join(right, ["part", "value"]).where((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b")
    hot = own.where(F.col("n") > HOT).select("fp")
    for i in probed:
        if thresholds[i] > 0:  # a radius: probe the index with flipped values
            flipped = F.array(*[F.lit(x) for x in flips(tuple(parts[i]), thresholds[i]) if x])
            probes = fps.select(F.col("fp").alias("a"), F.explode(flipped).alias("flip")).select("a", F.col("a").bitwiseAND(F.lit(masks[i])).bitwiseXOR(F.col("flip")).alias("value"))
            crowded = sizes.where((F.col("part") == i) & (F.col("n") > HOT)).select("value")
            index = fps.select(F.col("fp").alias("b"), F.col("fp").bitwiseAND(F.lit(masks[i])).alias("value")).join(crowded, "value", "left_anti")
            out = out.unionAll(probes.join(index, "value").where((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b"))
            # A link into a crowded value has its other end among its probers.
            hot = hot.unionAll(probes.join(crowded, "value", "left_semi").select("a"))
    return out.unionAll(stars(hot.distinct(), tau))


def comb_sum(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def stars(fps: DataFrame, tau: int) -> DataFrame:
    """Edges from each star's members to its smallest. For an even tau members
    of a star at tau // 2 flips are within tau of each other; an odd tau needs
    one more flip on one side and a check of each edge, so it is refused."""
    if tau % 2:
        raise ValueError("stars need an even tau")
    masks = F.array(*[F.lit(x) for x in flips(tuple(range(BITS)), tau // 2)])
    met = fps.select("fp", F.explode(masks).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    low = met.groupBy("centre").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    return met.join(low.select("centre", "low"), "centre").where("fp > low").select(F.col("low").alias("a"), F.col("fp").alias("b"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links."""
    with scratch() as tables:
        prints = tables.keep(written(fingerprints(docs, id_col, text_col, shingle)))
        # One node per fingerprint, however many copies it has.
        nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
        joined = components(links(nodes.select("fp"), tau).distinct())
        named = joined.join(nodes, joined["node"] == nodes["fp"]).select("fp", "component", "rep")
        low = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        moved = named.join(low, "component").select("fp", "component_id")
        found = nodes.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "rep").alias("component_id"))
        found = tables.keep(written(found))
        # Fingerprints of many rows, as that of all blank texts, are sent to the rows:
        # there are fewer of them than their rows by a factor of MANY.
        many = found.where(F.col("n") >= MANY)
        count = many.count()
    if not count or count > SENT:
        return prints.join(found.hint("merge"), "fp").select("doc_id", "fp", "component_id")
    often = broadcast_if_small(many.select("fp", "component_id"), count, SENT)
    rest = prints.join(broadcast_if_small(many.select("fp"), count, SENT), "fp", "left_anti")
    return prints.join(often, "fp").select("doc_id", "fp", "component_id").unionAll(rest.join(found.hint("merge"), "fp").select("doc_id", "fp", "component_id"))
