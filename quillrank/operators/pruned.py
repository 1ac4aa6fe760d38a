"""Exact top k by cosine without meeting all pairs.

Candidates are put into blocks around pivots: a block knows its centre and its
radius, the widest angle between the centre and a member. No member can be closer
to an offer than the angle to the centre less the radius, which bounds its score.
An offer visits blocks in the order of their bounds, one at first and eight times
as many each round, and is done when its k-th score beats every bound that is left.
Where bounds rule out little, what is left is met in one round.

Blocks lie in parts of bounded size, large blocks in several. In a round an offer
goes once to each part that holds a block to visit; there offers and candidates are
multiplied as matrices, and pairs that may be among the k best are scored anew by
the same sums as vectors.cosine. State between rounds is the offers' best k so far,
their k-th score and how many blocks they have seen. Only pivots, centres and
radii are held whole, and their number is bounded.

Cases: vectors without direction (null or zero) score 0 with all, as in
vectors.cosine; a candidate or offer without a vector takes no part; of equal
scores the smaller ids come first; fewer than k candidates give as many rows;
repeated ids are rows of their own.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.vectors import norm
from quillrank.operators import ranking
from quillrank.sources.staging import written

#: Most pivots, and most numbers in them.
MOST_PIVOTS, MOST_NUMBERS = 4096, 4 << 20
#: Numbers in the vectors of a part, in those of the offers that meet it at once,
#: and in a table of scores.
PART_NUMBERS, OFFER_NUMBERS, TABLE = 1 << 20, 1 << 22, 1 << 21
#: Angle by which bounds are widened for rounding.
ROOM = 1e-7


class Pruned(NamedTuple):
    """rows (offer_id, posicion, cand_id, score); pairs that were scored, and all."""

    rows: DataFrame
    scored: int
    pairs: int


class Blocks(NamedTuple):
    """Candidates with their block and a number in their task; each block's centre
    (a unit vector, or zeros for vectors without direction), radius and size."""

    candidates: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def _dense(vectors: pa.Array) -> np.ndarray:
    n = len(vectors)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _sliced(batches, width: int):
    """The rows of Arrow batches, so many at once that a table of that width is small."""
    rows = max(1, TABLE // max(1, width))
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def pivots(candidates: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of a bounded number of candidates, the first in an order by
    hash; a last row of zeros is the centre of vectors without direction."""
    wide = candidates.agg(F.max(F.size("v"))).first()[0] or 1
    most = int(max(1, min(np.sqrt(max(n, 1)), MOST_PIVOTS, MOST_NUMBERS // wide)))
    got = candidates.where(norm(F.col("v")) > 0).orderBy(F.xxhash64("cand_id"), "cand_id").limit(most).select("v").toArrow().column(0).combine_chunks()
    found = _units(_dense(got)) if len(got) else np.empty((0, wide))
    return np.concatenate([found, np.zeros((1, wide))])


def blocks(candidates: DataFrame) -> Blocks:
    """candidates(cand_id, v) by their nearest pivot."""
    n = candidates.count()
    centres = pivots(candidates, n)
    sent = candidates.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        own, turn = sent.value, 0
        for b in _sliced(batches, len(own)):
            x = _units(_dense(b.column(1)))
            near = x @ own.T
            flat = ~x.any(axis=1)
            near[:, -1] = -2
            block = np.where(flat, len(own) - 1, near.argmax(axis=1))
            angle = np.where(flat, 0, np.arccos(np.clip(near[np.arange(len(x)), block], -1, 1)))
            turns = np.arange(turn, turn + len(x), dtype=np.int64)
            turn += len(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block.astype(np.int32)), pa.array(turns), pa.array(angle)], ["cand_id", "v", "block", "turn", "angle"])

    kind = dict(candidates.dtypes)
    held = written(candidates.select("cand_id", "v").mapInArrow(run, f"cand_id {kind['cand_id']}, v {kind['v']}, block int, turn long, angle double"))
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in held.groupBy("block").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():  # a row a pivot
        radii[r["block"]], sizes[r["block"]] = r["r"], r["n"]
    return Blocks(held.drop("angle"), centres, radii, sizes)


def bounds(x: np.ndarray, found: Blocks) -> np.ndarray:
    """The highest score that each block can give each unit vector; rows without
    direction score 0, empty blocks nothing."""
    angle = np.arccos(np.clip(x @ found.centres.T, -1, 1)) - found.radii - ROOM
    out = np.cos(np.maximum(angle, 0))
    out[:, -1] = 0
    out[~x.any(axis=1)] = 0
    out[:, found.sizes == 0] = -2
    return out


class Parts(NamedTuple):
    """Of each block its first part and how many it has."""

    first: np.ndarray
    count: np.ndarray


def parted(sizes: np.ndarray, rows: int) -> Parts:
    """Small blocks side by side in parts of up to so many rows, larger ones dealt
    over parts of their own."""
    first, count, at, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > rows:
            at, held = at + 1, 0
        first[i], count[i] = at, max(1, -(-n // rows))
        held += n
        if n > rows:
            at, held = at + int(count[i]), 0
    return Parts(first, count)


def _visits(sent, first: int, margin: float, deals: int):
    """(offer_id, o, least, part, deal, own, n): the parts that each offer goes to
    next, the blocks it visits there, and the rows of these that it has not been
    counted with: of the blocks in the order of their bounds, from the place it has
    come to, those that may beat its k-th score."""

    def run(batches):
        found, parts = sent.value
        turn = 0
        for b in _sliced(batches, len(found.sizes)):
            best = bounds(_units(_dense(b.column(1))), found)
            order = np.argsort(-best, axis=1, kind="stable")
            rank = np.take_along_axis(best, order, axis=1)
            seen, least = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            place = np.arange(order.shape[1])[None, :]
            go = (place >= seen[:, None]) & (place < seen[:, None] + first) & (rank > -2) & (rank >= np.where(np.isnan(least), -np.inf, least)[:, None] - margin)
            row, at = np.nonzero(go)
            block = order[row, at]
            # A block in several parts is counted in its first.
            times = parts.count[block]
            nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            row, block = np.repeat(row, times), np.repeat(block, times)
            part, n = parts.first[block] + nth, np.where(nth == 0, found.sizes[block], 0)
            by = np.lexsort((block, part, row))
            row, part, block, n = row[by], part[by], block[by], n[by]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
            start = np.flatnonzero(new)
            own = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(block.astype(np.int32)))
            total = np.add.reduceat(n, start) if len(start) else np.zeros(0, np.int64)
            who, deal = pa.array(row[start]), ((turn + row[start]) % deals).astype(np.int32)
            turn += b.num_rows
            for lo in range(0, len(start), 4096):  # vectors are repeated
                cut = slice(lo, lo + 4096)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i).take(who[cut]) for i in (0, 1, 3)], pa.array(part[start][cut].astype(np.int32)), pa.array(deal[cut]), own[cut], pa.array(total[cut].astype(np.int64))],
                    ["offer_id", "o", "least", "part", "deal", "own", "n"],
                )

    return run


def _added(x: np.ndarray) -> np.ndarray:
    """The sum of each row, from the first number to the last, as vectors.dot adds."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _cosines(o: np.ndarray, v: np.ndarray, on: np.ndarray, vn: np.ndarray) -> np.ndarray:
    both = on * vn
    return np.where(both == 0, 0.0, _added(o * v) / np.where(both == 0, 1, both))


def _firsts(row: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int, places: int | None) -> np.ndarray:
    """Which pairs can be among the k first of their row once scores are rounded,
    half up, and ties go by rank. Scores near the half of a unit are all kept."""
    if places is None:
        unit, unsure = score, np.zeros(len(score), bool)
    else:
        scaled = score * 10.0**places
        unit, unsure = np.floor(scaled + 0.5), np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4
    sure = np.flatnonzero(~unsure)
    by = sure[np.lexsort((rank[sure], -unit[sure], row[sure]))]
    new = np.diff(row[by], prepend=-1) != 0
    start = np.flatnonzero(new)
    first = by[np.arange(len(by)) - start[np.cumsum(new) - 1] < k] if len(by) else by
    return np.concatenate([first, np.flatnonzero(unsure)])


def _meet(k: int, places: int | None, margin: float):
    """(offer_id, cand_id, score) of the pairs of a part that may be among the k
    best: offers visit the blocks they name."""

    def run(visits: pa.Table, candidates: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], []]
        if visits.num_rows and candidates.num_rows:
            block = candidates.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            candidates = candidates.take(pa.array(order)).combine_chunks()
            block, ids = block[order], candidates.column("cand_id").combine_chunks()
            rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
            v = _dense(candidates.column("v").combine_chunks())
            vn, vu = np.sqrt(_added(v * v)), _units(v)
            held, start = np.unique(block, return_index=True)
            ends = np.append(start[1:], len(block))
            step = max(1, TABLE // len(block))
            for lo in range(0, visits.num_rows, step):
                some = visits.slice(lo, step).combine_chunks()
                o = _dense(some.column("o").combine_chunks())
                on, ou = np.sqrt(_added(o * o)), _units(o)
                own = some.column("own").combine_chunks()
                whose = np.repeat(np.arange(len(o)), np.diff(own.offsets.to_numpy()))
                go = np.zeros((len(o), len(held)), bool)
                wanted = own.flatten().to_numpy()
                at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                hit = held[at] == wanted
                go[whose[hit], at[hit]] = True
                table = np.full((len(o), len(block)), -np.inf)
                if go.all():
                    np.matmul(ou, vu.T, out=table)
                else:
                    for j in range(len(held)):
                        rows = np.flatnonzero(go[:, j])
                        if len(rows):
                            table[rows, start[j] : ends[j]] = ou[rows] @ vu[start[j] : ends[j]].T
                least = some.column("least").to_numpy()
                least = np.where(np.isnan(least), -2.0, least)
                many = np.flatnonzero((table >= (least - margin)[:, None]).sum(axis=1) > 4 * k)
                if len(many):
                    least[many] = np.maximum(least[many], np.partition(table[many], -k, axis=1)[:, -k])
                row, col = np.nonzero(table >= (least - margin)[:, None])
                score = np.concatenate([_cosines(o[row[a:z]], v[col[a:z]], on[row[a:z]], vn[col[a:z]]) for a, z in _cuts(len(row), TABLE // max(1, v.shape[1]))] or [np.zeros(0)])
                keep = _firsts(row, score, rank[col], k, places)
                cols[0].append(some.column("offer_id").combine_chunks().take(pa.array(row[keep])))
                cols[1].append(ids.take(pa.array(col[keep])))
                cols[2].append(pa.array(score[keep]))
        kinds = (visits.schema.field("offer_id").type, candidates.schema.field("cand_id").type, pa.float64())
        return pa.table({name: pa.chunked_array(c, t) for name, c, t in zip(("offer_id", "cand_id", "score"), cols, kinds)})

    return run


def _cuts(n: int, step: int):
    return [(a, min(a + max(1, step), n)) for a in range(0, n, max(1, step))]


def top_k(offers: DataFrame, candidates: DataFrame, k: int, places: int | None = None, found: Blocks | None = None) -> Pruned:
    """The first k candidates(cand_id, v) of offers(offer_id, v) by cosine, rounded
    to so many places, if any; ``found`` are blocks() of the same candidates."""
    offers, k = written(offers.where(F.col("v").isNotNull()).select("offer_id", "v")), max(k, 1)
    candidates = candidates.where(F.col("v").isNotNull())
    found = found or blocks(candidates)
    light, sc = Blocks(None, *found[1:]), offers.sparkSession.sparkContext
    wide, total = max(1, found.centres.shape[1]), int(found.sizes.sum())
    parts = parted(found.sizes, max(1, min(PART_NUMBERS // wide, -(-total // (4 * sc.defaultParallelism)))))
    sent = sc.broadcast((light, parts))
    kind, cand, margin = dict(offers.dtypes), dict(found.candidates.dtypes), 0.0 if places is None else 10.0**-places
    n = offers.count() if total else 0
    deals = max(1, -(-n * wide // OFFER_NUMBERS))
    longs = lambda x: F.array(*[F.lit(int(i)) for i in x])
    part = F.get(longs(parts.first), F.col("block")) + F.col("turn") % F.get(longs(parts.count), F.col("block"))
    dealt = found.candidates.select("cand_id", "v", "block", part.cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    best, scored, seen, step = None, 0, 0, 1
    while seen < len(found.sizes) and n:
        open_ = offers.withColumn("seen", F.lit(seen))
        if best is None:
            open_ = open_.withColumn("least", F.lit(None).cast("double"))
        else:
            last = best.groupBy("offer_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("offer_id", "least")
            open_ = open_.join(last, "offer_id", "left")
        schema = f"offer_id {kind['offer_id']}, o {kind['v']}, least double, part int, deal int, own array<int>, n long"
        visits = written(open_.select("offer_id", "v", "seen", "least").mapInArrow(_visits(sent, step, margin, deals), schema))
        more = visits.agg(F.sum("n")).first()[0]
        if not more:
            break
        scored += more
        met = visits.groupBy("part", "deal").cogroup(dealt.groupBy("part", "deal")).applyInArrow(_meet(k, places, margin + 1e-9), f"offer_id {kind['offer_id']}, cand_id {cand['cand_id']}, score double")
        if places is not None:
            met = met.withColumn("score", F.round("score", places))
        rows = met if best is None else best.select("offer_id", "cand_id", "score").unionAll(met)
        best = written(ranking.top_k(rows, k))
        # Bounds that rule out less than half will not do so for blocks further off.
        whole = seen and more * 2 > n * total * min(1.0, step / np.count_nonzero(found.sizes))
        seen, step = seen + step, len(found.sizes) if whole else 8 * step
    if best is None:
        best = ranking.top_k(offers.select("offer_id", F.lit(None).cast(dict(candidates.dtypes)["cand_id"]).alias("cand_id"), F.lit(0.0).alias("score")).where("false"), k)
    return Pruned(best.select("offer_id", "posicion", "cand_id", "score"), scored, n * total)
