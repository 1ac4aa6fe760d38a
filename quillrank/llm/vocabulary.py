"""Token counts over whole corpora, and the most frequent tokens.

Tokens are 64-bit hashes. Counts of all documents are gathered by one
aggregation; the frequent ones come to the driver as a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import textnum as tn


def _merged(parts):
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _rows(h, c):
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])


def counted(docs: DataFrame, hashes: Callable[[tn.Chunk], np.ndarray]) -> DataFrame:
    """(h, c) over all tokens of the documents' texts."""

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for c in tn.chunks(b.column(0)):
                parts.append(np.unique(hashes(c), return_counts=True))
                held += len(parts[-1][0])
                if held > 1 << 21:  # merge, and give away what stays too large
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > 1 << 20:
                        yield _rows(*parts[0])
                        parts, held = [], 0
        if parts:
            yield _rows(*_merged(parts))

    return docs.select("text").mapInArrow(tn.trimmed(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Frequent(NamedTuple):
    """n: tokens; v: distinct; keys, counts: of the frequent ones, keys sorted."""

    n: int
    v: int
    keys: np.ndarray
    counts: np.ndarray

    def places(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the keys; len(keys) where absent."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, len(self.keys))


def frequent(counts: DataFrame, limit: int) -> Frequent:
    """The most frequent tokens, ``limit`` or a few less. Counts are binned; of the
    bin that the limit cuts, as many as there is room for are taken by a hash."""
    c = F.col("c")
    bin_of = F.floor(F.log2(c) * 16)
    bins = counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()
    total, distinct, room, wanted = sum(r["n"] for r in bins), sum(r["v"] for r in bins), limit, F.lit(False)
    for r in sorted(bins, key=lambda r: -r["bin"]):  # a few hundred bins
        if r["v"] > room:
            share = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(room / r["v"] * (1 << 20))
            wanted = wanted | ((bin_of == r["bin"]) & share)
            break
        room -= r["v"]
        wanted = bin_of >= r["bin"]
    got = counts.where(wanted).toArrow()
    keys, n = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.lexsort((keys, -n))[:limit]  # the share is met on average
    order = order[np.argsort(keys[order])]
    return Frequent(total, distinct, keys[order], n[order].astype(np.float64))
