"""Rankings that follow candidates as they arrive.

Each offer's best rows are keyed state. A candidate is scored against all offers of
a checked size; each task hands on only the best of each Arrow batch, so what meets
at an offer's state is a few rows a task. The state after a stream is the ranking of
all its candidates, and outlives a restart with the query's checkpoint.

Candidates are taken to come once: one that comes again is ranked again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillrank.functions.vectors import cosine
from quillrank.operators.ranking import OFFER_ROWS, few

_RANKED = "offer_id long, posicion int, cand_id long, score double"
_STATE = "ids array<long>, scores array<double>"


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k of each offer, ties by id."""
    return rows.sort_values(["offer_id", "score", "cand_id"], ascending=[True, False, True], kind="stable").groupby("offer_id", sort=False).head(k)


def _partial(k: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pandas(_best(b.to_pandas(), k), schema=b.schema, preserve_index=False)

    return run


def _follow(k: int):
    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, scores = state.get if state.exists else ([], [])
        held = pd.DataFrame({"offer_id": key[0], "cand_id": list(ids), "score": list(scores)}).astype({"offer_id": "int64", "cand_id": "int64", "score": "float64"})
        for part in parts:
            held = _best(pd.concat([held, part[held.columns]]), k)
        state.update((held["cand_id"].tolist(), held["score"].tolist()))
        yield held.assign(posicion=range(1, len(held) + 1)).astype({"posicion": "int32"})[["offer_id", "posicion", "cand_id", "score"]]

    return update


def follow(candidates: DataFrame, offers: DataFrame, k: int) -> DataFrame:
    """(offer_id, posicion, cand_id, score): of a stream of candidates (cand_id, v)
    the best k of each offer (offer_id, v), whenever new ones come; update mode.
    offers is a table of at most ranking.OFFER_ROWS rows."""
    if not few(offers, OFFER_ROWS):
        raise ValueError(f"more than {OFFER_ROWS} offers: follow them by several queries")
    own = offers.select(F.col("offer_id").cast("long").alias("offer_id"), F.col("v").alias("o"))
    pairs = candidates.where(F.col("v").isNotNull()).crossJoin(F.broadcast(own))
    scored = pairs.select("offer_id", F.col("cand_id").cast("long").alias("cand_id"), cosine(F.col("o"), F.col("v")).alias("score"))
    few_rows = scored.mapInArrow(_partial(max(k, 1)), "offer_id long, cand_id long, score double")
    return few_rows.groupBy("offer_id").applyInPandasWithState(_follow(max(k, 1)), _RANKED, _STATE, "update", GroupStateTimeout.NoTimeout)
