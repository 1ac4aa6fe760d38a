"""Choose toxicity's training settings from its training rows alone.

`python -m quillrank.llm.toxicity_settings SF_DIR` takes the labelled rows that
op3 may learn from (the held-out remainder is never read), holds each of their
other remainders out in turn, and prints, per setting, the log loss, and recall
and false alarms with the lean, over these folds. The least log loss wins.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np
import pyarrow.dataset as ds

from quillrank.llm import toxicity as tx

GRID = {"steady": (1000, 3000, 8000), "decay": (0.05, 0.1), "damping": (1e-2,)}
FOLDS = tuple(r for r in range(tx.MOD) if r != tx.HELD)
_ROWS: dict = {}


def training_rows(sf_dir: str):
    """Texts, labels and remainders of the labelled training rows."""
    labels = ds.dataset(f"{sf_dir}/labels.parquet").to_table(columns=["doc_id", "toxic"]).to_pydict()
    y = {i: t for i, t in zip(labels["doc_id"], labels["toxic"]) if i is not None and t in (0, 1) and zlib.crc32(str(i).encode()) % tx.MOD != tx.HELD}
    docs = ds.dataset(f"{sf_dir}/documents.parquet").to_table(columns=["doc_id", "text"], filter=ds.field("doc_id").isin(list(y))).to_pydict()
    kept = [(i, t or "") for i, t in zip(docs["doc_id"], docs["text"])]
    return [t for _, t in kept], np.array([y[i] for i, _ in kept]), np.array([zlib.crc32(str(i).encode()) % tx.MOD for i, _ in kept])


def _fold(job):
    import pyarrow as pa

    sf_dir, setting, r = job
    if sf_dir not in _ROWS:
        _ROWS[sf_dir] = training_rows(sf_dir)
    text, y, rest = _ROWS[sf_dir]
    fit, test = np.flatnonzero(rest != r), np.flatnonzero(rest == r)
    model = tx.train(pa.array([text[i] for i in fit]), y[fit].tolist(), **setting)
    z = tx.document_logits(pa.array([text[i] for i in test]), *model)
    hit = 1 / (1 + np.exp(-np.clip(z + tx.LEAN, -500, 500))) >= tx.THRESHOLD
    own = y[test]
    return np.array([np.logaddexp(0, np.where(own == 1, -z, z)).sum(), len(own), (hit & (own == 1)).sum(), own.sum(), (hit & (own == 0)).sum(), (own == 0).sum()])


def compare(sf_dir: str, workers: int = 4):
    """(log loss, recall, false alarm share, setting) of every setting."""
    settings = [dict(zip(GRID, v)) for v in itertools.product(*GRID.values())]
    jobs = [(sf_dir, s, r) for s in settings for r in FOLDS]
    if workers == 1:
        got = list(map(_fold, jobs))
    else:
        with ProcessPoolExecutor(workers) as pool:
            got = list(pool.map(_fold, jobs))
    got = np.array(got).reshape(len(settings), len(FOLDS), -1).sum(1)
    return [(g[0] / g[1], g[2] / g[3], g[4] / g[5], s) for g, s in zip(got, settings)]


if __name__ == "__main__":
    for loss, recall, alarms, setting in sorted(compare(sys.argv[1]), key=lambda x: x[0]):
        print(f"log loss {loss:.4f}  recall {recall:.3f}  false alarms {alarms:.4f}  {setting}")
