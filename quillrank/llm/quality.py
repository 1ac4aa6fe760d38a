"""Quality classifier: random-indexing word vectors, pooled, and a small net.

Each of the WORDS most frequent words, counted over all documents, has a fixed
sparse index vector and a word vector of its own: the sum of the index vectors
of its neighbours (two words each way) over all documents, one distributed pass
with a table of bounded size per task. Rarer words, of which each has met too
few neighbours to tell much, share TAIL further vectors by hash. A document
pools its words' vectors by mean and mean square; a two-layer numpy network on
top is trained on a bounded labelled sample. A temperature fitted on a part kept
from training, and the classes' shares among all labels, calibrate its
probabilities.

Tokens are runs of letters and digits, runs of other marks, and, for words in
capitals, the one token that stands for capitals.

Cases: null and empty texts pool to zero and are scored; no labels of one
class give a constant score; repeated rows score alike; null ids are kept;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import textnum as tn
from quillrank.llm.labelled import fold, sample
from quillrank.llm.store import scratch, written
from quillrank.llm.vocabulary import Frequent, counted, frequent

#: Words with a vector of their own, and vectors that all others share.
WORDS, TAIL = 1 << 16, 1 << 12
DIM = 64
REACH = 2
THRESHOLD = 0.5
MOD, HELD = 3, 1

_KIND = np.zeros(256, np.uint8)  # 0 mark, 1 letter or digit, 2 space
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 2
_CAPS = np.uint64(1)


def _tokens(c: tn.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the chunk and each document's first token."""
    data = c.data
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(c.offsets), np.int64)
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[c.offsets[:-1][c.offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    solid = kind[starts] != 2
    starts, ends = starts[solid], ends[solid]
    h = tn.word_hash(tn.ascii_lower(data), starts, ends, 0)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    h[(upper[ends] - upper[starts] == ends - starts) & (ends - starts >= 2)] = _CAPS
    return h, np.searchsorted(starts, c.offsets)


def _ids(words: Frequent, h: np.ndarray) -> np.ndarray:
    """Vector of each hash: its own, or one that rare words share."""
    at = words.places(h)
    return np.where(at < len(words.keys), at, len(words.keys) + (h % np.uint64(TAIL)).astype(np.int64))


def index_vectors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two signed places per vector, from its number."""
    h = tn.mix(np.arange(2 * n, dtype=np.uint64) + np.uint64(17)).reshape(n, 2)
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def _contexts(sent):
    def run(batches):
        words = sent.value
        size = len(words.keys) + TAIL
        place, sign = index_vectors(size)
        table = np.zeros((size, DIM), np.float32)
        for b in batches:
            for c in tn.chunks(b.column(0)):
                h, first = _tokens(c)
                u, back = np.unique(h, return_inverse=True)
                own = _ids(words, u)
                met = np.zeros(len(u) * DIM)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for step in range(1, REACH + 1):
                    near = np.flatnonzero(doc[step:] == doc[:-step])
                    for a, z in ((near, near + step), (near + step, near)):
                        for k in range(2):
                            z_id = own[back[z]]
                            met += np.bincount(back[a] * DIM + place[z_id, k], weights=sign[z_id, k], minlength=len(met))
                np.add.at(table, own, met.reshape(-1, DIM).astype(np.float32))
        used = np.flatnonzero(np.abs(table).sum(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(table[used, i]) for i in range(DIM)]], ["word", *[f"v{i}" for i in range(DIM)]])

    return run


class Vectors(NamedTuple):
    """Unit rows: of the frequent words in the order of their keys, then TAIL shared ones."""

    words: Frequent
    table: np.ndarray


def word_vectors(docs: DataFrame, limit: int = WORDS) -> Vectors:
    """Counted and summed over all documents."""
    with scratch():
        words = frequent(written(counted(docs, lambda c: _tokens(c)[0])), limit)
    sent = docs.sparkSession.sparkContext.broadcast(words)
    names = [f"v{i}" for i in range(DIM)]
    rows = docs.select("text").mapInArrow(tn.trimmed(_contexts(sent)), "word int, " + ", ".join(f"{n} float" for n in names))
    got = rows.groupBy("word").agg(*[F.sum(F.col(n).cast("double")).cast("float").alias(n) for n in names]).toArrow()
    table = np.zeros((len(words.keys) + TAIL, DIM))
    table[got.column("word").to_numpy()] = np.column_stack([got.column(n).to_numpy() for n in names])
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return Vectors(words, (table / np.where(norm > 0, norm, 1)).astype(np.float32))


def pooled(text: pa.Array, vectors: Vectors) -> np.ndarray:
    """Mean and mean square (times 4) of the word vectors of each document."""
    out = []
    for c in tn.chunks(text):
        h, first = _tokens(c)
        n = np.diff(first)
        u, back = np.unique(h, return_inverse=True)
        rows = vectors.table[_ids(vectors.words, u)]
        rows = np.hstack([rows, rows**2 * 4])
        doc, total = np.repeat(np.arange(len(n)), n), np.zeros((len(n), 2 * DIM))
        for lo in range(0, len(h), 1 << 14):
            own = doc[lo : lo + (1 << 14)]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[cuts]] += np.add.reduceat(rows[back[lo : lo + (1 << 14)]], cuts, axis=0)
        out.append(total / np.maximum(n, 1)[:, None])
    return np.vstack(out) if out else np.zeros((0, 2 * DIM))


def _forward(x, net):
    mean, spread, w1, b1, w2, b2 = net
    h = np.maximum(((x - mean) / spread) @ w1 + b1, 0)
    return h, h @ w2 + b2


def train(x: np.ndarray, y: list[int], hidden: int = 32, epochs: int = 60, rate: float = 0.005, seed: int = 3):
    """(network, temperature); a fifth of the sample only sets the latter."""
    y = np.asarray(y, np.float64)
    rng = np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        rest = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        d = x.shape[1]
        return (np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.array([rest])), 1.0
    order = rng.permutation(len(y))
    check, fit = order[: len(y) // 5], order[len(y) // 5 :]
    mean, spread = x[fit].mean(0), x[fit].std(0) + 1e-6
    d = x.shape[1]
    net = [mean, spread, rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net[2:]]
    t = 0
    for _ in range(epochs):
        for own in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            z0 = (x[own] - mean) / spread
            h, z = _forward(x[own], net)
            g = (1 / (1 + np.exp(-z[:, 0])) - y[own])[:, None] / len(own)
            gh = (g @ net[4].T) * (h > 0)
            grads = (z0.T @ gh + 1e-4 * net[2], gh.sum(0), h.T @ g + 1e-4 * net[4], g.sum(0))
            t += 1
            for i, gr in enumerate(grads):
                m, v = moments[i]
                m += 0.1 * (gr - m)
                v += 0.001 * (gr * gr - v)
                net[2 + i] = net[2 + i] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    z = _forward(x[check], net)[1][:, 0]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, np.where(y[check] > 0, -z, z) / t)) if len(z) else 0 for t in grid]
    return tuple(net), float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, mod: int = MOD, held: int = HELD, rows: tuple[int, int] = (4000, 4000)):
    """(word vectors over all documents, network, temperature, shift): the last is
    added to the logit, as the classes' shares are those of all labels."""
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def learn(text: pa.Array) -> dict:
        x = pooled(text, sent.value).astype(np.float32)
        return {"x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))}

    with scratch():
        got, order, y, shift = sample(docs, labels, "quality", mod, held, rows, learn, "x array<float>")
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), 2 * DIM)[order]
    return (vectors, *train(x, y), shift)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent, net, temperature, shift = docs.sparkSession.sparkContext.broadcast(model[0]), *model[1:]

    def run(batches):
        for b in batches:
            z = _forward(pooled(b.column(1), sent.value), net)[1][:, 0] / temperature + shift
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    got = docs.select("doc_id", "text").mapInArrow(tn.trimmed(run), f"doc_id {kind}, score double")
    return got.select("doc_id", (fold(F.col("doc_id"), MOD) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
