"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Token counts of all training documents are gathered by 64-bit token hash. Every
token has a class: the TOP most frequent ones are parted by frequency, all
others by a hash of their last letters, or into one class if they hold none.
P(token | history) is P(class | history) * P(token | class, history). The class
of every token, however rare, is predicted by a maximum-entropy model over hashed
features: the previous token, the one before it (a skip), and the pair. Within a
class of frequent tokens a second such model tells the token; within the others a
token has its smoothed share of the class's counts. Biases start at the smoothed
unigram model, so training can only move away from it where the data say so.

Training: every task runs adaptive gradient steps over its training documents
from the shared weights and returns the change; changes are averaged by tokens
in one aggregation over bounded parameter blocks. Scoring is sparse numpy
batches. Counts of frequent tokens go out as a table of bounded size; every
other token of a document is looked up by a join.

Cases: null and empty texts have the end token only; tokens never seen in
training have c = 0; rows that repeat (doc_id, text) are each scored; null ids
are kept and belong to the fold of the empty id; extra columns are ignored;
with no training documents all counts are 0; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import textnum as tn
from quillrank.llm.labelled import fold
from quillrank.llm.store import scratch, written
from quillrank.llm.vocabulary import counted, frequent

MOD, HELD = 5, 1
#: Classes of frequent tokens and their size, and classes by last letters. The
#: class behind these takes rare tokens without letters.
WORD_CLASSES, PER_CLASS, ENDINGS = 16, 32, 15
CLASSES = WORD_CLASSES + ENDINGS
TOP = WORD_CLASSES * PER_CLASS
#: Most entries of the table of frequent tokens that every task gets.
FREQUENT = 1 << 17
HISTORY, PAIR_BITS, WORD_BITS = 2048, 13, 17
PAIRS = 1 << PAIR_BITS
ROUNDS, RATE, BATCH = 1, 0.5, 1024
_END = np.uint64(0x1F83D9ABFB41BD6F)
_LOW = np.uint64(15)
_NO_ID = -(1 << 63)
_WIDE = 64
_SPLIT = (CLASSES + 1, TOP, (2 * HISTORY + PAIRS) * (CLASSES + 1), 1 << WORD_BITS)


def _endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0 to 14 by a word's last three bytes; 15 where it has no letter."""
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    seen = np.concatenate([[0], np.cumsum(letter)])
    last = np.zeros(len(starts), np.uint64)
    for k in range(1, 4):
        at = ends - k
        last = (last << np.uint64(8)) | np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.uint64)
    return np.where(seen[ends] > seen[starts], tn.mix(last + np.uint64(3)) % np.uint64(ENDINGS), np.uint64(ENDINGS))


def _tokens(c: tn.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and end marks of a chunk, and each document's first.
    The last four bits of a hash tell the word's ending."""
    w = tn.words_of(c)
    data = tn.ascii_lower(c.data)
    h = tn.word_hash(data, w.starts, w.ends, 0)
    h = (h & ~_LOW) | _endings(data, w.starts, w.ends)
    n = np.diff(w.doc_start) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.full(int(first[-1]), _END, np.uint64)
    at = np.ones(len(out), bool)
    at[first[1:] - 1] = False
    out[at] = h
    return out, first


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, c) over all tokens of the documents, end marks included."""
    return counted(docs, lambda c: _tokens(c)[0])


class Vocabulary(NamedTuple):
    """n: tokens; v: distinct; keys, counts: frequent ones, keys sorted; top:
    places of the modelled words in keys, most frequent first; endings: smoothed
    counts of all words by their ending."""

    n: int
    v: int
    keys: np.ndarray
    counts: np.ndarray
    top: np.ndarray
    endings: np.ndarray | None = None

    def rare(self) -> np.ndarray:
        """Smoothed counts of each class that is not one of frequent words."""
        whole = self.endings
        if whole is None:
            whole = np.full(ENDINGS + 1, (self.n + 0.5 * (self.v + 1)) / (ENDINGS + 1))
        own = (self.keys[self.top] & _LOW).astype(np.int64)
        return np.maximum(whole - np.bincount(own, self.counts[self.top] + 0.5, ENDINGS + 1), 1e-9)


def vocabulary(counts: DataFrame, limit: int = FREQUENT) -> Vocabulary:
    got = frequent(counts, limit)
    # What is never seen counts once, half, as part of every class.
    endings = np.full(ENDINGS + 1, 0.5 / (ENDINGS + 1))
    for r in counts.groupBy(F.col("h").bitwiseAND(F.lit(int(_LOW))).alias("e")).agg(F.sum(F.col("c") + 0.5).alias("n")).collect():
        endings[r["e"]] += r["n"]
    return Vocabulary(*got, np.lexsort((got.keys, -got.counts))[:TOP], endings)


class Model(NamedTuple):
    vocab: Vocabulary
    weights: np.ndarray  # class biases, word biases, class features, word features

    def parts(self):
        return np.split(self.weights, np.cumsum(_SPLIT)[:-1])


def start_model(vocab: Vocabulary) -> Model:
    """Weights at which the model is the smoothed unigram model."""
    top = np.full(TOP, 0.0)
    top[: len(vocab.top)] = vocab.counts[vocab.top] + 0.5
    mass = top.reshape(WORD_CLASSES, PER_CLASS).sum(1)
    floor = 1e-9
    word = np.log(np.maximum(top.reshape(WORD_CLASSES, PER_CLASS), floor) / np.maximum(mass, floor)[:, None])
    weights = np.zeros(sum(_SPLIT), np.float32)
    weights[: CLASSES + 1] = np.log(np.maximum(np.append(mass, vocab.rare()), floor))
    weights[CLASSES + 1 : CLASSES + 1 + TOP] = word.ravel()
    return Model(vocab, weights)


class _Events(NamedTuple):
    cls: np.ndarray
    word: np.ndarray  # within its class; 0 where a class has shares
    feats: np.ndarray  # three class-feature rows per token
    history: np.ndarray  # previous token's bucket
    skip: np.ndarray


def _events(h: np.ndarray, first: np.ndarray, ids: np.ndarray) -> _Events:
    """ids: rank among the modelled words, or -1."""
    bucket = np.where(ids >= 0, ids, TOP + (h % np.uint64(HISTORY - TOP)).astype(np.int64))
    prev = np.full((2, len(h)), HISTORY - 1, np.int64)
    prev[0, 1:] = bucket[:-1]
    prev[1, 2:] = bucket[:-2]
    start = first[:-1]
    prev[:, start] = HISTORY - 1
    prev[1, start[start + 1 < len(h)] + 1] = HISTORY - 1
    pair = ((prev[0] * HISTORY + prev[1]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
    feats = np.stack([prev[0], HISTORY + prev[1], 2 * HISTORY + pair.astype(np.int64)])
    rare = WORD_CLASSES + (h & _LOW).astype(np.int64)
    return _Events(np.where(ids >= 0, ids // PER_CLASS, rare), np.where(ids >= 0, ids % PER_CLASS, 0), feats, prev[0], prev[1])


def _softmax(z):
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _slots(history, skip, cls):
    """Hashed weight places of a class's words, after the previous token and
    after the one before it."""
    word = (cls[:, None] * PER_CLASS + np.arange(PER_CLASS)).astype(np.uint32) * np.uint32(0x85EBCA6B)
    at = [(word ^ ((x * 2 + k).astype(np.uint32) * np.uint32(0xC2B2AE35))[:, None]) * np.uint32(0x27D4EB2F) >> np.uint32(32 - WORD_BITS) for k, x in enumerate((history, skip))]
    return at


def _probabilities(parts, e: _Events, own: np.ndarray):
    bias, words, feats, hashed = parts
    feats = feats.reshape(-1, CLASSES + 1)
    f = e.feats[:, own]
    z = np.take(feats, f[0], axis=0)
    z += bias
    z += np.take(feats, f[1], axis=0)
    z += np.take(feats, f[2], axis=0)
    p = _softmax(z)
    seen = np.flatnonzero(e.cls[own] < WORD_CLASSES)
    cls = e.cls[own[seen]]
    at = _slots(e.history[own[seen]], e.skip[own[seen]], cls)
    z = np.take(words.reshape(WORD_CLASSES, PER_CLASS), cls, axis=0)
    z += np.take(hashed, at[0])
    z += np.take(hashed, at[1])
    q = _softmax(z)
    return p, seen, q, f, at


def _train_task(model: Model):
    vocab = model.vocab

    def run(batches):
        w = model.weights.copy()
        parts = np.split(w, np.cumsum(_SPLIT)[:-1])
        power = [np.full(len(x), 1e-2, np.float32) for x in parts]
        tokens = 0

        def step(i, grad):
            """Adaptive step on one parameter block."""
            power[i] += grad * grad
            grad *= RATE
            grad /= np.sqrt(power[i])
            parts[i] -= grad

        table, cum = parts[2].reshape(-1, CLASSES + 1), power[2].reshape(-1, CLASSES + 1)
        column, place = np.arange(CLASSES + 1), np.zeros(len(table), np.int64)

        for b in batches:
            for c in tn.chunks(b.column(0)):
                h, first = _tokens(c)
                e = _events(h, first, _ranks(h, vocab))
                tokens += len(h)
                for lo in range(0, len(h), BATCH):
                    own = np.arange(lo, min(lo + BATCH, len(h)))
                    p, seen, q, f, at = _probabilities(parts, e, own)
                    p[np.arange(len(own)), e.cls[own]] -= 1
                    q[np.arange(len(seen)), e.word[own[seen]]] -= 1
                    step(0, p.sum(0) / len(own))
                    word_at = (e.cls[own[seen]][:, None] * PER_CLASS + np.arange(PER_CLASS)).ravel()
                    step(1, np.bincount(word_at, q.ravel(), TOP).astype(np.float32) / len(own))
                    # Gradients of a feature row add up by counting, without a sort.
                    place[:] = 0
                    place[f.ravel()] = 1
                    rows = np.flatnonzero(place)
                    place[rows] = np.arange(len(rows)) * (CLASSES + 1)
                    at_row = (np.take(place, f)[:, :, None] + column).ravel()
                    g = np.bincount(at_row, np.broadcast_to(p, (3, *p.shape)).ravel(), len(rows) * (CLASSES + 1))
                    g = g.astype(np.float32).reshape(len(rows), -1)
                    g /= len(own)
                    grown = np.take(cum, rows, axis=0)
                    grown += g * g
                    cum[rows] = grown
                    g *= RATE
                    g /= np.sqrt(grown)
                    table[rows] -= g
                    if len(seen):
                        g = np.bincount(np.concatenate([at[0].ravel(), at[1].ravel()]), np.tile(q.ravel(), 2), 1 << WORD_BITS).astype(np.float32)
                        g /= len(own)
                        step(3, g)
        if tokens:
            moved = (w - model.weights) * tokens
            blocks = np.append(moved, np.zeros(-len(moved) % _WIDE, np.float32)).reshape(-1, _WIDE)
            some = np.flatnonzero(np.abs(blocks).max(1) > 0)
            cols = [pa.array(np.append(blocks[some, i], tokens if i == 0 else 0).astype(np.float64)) for i in range(_WIDE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), *cols], ["block", *[f"v{i}" for i in range(_WIDE)]])

    return run


def _ranks(h: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Rank among the modelled words, or -1."""
    rank = np.full(len(vocab.keys) + 1, -1)
    rank[vocab.top] = np.arange(len(vocab.top))
    return rank[_places(h, vocab.keys)]


def _places(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index in the sorted keys; len(keys) where absent."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    u, back = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
    return np.where(keys[at] == u, at, len(keys))[back]


def train(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    model = start_model(vocabulary(counts))
    names = [f"v{i}" for i in range(_WIDE)]
    for _ in range(rounds):
        moved = docs.select("text").mapInArrow(_shared(docs, model, _train_task), "block int, " + ", ".join(f"{n} double" for n in names))
        got = moved.groupBy("block").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        at = got.column("block").to_numpy()
        rows = np.column_stack([got.column(n).to_numpy() for n in names]) if len(at) else np.zeros((0, _WIDE))
        total = rows[at < 0, 0].sum()
        change = np.zeros((-(-len(model.weights) // _WIDE), _WIDE))
        change[at[at >= 0]] = rows[at >= 0] / max(total, 1)
        # Sums come in any order; rounding makes reruns agree.
        model = Model(model.vocab, (model.weights + np.round(change.ravel()[: len(model.weights)], 6)).astype(np.float32))
    return model


def _shared(df: DataFrame, model: Model, task):
    """Send the model (a bounded size) once per executor, not once per task."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return lambda batches: task(sent.value)(batches)


def _key(raw: bytes) -> int:
    x = xxhash.xxh64_intdigest(raw)
    return x - (1 << 64) if x >> 63 else x


def _keys(c: tn.Chunk) -> np.ndarray:
    raw, o = c.data.tobytes(), c.offsets
    return np.array([_key(raw[a:b]) for a, b in zip(o[:-1], o[1:])], np.int64)


def _score_task(model: Model):
    """Per document, what the frequent table and the weights settle."""
    vocab, parts = model.vocab, model.parts()
    share = np.append(np.zeros(WORD_CLASSES), np.log10(vocab.rare()))

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(5)]
            for c in tn.chunks(b.column(1)):
                h, first = _tokens(c)
                place = _places(h, vocab.keys)
                rank = np.full(len(vocab.keys) + 1, -1)
                rank[vocab.top] = np.arange(len(vocab.top))
                e = _events(h, first, rank[place])
                log_c = np.log10(np.append(vocab.counts, 0.5) + np.append(np.full(len(vocab.counts), 0.5), 0.5))[place]
                frequent = place < len(vocab.keys)
                model_log = np.empty(len(h))
                for lo in range(0, len(h), BATCH):
                    own = np.arange(lo, min(lo + BATCH, len(h)))
                    p, seen, q, _, _ = _probabilities(parts, e, own)
                    lp = np.log10(np.maximum(p[np.arange(len(own)), e.cls[own]], 1e-30)).astype(np.float64)
                    lp[seen] += np.log10(np.maximum(q[np.arange(len(seen)), e.word[own[seen]]], 1e-30))
                    model_log[own] = lp
                # A token without weights of its own has its count's share of its class.
                rare = np.where((e.cls >= WORD_CLASSES) & frequent, log_c, 0) - share[e.cls]
                sums = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  no document is without its end token
                cols[0].append(_keys(c))
                cols[1].append(np.diff(first))
                cols[2].append(sums(frequent.astype(np.int64)))
                cols[3].append(sums(np.where(frequent, log_c, 0)))
                cols[4].append(sums(model_log + rare))
            if cols[0]:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).fill_null(_NO_ID), *[pa.array(np.concatenate(c)) for c in cols]], ["did", "k", "n_tokens", "known", "base", "score"]
                )

    return run


def _rare_task(model: Model):
    """(h, did, k, tf) of the tokens that the frequent table lacks."""
    keys = model.vocab.keys

    def run(batches):
        for b in batches:
            ids = b.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for c in tn.chunks(b.column(1)):
                h, first = _tokens(c)
                absent = np.flatnonzero(_places(h, keys) == len(keys))
                if not len(absent):
                    continue
                doc = np.searchsorted(first, absent, "right") - 1
                order = np.lexsort((h[absent], doc))
                hs, ds = h[absent][order], doc[order]
                new = np.ones(len(hs), bool)
                new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
                at = np.flatnonzero(new)
                tf = np.diff(np.append(at, len(hs)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hs[at].view(np.int64)), pa.array(ids[c.first : c.last][ds[at]]), pa.array(_keys(c)[ds[at]]), pa.array(tf.astype(np.int32))], ["h", "did", "k", "tf"]
                )

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    vocab = model.vocab
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    near = rows.mapInArrow(_shared(docs, model, _score_task), "did long, k long, n_tokens long, known long, base double, score double")
    far = rows.mapInArrow(_shared(docs, model, _rare_task), "h long, did long, k long, tf int")
    c = F.coalesce("c", F.lit(0))
    far = far.join(counts, "h", "left").select("did", "k", "tf", (F.col("tf") * F.log10(c + 0.5)).alias("log_c"), F.when(c > 0, F.col("tf")).otherwise(0).alias("known"))
    far = far.groupBy("did", "k").agg(F.sum("log_c").alias("log_c"), F.sum("known").alias("known_far"))
    # One aggregation joins both; m rows that repeat (doc_id, text) share sums.
    nothing = lambda kind: F.lit(None).cast(kind)
    near = near.select("did", "k", "n_tokens", "known", "base", "score", F.lit(1).alias("m"), nothing("double").alias("log_c"), nothing("long").alias("known_far"))
    far = far.select("did", "k", *[nothing(t).alias(n) for n, t in near.dtypes[2:6]], F.lit(0).alias("m"), "log_c", "known_far")
    both = near.unionAll(far).groupBy("did", "k").agg(*[F.max(n).alias(n) for n in ("n_tokens", "known", "base", "score", "log_c", "known_far")], F.sum("m").cast("int").alias("m"))
    log_c = F.coalesce("log_c", F.lit(0.0)) / F.col("m")
    whole = vocab.n + 0.5 * (vocab.v + 1)
    doc_id = F.when(F.col("did") != _NO_ID, F.col("did"))
    both = both.withColumn("again", F.explode(F.sequence(F.lit(1), "m")))
    return both.select(
        doc_id.alias("doc_id"), (fold(doc_id, MOD) == HELD).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("known_far", F.lit(0)) / F.col("m")).cast("long").alias("n_known"),
        F.lit(int(vocab.n)).cast("long").alias("train_tokens"), (F.col("base") + log_c - F.col("n_tokens") * float(np.log10(whole))).alias("base_score"),
        (F.col("score") + log_c).alias("score"),
    )


def score_corpus(docs: DataFrame) -> DataFrame:
    """Train on the documents outside the held-out fold and score them all."""
    training = docs.where(fold(F.col("doc_id"), MOD) != HELD)
    with scratch() as tables:
        counts = tables.keep(written(token_counts(training)))
        model = train(training, counts)
    return score(docs, model, counts)
