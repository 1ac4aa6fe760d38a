"""Toxicity: averaged subword embeddings into a linear softmax.

Words (ASCII letters folded to lower case, as are Latin-1 capitals) give their
3-5 byte n-grams with a border mark on either side, and themselves. Each
feature has an embedding row by hash; a document is the average over its
distinct words of their features' rows, scaled by the square root of their
number, and a softmax layer on top is trained with them jointly (Adam with weight decay, numpy; its
large damping term leaves rare features small steps, so that a few shared stems
are learned before many chance ones). A misspelt word shares most n-grams with the word meant.

Embedding and layer are linear, so for scoring they fold into one number per
row: a document's score is the logistic of a scaled mean of table look-ups, done on
whole chunks of bytes at once. Training uses a bounded sample; scoring covers
every text to its end.

Cases: null and empty texts, and texts without letters, get the score of the
bias alone; no labels of one class give a constant score; repeated rows score
alike; null ids are kept; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm import textnum as tn
from quillrank.llm.labelled import fold, sample

BUCKET_BITS = 16
DIM = 8
GRAMS = (3, 4, 5)
#: So many words of no weight are added to each average, which steadies short texts.
PRIOR_WORDS = 20
#: The average is multiplied by (words + PRIOR_WORDS) ** STRETCH: at 1/2 chance
#: scores spread alike at every length, so long texts are not drowned.
STRETCH = 0.5
#: Shares are multiplied by this in training, to suit the step size.
UNIT = 6
#: In training a text of so many distinct words counts half, longer ones less: what
#: is toxic in a long text is a small part of it, and the rest would be learned along.
STEADY = 3000
THRESHOLD = 0.3
#: Added to the logit: a missed toxic text costs more than a false alarm. The
#: largest step of 0.25 that keeps false alarms in the folds of the training
#: rows below 1.85 %.
LEAN = 0.5
MOD, HELD = 4, 2

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_ANY_CASE = _WORD.copy()
_ANY_CASE[65:91] = True
_BORDER = np.uint32(0x5BD1E995)
_STEP = tn.mix(np.arange(7, dtype=np.uint64) + np.uint64(11)).astype(np.uint32) | np.uint32(1)


class _Bag(NamedTuple):
    """A chunk's distinct (document, word) pairs over bordered bytes."""

    grams: list  # per n-gram size, the bucket at every byte
    whole: np.ndarray  # the words' own buckets
    keys: np.ndarray  # the words' hashes
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    n_docs: int


def _bag(c: tn.Chunk) -> _Bag:
    data = tn.ascii_lower(c.data)
    if len(data) > 1:  # capitals of the two-byte Latin-1 block
        data[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)).astype(np.uint8) << 5
    n_docs = len(c.offsets) - 1
    # One more border byte between documents, and at both ends.
    doc_of = np.repeat(np.arange(n_docs), np.diff(c.offsets))
    place = np.arange(len(data)) + doc_of + 1
    inside = np.zeros(len(data) + n_docs + max(GRAMS), bool)
    inside[place] = _WORD[data]
    values = np.full(len(inside), _BORDER, np.uint32)
    values[place] = np.where(_WORD[data], tn.byte_table(0).astype(np.uint32)[data], _BORDER)
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(c.offsets + np.arange(n_docs + 1) + 1, starts, "right") - 1
    own = tn.span_hash(values.astype(np.uint64), starts, ends, 1)
    _, first = np.unique(own ^ tn.mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    first.sort()
    h, grams = np.zeros(len(values), np.uint32), []
    for k in range(max(GRAMS)):
        h[: len(h) - k] += values[k:] * _STEP[k]
        if k + 1 in GRAMS:
            grams.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS))
    return _Bag(grams, (own[first] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), own[first], starts[first], ends[first], doc[first], n_docs)


def _counts(bag: _Bag) -> list[np.ndarray]:
    """n-grams of each word, borders included, for each size."""
    return [np.maximum(bag.ends - bag.starts + 3 - n, 0) for n in GRAMS]


def _stretches(c: tn.Chunk):
    """The chunk, or, of a document that is far longer than a chunk should be,
    pieces of it, cut where no word is."""
    at, size = 0, len(c.data)
    while size - at > 2 * tn.CHUNK_BYTES:
        cut = at + tn.CHUNK_BYTES
        while cut < size and not len(gap := np.flatnonzero(~_ANY_CASE[c.data[cut : cut + 65536]])):
            cut += 65536
        if cut >= size:
            break
        cut += int(gap[0])
        yield tn.Chunk(c.first, c.last, c.data[at:cut], np.array([0, cut - at]))
        at = cut
    yield c if at == 0 else tn.Chunk(c.first, c.last, c.data[at:], np.array([0, size - at]))


def _word_means(bag: _Bag, table: np.ndarray) -> np.ndarray:
    """The mean table entry of each word's features."""
    total = table[bag.whole].astype(np.float64)
    count = np.ones(len(total))
    for n, buckets, own in zip(GRAMS, bag.grams, _counts(bag)):
        run = np.concatenate([[0.0], np.cumsum(table[buckets], dtype=np.float64)])
        total += np.where(own > 0, run[bag.starts - 1 + own] - run[bag.starts - 1], 0)
        count += own
    return total / count


def document_logits(text: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """Bias plus the mean over a document's distinct words of their features'
    mean table entry."""
    out = []
    for c in tn.chunks(text):
        bags = [(b.doc, b.keys, _word_means(b, table), b.n_docs) for b in map(_bag, _stretches(c))]
        doc, means, n_docs = bags[0][0], bags[0][2], bags[0][3]
        if len(bags) > 1:  # one long document: words that stand in several pieces count once
            _, once = np.unique(np.concatenate([b[1] for b in bags]), return_index=True)
            means, doc = np.concatenate([b[2] for b in bags])[once], np.zeros(len(once), np.int64)
        words = np.bincount(doc, minlength=n_docs)
        out.append(bias + np.bincount(doc, means, n_docs) * (words + PRIOR_WORDS) ** (STRETCH - 1))
    return np.concatenate(out) if out else np.empty(0)


def _bags(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document's buckets and their shares in its average."""
    bags = []
    for c in tn.chunks(text, 1 << 17):  # small chunks, for small work arrays
        keys, shares, seen = [], [], np.empty(0, np.uint64)
        words = np.zeros(len(c.offsets) - 1)
        for bag in map(_bag, _stretches(c)):
            own, new = _counts(bag), ~np.isin(bag.keys, seen)
            share = new / (1 + sum(own))
            words += np.bincount(bag.doc[new], minlength=bag.n_docs)
            found, part = [bag.doc << BUCKET_BITS | bag.whole], [share]
            for buckets, n in zip(bag.grams, own):
                at = np.repeat(bag.starts - 1 - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                found.append(np.repeat(bag.doc, n) << BUCKET_BITS | buckets[at].astype(np.int64))
                part.append(np.repeat(share, n))
            key, back = np.unique(np.concatenate(found), return_inverse=True)
            keys.append(key)
            shares.append(np.bincount(back, np.concatenate(part), len(key)))
            if len(c.data) > 2 * tn.CHUNK_BYTES:
                seen = np.union1d(seen, bag.keys)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        scale = UNIT * (words + PRIOR_WORDS) ** (STRETCH - 1)
        weight = (np.bincount(back, np.concatenate(shares), len(key)) * scale[key >> BUCKET_BITS]).astype(np.float16)
        bounds = np.searchsorted(key, np.arange(len(words) + 1) << BUCKET_BITS)
        bags += [((key[i:j] & ((1 << BUCKET_BITS) - 1)).astype(np.uint16), weight[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
    return bags


def _learned(text: pa.Array) -> dict:
    """The bags as a column: at most 2 ** BUCKET_BITS entries a text, the steps
    between buckets and then the shares, compressed."""
    squeeze = zstandard.ZstdCompressor(level=3)
    pack = lambda b, w: squeeze.compress(np.diff(b, prepend=np.uint16(0)).tobytes() + w.tobytes())
    return {"bag": pa.array([pack(b, w) for b, w in _bags(text)], pa.binary())}


class _Packed:
    """Bags that are unpacked when they are read."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        raw = zstandard.ZstdDecompressor().decompress(self.packed[i])
        half = len(raw) // 2
        return np.cumsum(np.frombuffer(raw[:half], np.uint16), dtype=np.uint16), np.frombuffer(raw[half:], np.float16)


def train(text: pa.Array, y: list[int], **settings) -> tuple[np.ndarray, float]:
    """The folded table and bias: logit of label 1 against label 0."""
    return train_bags(_bags(text), y, **settings)


def train_bags(bags, y: list[int], batch: int = 64, rate: float = 0.02, decay: float = 0.05, damping: float = 1e-2, steady: float = STEADY, seed: int = 7) -> tuple[np.ndarray, float]:
    """train(), from the texts' bags."""
    size, rng = 1 << BUCKET_BITS, np.random.default_rng(seed)
    y = np.asarray(y, np.int64)
    if len(set(y.tolist())) < 2:
        rest = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return np.zeros(size, np.float32), rest
    # The shares of a text add up to UNIT times the root of its words.
    words = np.array([(bags[i][1].sum(dtype=np.float64) / UNIT) ** 2 for i in range(len(bags))])
    weight = (1 / (1 + words / steady)).astype(np.float32)
    weight /= weight.mean()
    emb = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (emb, out, bias)]
    t, rounds = 0, min(30, max(12, 100_000 // len(y)))  # small samples go round more often
    steps = rounds * -(-len(y) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            x = np.zeros((len(own), size), np.float32)
            for i, j in enumerate(own):
                at, share = bags[j]
                x[i, at] = share
            vec = x @ emb
            z = vec @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p *= weight[own][:, None] / len(own)
            grads = (x.T @ (p @ out.T), vec.T @ p, p.sum(0))
            pace = rate * min(1.0, 3 * (1 - t / steps))  # the last third down to nothing, so that no batch decides
            t += 1
            for (w, m, v), g in zip(state, grads):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                w *= 1 - pace * decay
                w -= pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + damping)
    side = out[:, 1] - out[:, 0]
    return ((emb @ side) * UNIT).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, mod: int = MOD, held: int = HELD, rows: tuple[int, int] = (8000, 2000)) -> tuple[np.ndarray, float]:
    """Train on at most ``rows`` labelled documents of label 0 and 1."""
    got, order, y, shift = sample(docs, labels, "toxic", mod, held, rows, _learned, "bag binary")
    packed = got.column("bag").to_pylist()
    table, bias = train_bags(_Packed([packed[i] for i in order]), y)
    del got, packed
    tn.release()
    lean = LEAN if len(set(y)) == 2 else 0.0
    return table, bias + shift + lean  # the classes' shares are those of all labels


def score_column(model: tuple[np.ndarray, float], text: Column) -> Column:
    """The score of a text, from 0 to 1. A scalar UDF: only the texts leave
    the JVM, whatever other columns a row has."""
    table, bias = model

    def logistic(text: pa.Array) -> pa.Array:
        out = pa.array(1 / (1 + np.exp(-np.clip(document_logits(text, table, bias), -500, 500))))
        tn.release()
        return out

    return F.arrow_udf(logistic, "double")(text)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    got = docs.select("doc_id", score_column(model, F.col("text")).alias("score"))
    return got.select("doc_id", (fold(F.col("doc_id"), MOD) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
