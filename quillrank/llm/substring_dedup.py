"""Substring dedup by fixed-block anchors.

A repeated window of ``width`` words always holds one whole block of
``(width + 1) // 2`` words that is aligned in its other copy. So every
document's aligned blocks are the index, every rolling window of that length
is a probe, and a probe that meets a block at another place is a hit. Windows
of full width around hits are then compared by 96 hash bits of their words, from
two independent hashes of each word, beside the partition's, and runs of repeated
windows are the maximal exact repeats.

Both comparisons move packed (hash, position) lists, one per chunk of
documents and hash partition. A chunk first resolves what it can see itself
and sends one entry per such hash, so a passage that half the corpus holds
costs an entry per chunk. Texts move once, compressed.

Chunks are numbered by task and ordinal: the input must give the same rows to
the same task when it is recomputed, as files do; the second comparison reads
rows in the order of the join before it. The number of hash partitions follows
the input's bytes.

Cases: null text has no words; a document shorter than the width keeps all;
repeated rows count as other places; rows that repeat (doc_id, text) are all
reported; null ids are kept; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import textnum as tn
from quillrank.llm.store import shuffle_parts

WIDTH = 35
#: Bytes of input for each hash partition, and most partitions.
PART_BYTES, MOST_PARTS = 16 << 20, 1 << 17
_NO_ID = -(1 << 63)
_PACKED = "part int, chunk long, kind int, body binary"
_HITS = "did long, k long, hits binary"


def _entries(part, rest, flag, pos, n_parts, key_bytes, chunk, more=None):
    """Packed lists per hash partition, and the positions resolved here. more
    holds four further bytes of each key."""
    order = np.lexsort((rest, part) if more is None else (more, rest, part))
    p, r, f = part[order], rest[order], flag[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (r[1:] != r[:-1])
    if more is not None:
        new[1:] |= more[order][1:] != more[order][:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    aligned = np.add.reduceat(f.astype(np.int64), first)
    resolved = aligned[group] - f >= 1
    rank = np.cumsum(f) - np.repeat((np.cumsum(f) - f)[first], np.diff(np.append(first, len(p))))
    send = ~resolved | (f & (rank == 1))
    found = pos[order[resolved]]
    idx = np.sort(order[send])  # back to text order
    idx = idx[np.argsort(part[idx], kind="stable")]
    bounds = np.searchsorted(part[idx], np.arange(n_parts + 1))
    rows = []
    for q in range(n_parts):
        own = idx[bounds[q] : bounds[q + 1]]
        if len(own):
            gaps = (np.diff(pos[own], prepend=0) << 1) | flag[own]
            kind = np.uint16 if gaps.max() < 1 << 16 else np.uint32
            keys = rest[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :key_bytes]
            head = np.array([len(own), np.dtype(kind).itemsize], np.uint32).tobytes()
            tail = b"" if more is None else more[own].astype("<u4").tobytes()
            rows.append((q, chunk, 0, head + gaps.astype(kind).tobytes() + keys.tobytes() + tail))
    if len(found):
        rows.append((chunk % n_parts, chunk, 1, found.astype(np.uint32).tobytes()))
    return rows


def _batch(rows, schema_cols):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema_cols)], [n for n, _ in schema_cols])


_PACKED_COLS = [("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())]


def _about(chunk, did, keys, doc_start, n_parts):
    """The row that lets hits of a chunk find their documents again."""
    body = np.concatenate([np.array([len(did)], np.int64), did, keys, doc_start.astype(np.int64)])
    return (chunk % n_parts, chunk, 2, body.tobytes())


def _key(raw: bytes) -> int:
    x = xxhash.xxh64_intdigest(raw)
    return x - (1 << 64) if x >> 63 else x


def _text_keys(c: tn.Chunk) -> np.ndarray:
    raw, o = c.data.tobytes(), c.offsets
    return np.array([_key(raw[a:b]) for a, b in zip(o[:-1], o[1:])], np.int64)


def _number(count: int) -> int:
    return (TaskContext.get().partitionId() << 32) | count


def _probe(width: int, n_parts: int):
    block = (width + 1) // 2

    def run(batches):
        count = 0
        for b in batches:
            ids = b.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for c in tn.chunks(b.column(1)):
                w = tn.words_of(c)
                n = len(w.starts) - block + 1
                ok = np.flatnonzero(w.doc[:n] == w.doc[block - 1 :]) if n > 0 else np.empty(0, np.int64)
                if not len(ok):
                    continue
                words = tn.word_hash(c.data, w.starts, w.ends, 0)
                h = tn.window_hash(words, block, 1)[ok]
                flag = (ok - w.doc_start[w.doc[ok]]) % block == 0
                chunk = _number(count)
                count += 1
                p = np.uint64(n_parts)
                rest = (h // p) & np.uint64((1 << 40) - 1)
                rows = _entries((h % p).astype(np.int64), rest, flag, ok, n_parts, 5, chunk)
                rows.append(_about(chunk, ids[c.first : c.last], _text_keys(c), w.doc_start, n_parts))
                yield _batch(rows, _PACKED_COLS)

    return run


def _meet(key_bytes: int, more: bool):
    """All lists of one hash partition: entries that meet a block elsewhere."""

    def run(group: pa.Table) -> pa.Table:
        chunk, kind = group.column("chunk").to_numpy(), group.column("kind").to_numpy()
        body = group.column("body").to_pylist()
        rows = [(int(c), int(k), x) for c, k, x in zip(chunk, kind, body) if k]
        keys, tails, flags, pos, at, owner = [], [], [], [], [], []
        for i in np.flatnonzero(kind == 0):
            n, size = np.frombuffer(body[i], np.uint32, 2)
            n, size = int(n), int(size)
            gaps = np.frombuffer(body[i], f"<u{size}", n, 8).astype(np.int64)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :key_bytes] = np.frombuffer(body[i], np.uint8, n * key_bytes, 8 + n * size).reshape(n, key_bytes)
            keys.append(wide.view("<u8")[:, 0])
            if more:
                tails.append(np.frombuffer(body[i], "<u4", n, 8 + n * (size + key_bytes)))
            flags.append((gaps & 1).astype(bool))
            pos.append(np.cumsum(gaps >> 1).astype(np.uint32))
            at.append(np.full(n, len(owner), np.int32))
            owner.append(int(chunk[i]))
        if keys:
            keys, flags, pos, at = map(np.concatenate, (keys, flags, pos, at))
            tails = np.concatenate(tails) if more else None
            order = np.lexsort((tails, keys)) if more else np.argsort(keys, kind="stable")
            sk = keys[order]
            new = np.ones(len(sk), bool)
            new[1:] = sk[1:] != sk[:-1]
            if more:
                new[1:] |= tails[order][1:] != tails[order][:-1]
            first = np.flatnonzero(new)
            aligned = np.add.reduceat(flags[order].astype(np.int64), first)
            hit = np.zeros(len(keys), bool)
            hit[order] = np.repeat(aligned, np.diff(np.append(first, len(sk)))) - flags[order] >= 1
            at, pos = at[hit], pos[hit]
            ends = np.searchsorted(at, np.arange(len(owner) + 1))
            rows += [(owner[j], 1, pos[ends[j] : ends[j + 1]].tobytes()) for j in range(len(owner)) if ends[j] < ends[j + 1]]
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.table({"chunk": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int32()), "body": pa.array(cols[2], pa.binary())})

    return run


def _by_document(group: pa.Table) -> pa.Table:
    kind, body = group.column("kind").to_pylist(), group.column("body").to_pylist()
    found = [np.frombuffer(x, np.uint32) for k, x in zip(kind, body) if k == 1]
    out = {"did": [], "k": [], "hits": []}
    if found:
        about = np.frombuffer(next(x for k, x in zip(kind, body) if k == 2), np.int64)
        n = int(about[0])
        did, keys, start = about[1 : n + 1], about[n + 1 : 2 * n + 1], about[2 * n + 1 :]
        pos = np.unique(np.concatenate(found)).astype(np.int64)
        ends = np.searchsorted(pos, start)
        for j in np.flatnonzero(np.diff(ends)):
            out["did"].append(int(did[j]))
            out["k"].append(int(keys[j]))
            out["hits"].append((pos[ends[j] : ends[j + 1]] - start[j]).astype(np.uint32).tobytes())
    return pa.table({"did": pa.array(out["did"], pa.int64()), "k": pa.array(out["k"], pa.int64()), "hits": pa.array(out["hits"], pa.binary())})


def _exchange(packed: DataFrame, key_bytes: int, more: bool = False) -> DataFrame:
    met = packed.groupBy("part").applyInArrow(_meet(key_bytes, more), "chunk long, kind int, body binary")
    by_doc = met.groupBy("chunk").applyInArrow(_by_document, _HITS)
    # Repeated (doc_id, text) rows have the same positions.
    return by_doc.groupBy("did", "k").agg(F.max("hits").alias("hits"))


def _windows(width: int, n_parts: int):
    """Every full-width window around a hit, for the exact comparison."""
    block = (width + 1) // 2

    def run(batches):
        count = 0
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for some in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                text = pa.array([unpack.decompress(x).decode() for x in some.column("z").to_pylist()], pa.large_string())
                hits = some.column("hits").to_pylist()
                did, keys = (some.column(x).to_numpy(zero_copy_only=False) for x in ("did", "k"))
                for c in tn.chunks(text):
                    w = tn.words_of(c)
                    near = np.zeros(len(w.starts) + 1, np.int32)
                    at = np.concatenate([np.frombuffer(hits[c.first + j], np.uint32).astype(np.int64) + w.doc_start[j] for j in range(c.last - c.first)])
                    np.add.at(near, np.maximum(at - (width - block), 0), 1)
                    np.add.at(near, at + 1, -1)
                    n = len(w.starts) - width + 1
                    if n <= 0:
                        continue
                    ok = np.flatnonzero((np.cumsum(near)[:n] > 0) & (w.doc[:n] == w.doc[width - 1 :]))
                    if not len(ok):
                        continue
                    words = [tn.word_hash(c.data, w.starts, w.ends, s) for s in (0, 1)]
                    h = [tn.window_hash(words[s], width, s)[ok] for s in (0, 1)]
                    # The partition comes from the low bits of the first, so its high ones go along.
                    third = h[0] >> np.uint64(32)
                    chunk = _number(count)
                    count += 1
                    rows = _entries((h[0] % np.uint64(n_parts)).astype(np.int64), h[1], np.ones(len(ok), bool), ok, n_parts, 8, chunk, third)
                    rows.append(_about(chunk, did[c.first : c.last], keys[c.first : c.last], w.doc_start, n_parts))
                    yield _batch(rows, _PACKED_COLS)

    return run


def _pack(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in batches:
        text = ["" if x is None else x for x in b.column(1).to_pylist()]
        raw = [x.encode() for x in text]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).fill_null(_NO_ID), pa.array([_key(x) for x in raw], pa.int64()), pa.array([squeeze.compress(x) for x in raw], pa.binary())],
            ["did", "k", "z"],
        )


def _finish(width: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for some in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                n_words, n_removed, spans, kept = [], [], [], []
                for z, hits in zip(some.column("z").to_pylist(), some.column("hits").to_pylist()):
                    # split() on ASCII bytes parts at exactly the same six characters
                    words = unpack.decompress(z).split()
                    n_words.append(len(words))
                    if not hits:
                        n_removed.append(0)
                        spans.append([])
                    else:
                        gone = tn.runs_to_mask(len(words), np.frombuffer(hits, np.uint32).astype(np.int64), width)
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                        n_removed.append(int(gone.sum()))
                        words = [words[i] for i in np.flatnonzero(~gone)]
                    kept.append(b" ".join(words).decode())
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x if x != _NO_ID else None for x in some.column("did").to_pylist()], pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "spans", "kept_text"],
                )

    return run


def _parts(docs: DataFrame) -> int:
    """Hash partitions: enough that one takes what PART_BYTES of input give, by
    Spark's estimate of its size, so that a task's lists stay small however
    large the input is."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(4 * shuffle_parts(docs.sparkSession), min(size // PART_BYTES, MOST_PARTS))


def substring_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (word ranges removed), kept_text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_parts = _parts(docs)
    hits = _exchange(docs.mapInArrow(_probe(width, n_parts), _PACKED), 5)
    # Both joins ask for the same rows and columns, so the texts move once.
    packed = docs.mapInArrow(_pack, "did long, k long, z binary").where("did is not null and k is not null")
    near = packed.join(hits.hint("merge"), ["did", "k"]).select("did", "k", "z", "hits")
    repeats = _exchange(near.mapInArrow(_windows(width, n_parts), _PACKED), 8, True)
    whole = packed.join(repeats.hint("merge"), ["did", "k"], "left").select("did", "z", "hits")
    return whole.mapInArrow(
        _finish(width), "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"
    )
