"""Numpy kernels over Arrow text: word spans and rolling hashes.

Text is cut into chunks of whole documents of about a megabyte, so that the
64-bit work arrays stay small whatever the batch size is. A longer document is a
chunk of its own; its bytes are hashed in stretches, and what is kept of it whole
is a few bytes for each of its own and some numbers for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0xA24BAED4963EE407)
#: Bytes from which a word is hashed by itself.
LONG = 256
#: Masks of the first bytes of eight.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64's avalanche)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(None)
def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[seed % 2]) + np.uint64(seed))


_POWERS: dict = {}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        base = _BASES[seed % 2] | 1
        up, down = (np.empty(size, np.uint64) for _ in range(2))
        for arr, b in ((up, base), (down, pow(base, -1, 1 << 64))):
            arr[0], done = 1, 1
            while done < size:
                step = min(done, size - done)
                arr[done : done + step] = arr[:step] * np.uint64(pow(b, done, 1 << 64))
                done += step
        have = _POWERS[seed] = (up, down)
    return have[0][:n], have[1][:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Position-independent hash of values[start:end] for every span: a polynomial,
    for buckets of short spans only, as arrangements of equal parts can cancel out."""
    up, down = powers(seed, len(values) + 1)
    pre = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=pre[1:])
    h = (pre[ends] - pre[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _LENGTH)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of the bytes of every word, eight bytes a step with a full
    avalanche between steps, so that no arrangement of equal parts cancels out;
    words of LONG bytes and more by XXH64. Words are taken in stretches of about
    CHUNK_BYTES, so a very long document needs no wide array of its own size; a
    hash does not depend on where the stretch begins."""
    out, i, first = np.empty(len(starts), np.uint64), 0, np.uint64(_BASES[seed % 2])
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        size = ends[i:j] - starts[i:j]
        h = mix(size.astype(np.uint64) * _LENGTH + first)
        live = np.flatnonzero(size < LONG)
        raw = np.zeros(hi - lo + 8, np.uint8)
        raw[: hi - lo] = data[lo:hi]
        eight = np.ndarray((hi - lo + 1,), "<u8", raw, strides=(1,))  # the eight bytes at every place
        at = starts[i:j] - lo
        for done in range(0, LONG, 8):
            live = live[size[live] > done]
            if not len(live):
                break
            more = np.minimum(size[live] - done, 8)
            h[live] = mix(h[live] ^ (eight[at[live] + done] & _KEEP[more]))
        for k in np.flatnonzero(size >= LONG):
            h[k] = xxhash.xxh64_intdigest(raw[at[k] : at[k] + size[k]].tobytes(), int(h[k]))
        out[i:j] = h
        i = j
    return out


def window_hash(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of values[i : i + width] for every i. Hashes of twice the width come
    from two of the width, mixed at each step."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    odd = np.uint64(_BASES[(seed + 1) % 2] | 1)
    level, size, out, done = mix(values ^ np.uint64(_BASES[seed % 2])), 1, None, 0
    while True:
        if width & size:
            own = level[done : done + n]
            out = own if out is None else mix(out * odd + own)
            done += size
        if done == width:
            return out
        level, size = mix(level[:-size] * odd + level[size:]), 2 * size


def release() -> None:
    """Give freed memory back to the system: workers stay when their task ends,
    and what allocators keep for them counts against the executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def trimmed(run):
    """A function over batches that releases memory at its end."""

    def own(batches):
        yield from run(batches)
        release()

    return own


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None


class Chunk(NamedTuple):
    """Whole documents: rows [first, last) of the batch, their bytes, and the
    byte offset of each document within the chunk (one more than documents)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(text: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole documents; null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_string())
    n = len(text)
    if n == 0:
        return
    bufs = text.buffers()
    offs = np.frombuffer(bufs[1], np.int64, n + 1 + text.offset)[text.offset :]
    raw = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield Chunk(first, last, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last


def ascii_lower(data: np.ndarray) -> np.ndarray:
    up = (data >= 65) & (data <= 90)
    return data + (up.astype(np.uint8) << 5)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words(NamedTuple):
    starts: np.ndarray  # byte offsets in the chunk
    ends: np.ndarray
    doc: np.ndarray  # document of each word, within the chunk
    doc_start: np.ndarray  # index of each document's first word, one more at the end


def words_of(chunk: Chunk) -> Words:
    """Runs of bytes other than U+0020 and U+0009-U+000D, per document."""
    data, offs = chunk.data, chunk.offsets
    n_docs = len(offs) - 1
    if len(data) == 0:
        e = np.empty(0, np.int64)
        return Words(e, e, e, np.zeros(n_docs + 1, np.int64))
    solid = ~_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offs] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | border[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | border[1:])) + 1
    doc_start = np.searchsorted(starts, offs, "left")
    doc = np.repeat(np.arange(n_docs), np.diff(doc_start))
    return Words(starts, ends, doc, doc_start)


def runs_to_mask(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Positions within any [start, start + width)."""
    edge = np.zeros(n + width + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n] > 0
