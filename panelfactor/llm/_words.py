"""Vectorised words and shingles of an Arrow string column.

Words are hashed to 64 bits straight from the column's UTF-8 buffer, so a
batch costs a few array passes and no Python object per word.  A null text
counts as an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: words are runs of anything but space and \t \n \v \f \r
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: words are runs of 0-9, a-z (after lower-casing) and all non-ASCII characters
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: base of the rolling polynomial over words
BASE = 0x9FB21C651E98DF25
_MASK = (1 << 64) - 1
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [_MASK], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of a batch: hash and byte range of each, and each document's first word."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n_docs + 1
    data: np.ndarray  # the bytes that start and end refer to (lower-cased if asked)
    doc_bytes: np.ndarray  # n_docs + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    base = int(off[0]) if len(off) else 0
    stop = int(off[-1]) if len(off) else 0
    return data[base:stop], off - base if len(off) else np.zeros(1, np.int64)


def words(texts: pa.Array, keep: np.ndarray = SPACED, lower: bool = False) -> Words:
    data, off = buffers(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    in_word = keep[data]
    begins = in_word.copy()
    begins[1:] &= ~in_word[:-1]
    inner = off[(off > 0) & (off < n)]
    begins[inner] = in_word[inner]
    start = np.flatnonzero(begins)
    stops = np.zeros(n + 1, dtype=bool)
    stops[1:n] = in_word[:-1] & ~in_word[1:]
    stops[inner] = in_word[inner - 1]
    if n:
        stops[n] = in_word[-1]
    end = np.flatnonzero(stops)
    first = np.searchsorted(start, off)
    return Words(_hash(data, start, end - start), start, end, first, data, off)


def _hash(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = eights[start] & _TAIL[np.minimum(length, 8)]
    h = mix(h + length.astype(np.uint64) * _M3)
    rest, k = np.flatnonzero(length > 8), 8
    while len(rest):
        more = eights[start[rest] + k] & _TAIL[np.minimum(length[rest] - k, 8)]
        h[rest] = mix(h[rest] * _M3 + more)
        k += 8
        rest = rest[length[rest] > k]
    return h


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every `size` consecutive values of h (also across documents)."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out: np.ndarray | None = None
    have, power, block, at = 0, 1, h, size
    while at:  # binary decomposition: block holds the hash of `power` values
        if at & 1:
            if out is None:
                out, have = block.copy(), power
            else:
                n = len(h) - have - power + 1
                out = block[:n] * np.uint64(pow(BASE, have, 1 << 64)) + out[power : power + n]
                have += power
        at >>= 1
        if at:
            n = len(block) - power
            block = block[:n] * np.uint64(pow(BASE, power, 1 << 64)) + block[power : power + n]
            power *= 2
    return out


def starts_inside(first: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of `size` words that lie inside one document, and their documents."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    return np.arange(len(doc)) - before[doc] + first[doc], doc


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Parts of a batch of at most `limit` bytes of text (or one row), so that work arrays stay small."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at = 0
    while at < n:
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
