"""CRC-32 of many byte ranges at once.

The register is linear: R(s, xy) = shift(R(s, x), |y|) ^ R(0, y), where shift
is what zero bytes do to it.  So the checksum of joined ranges follows from
those of the ranges, and all words of a column advance together.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

FULL = np.uint32(0xFFFFFFFF)
_POLYNOMIAL = 0xEDB88320  # fixed value: of the checksum in gzip and PNG
#: ranges longer than this are summed one by one
LONG = 64


@functools.cache
def _bytes() -> np.ndarray:
    """What one byte does to an empty register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return t


@functools.cache
def _zeros(log2: int) -> np.ndarray:
    """Four tables, one for each byte of the register, of what 2**log2 zero bytes do to it."""
    if log2:
        half = _zeros(log2 - 1)
        return _apply(half, half.reshape(-1)).reshape(4, 256)
    t = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    return _bytes()[t & np.uint32(255)] ^ (t >> np.uint32(8))


def _apply(tables: np.ndarray, s: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return tables[0][s & low] ^ tables[1][(s >> np.uint32(8)) & low] ^ tables[2][(s >> np.uint32(16)) & low] ^ tables[3][s >> np.uint32(24)]


@functools.cache
def _short() -> np.ndarray:
    """The tables of 0 .. LONG zero bytes."""
    out = np.empty((LONG + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(LONG):
        out[n + 1] = _apply(_zeros(0), out[n].reshape(-1)).reshape(4, 256)
    return out


def shift(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers s after n zero bytes each."""
    s, n = np.broadcast_arrays(np.atleast_1d(np.asarray(s, np.uint32)), np.asarray(n, np.int64))
    flat, at, low = _short().reshape(-1), np.minimum(n, LONG) * 1024, np.uint32(255)
    out = flat[at + (s & low)] ^ flat[at + 256 + ((s >> np.uint32(8)) & low)] ^ flat[at + 512 + ((s >> np.uint32(16)) & low)] ^ flat[at + 768 + (s >> np.uint32(24))]
    rest = np.flatnonzero(n > LONG)
    if len(rest):
        left = n[rest] - LONG
        for bit in range(int(left.max()).bit_length()):
            on = rest[(left >> bit) & 1 == 1]
            out[on] = _apply(_zeros(bit), out[on])
    return out


def registers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """R(0, range) of the byte ranges of data."""
    out, size, table = np.zeros(len(start), np.uint32), end - start, _bytes()
    at = np.flatnonzero((size > 0) & (size <= LONG))
    k = 0
    while len(at):
        s = out[at]
        out[at] = table[(s ^ data[start[at] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
        k += 1
        at = at[size[at] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        n = int(size[i])
        out[i] = np.uint32(zlib.crc32(data[start[i] : end[i]])) ^ FULL ^ shift(FULL, n)[0]
    return out


def joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """R(0, xy) from R(0, x), R(0, y) and |y|."""
    return shift(left, size) ^ right


def checksum(register: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of ranges of `size` bytes from their registers."""
    return register ^ shift(FULL, size) ^ FULL


def combined(left: int, right: int, size: int) -> int:
    """The CRC-32 of xy from those of x and y, and |y|."""
    return int(shift(np.uint32(left), size)[0]) ^ right
