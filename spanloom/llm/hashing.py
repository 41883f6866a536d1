"""Words and their 64-bit hashes, found for many texts at once in the bytes of an Arrow column.

A block of about 256 KB of texts is one byte array.  With a random 64-bit number per byte value and an odd
base p, the prefix sums of ``number[byte] * p**position`` give the hash of any stretch of bytes by one
subtraction and a multiplication with ``p**-start``: no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Odd multipliers, one for each place of a window.
PLACE = mix(np.arange(1, 17, dtype=U)) | U(1)
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1000, 1256, dtype=U))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]

#: Bytes that are part of words: all but the six ASCII white-space characters; or letters only.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_powers = {"up": np.ones(1, dtype=U), "down": np.ones(1, dtype=U)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        n = max(n, 2 * BLOCK)
        step = U(_BASE if which == "up" else pow(_BASE, -1, 1 << 64))
        have = np.full(n, step, dtype=U)
        have[0] = 1
        have = _powers[which] = np.cumprod(have, dtype=U)
    return have


class Block:
    """Some texts as one byte array; text i is bytes off[i] to off[i+1]."""

    def __init__(self, first: int, off: np.ndarray, buf: np.ndarray):
        self.first, self.off, self.buf, self.n = first, off, buf, len(off) - 1

    def prefix(self, lower: bool) -> np.ndarray:
        sums = np.zeros(len(self.buf) + 1, dtype=U)
        np.cumsum((_LOWER if lower else _BYTE)[self.buf] * _power("up", len(self.buf))[: len(self.buf)], out=sums[1:])
        return sums

    @staticmethod
    def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes start to end."""
        down = _power("down", len(sums))
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * PLACE[15])

    def bounds(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of True in `inside`; a run ends where its text ends."""
        if not len(inside):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        cut = self.off[:-1][self.off[:-1] < len(inside)]
        before[cut] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[cut[cut > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self, lower: bool = True, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word in order, and where each text's words begin (one more entry than texts)."""
        start, end = self.bounds(kind[self.buf])
        return self.stretch(self.prefix(lower), start, end), np.searchsorted(start, self.off)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Block]:
    """The texts of a column, null as empty, in blocks of `limit` bytes (or one longer text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    off = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield Block(at, off[at : to + 1] - off[at], data[off[at] : off[to]])
        at = to


def windows(words: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `size` consecutive words, and where each text's windows begin.

    A text of fewer words (but not none) has one window: all its words.
    """
    count = np.diff(begin)
    short = np.flatnonzero((count > 0) & (count < size))
    per = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(at[-1], dtype=U)
    n = max(0, len(words) - size + 1)
    if n:
        every = words[:n] * PLACE[0]
        for k in range(1, size):
            every = every + words[k : n + k] * PLACE[k]
        owner = np.repeat(np.arange(len(count)), count)
        keep = owner[:n] == owner[size - 1 : n + size - 1]
        full = np.ones(len(out), dtype=bool)
        full[at[short]] = False
        out[full] = mix(every[keep] + U(size) * PLACE[14])
    for i in short:
        part = words[begin[i] : begin[i + 1]]
        out[at[i]] = mix((part * PLACE[: len(part)]).sum(dtype=U, keepdims=True) + U(len(part)) * PLACE[14])[0]
    return out, at
