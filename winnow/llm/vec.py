"""Vectorised work on the bytes of an Arrow text column.

Texts are taken straight from Arrow's buffers as one uint8 array with row offsets, in chunks of whole rows; words, lines
and pre-tokens are found by comparing neighbouring byte classes and hashed from one prefix sum of the chunk, so that no
Python object is made per word. A row longer than a chunk is a chunk of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21
SPACE, WORD, SYMBOL = 0, 1, 2
_P = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 with good avalanche."""
    x = np.array(x, np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64, the same in every process and version."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(_P))


_T = seeded(256, 1), seeded(256, 2)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i to n; kept and grown by doubling, but not beyond what one chunk needs."""
    if len(_POW[0]) <= n:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            t = np.ones(1, np.uint64)
            step = base
            while len(t) <= n:
                t = np.concatenate([t, t * np.uint64(step)])
                step = step * step & _M64
            _POW[k] = t
    return _POW[0], _POW[1]


class Hasher:
    """64-bit hashes of any segments of a byte array, from one prefix sum."""

    def __init__(self, b: np.ndarray, table: int = 0):
        pw, self.inv = _powers(len(b))
        x = _T[table][b]
        x *= pw[: len(b)]
        self.s = np.empty(len(b) + 1, np.uint64)
        self.s[0] = 0
        np.cumsum(x, out=self.s[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.s[end] - self.s[start]) * self.inv[start])


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and its n + 1 row offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offs, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), o


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) for runs of whole rows of about limit bytes."""
    data, o = buffers(col)
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + limit, "right")) - 1)
        yield i, data[o[i] : o[j]], o[i : j + 1] - o[i]
        i = j


def _classes() -> np.ndarray:
    t = np.full(256, SYMBOL, np.uint8)
    t[[9, 10, 11, 12, 13, 32]] = SPACE
    t[128:] = WORD
    for a, z in ((48, 57), (65, 90), (97, 122), (95, 95)):
        t[a : z + 1] = WORD
    return t


BYTE_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(b: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8."""
    out = _LOWER[b]
    if len(b) > 1:
        wide = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        out[1:][wide] += 32
    return out


def counts_of(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of the sorted starts lie in each row; an empty row has none."""
    return np.diff(np.searchsorted(starts, offs))


def counts_of_rows(row: np.ndarray, n: int) -> np.ndarray:
    """How often each of n rows occurs in row."""
    return np.bincount(row, minlength=n)


def owners(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The row of each of the sorted starts."""
    return np.repeat(np.arange(len(offs) - 1), counts_of(starts, offs))


def runs(b: np.ndarray, offs: np.ndarray, table: np.ndarray = BYTE_CLASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, class) of each run of bytes of one class, white space left out; no run crosses a row."""
    if not len(b):
        z = np.empty(0, np.int64)
        return z, z, z.astype(np.uint8)
    c = table[b]
    edge = np.empty(len(b) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(c[1:], c[:-1], out=edge[1:-1])
    edge[offs] = True
    at = np.flatnonzero(edge)
    kind = c[at[:-1]]
    keep = kind != SPACE
    return at[:-1][keep], at[1:][keep], kind[keep]


def words(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word: letters, digits, underscores and all bytes beyond ASCII."""
    s, e, k = runs(b, offs)
    w = k == WORD
    return s[w], e[w]


def lines(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each line, split at the line feed alone as split(text, '\\n') does: an empty text has one empty line."""
    nl = np.flatnonzero(b == 10)
    row = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, nl, "right") - 1])
    start = np.concatenate([offs[:-1], nl + 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.empty_like(start)
    if len(start):
        end[:-1] = start[1:] - 1
        last = np.append(row[1:] != row[:-1], True)
        end[last] = offs[1:][row[last]]
    return start, end, row


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] of them, for each i in turn."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(count) - count
    return np.arange(total) + np.repeat(start - first, count)


class Lookup:
    """A growing open-addressing map from uint64 keys to int32 values, looked up by whole arrays. Key 0 is taken as 1."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._new(bits)

    def _new(self, bits: int) -> None:
        self.bits, self.mask = bits, np.int64((1 << bits) - 1)
        self.key, self.val = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return (k >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        k = np.where(keys == 0, np.uint64(1), keys)
        slot = self._slot(k)
        found = self.key[slot]
        out = np.where(found == k, self.val[slot], -1)
        left = np.flatnonzero((found != k) & (found != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            found = self.key[slot]
            hit = found == k[left]
            out[left[hit]] = self.val[slot[hit]]
            go = ~hit & (found != 0)
            left, slot = left[go], slot[go]
        return out

    def put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        if (self.n + len(keys)) * 2 > len(self.key):
            old, val = self.key[self.key != 0], self.val[self.key != 0]
            self._new(max(self.bits + 1, int((self.n + len(keys)) * 2.5).bit_length()))
            self.n = 0
            self._put(old, val)
        self._put(np.where(keys == 0, np.uint64(1), keys), np.asarray(vals, np.int32))

    def _put(self, k: np.ndarray, v: np.ndarray) -> None:
        self.n += len(k)
        slot = self._slot(k)
        while len(k):
            free = self.key[slot] == 0
            f = np.flatnonzero(free)
            self.key[slot[f]] = k[f]  # of several that want one slot, the last written wins
            won = self.key[slot] == k
            self.val[slot[won]] = v[won]
            k, v, slot = k[~won], v[~won], (slot[~won] + 1) & self.mask


def text_array(b: np.ndarray, offs: np.ndarray) -> pa.Array:
    """An Arrow text column of the byte ranges between offsets."""
    return pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(b))])
