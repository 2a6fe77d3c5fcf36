"""Pre-tokens of byte-level BPE, found on whole Arrow buffers.

Splits as the usual pattern does:  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Every byte gets the class of its character (white space, letter, number, other); runs of one class are the pre-tokens
but for three corrections, made on the array of run starts: the last of several white-space characters before a word
stands apart, a plain space goes with what follows it, and a lone apostrophe takes the letters of a contraction.
"""

from __future__ import annotations

import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER, _UNKNOWN = 0, 1, 2, 3, 255
_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def _class(cp: int) -> int:
    if cp in _WHITE:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(cp))[0], OTHER)


_ASCII = np.array([_class(c) for c in range(128)] + [OTHER] * 128, np.uint8)
_TABLE = np.full(0x110000, _UNKNOWN, np.uint8)  # filled as characters turn up


def byte_classes(b: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of valid UTF-8 belongs to."""
    c = _ASCII[b]
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        v = b[lead].astype(np.int64)
        size = 2 + (v >= 0xE0) + (v >= 0xF0)
        cp = v & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            cp[more] = cp[more] << 6 | b[lead[more] + k] & 0x3F
        kind = _TABLE[cp]
        if (kind == _UNKNOWN).any():
            new = np.unique(cp[kind == _UNKNOWN])
            _TABLE[new] = [_class(x) for x in new.tolist()]
            kind = _TABLE[cp]
        c[lead] = kind
        for k in range(1, 4):
            more = size > k
            c[lead[more] + k] = kind[more]
    return c


_ONE, _TWO = (np.frombuffer(x, np.uint8) for x in (b"stmd", b"revell"))


def starts(b: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted starts of the pre-tokens, which tile each row's bytes."""
    n = len(b)
    if not n:
        return np.empty(0, np.int64)
    c = byte_classes(b)
    mark = np.empty(n, bool)
    mark[0] = True
    np.not_equal(c[1:], c[:-1], out=mark[1:])
    row = np.zeros(n + 1, bool)
    row[offs] = True
    mark |= row[:-1]
    run = np.flatnonzero(mark)
    # white space before something else in the same row: z is where that starts, last the last white-space character
    sp = np.flatnonzero(c[run[:-1]] == SPACE) if len(run) > 1 else np.empty(0, np.int64)
    z = run[sp + 1] if len(sp) else sp
    z = z[~row[z]]
    last = z - 1
    for _ in range(2):
        last = last - ((b[last] & 0xC0) == 0x80)
    plain = b[last] == 32
    mark[z[plain]] = False
    mark[last] = True
    # contractions
    a = run[b[run] == 39]
    a = a[mark[a] & (a + 1 < n)]
    a = a[(c[a + 1] == LETTER) & ~row[a + 1]]
    if len(a):
        one, two = b[a + 1], b[np.minimum(a + 2, n - 1)]
        inside = (a + 2 < n) & ~row[np.minimum(a + 2, n)]
        short = np.isin(one, _ONE)
        long = ~short & inside & ((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108))
        for which, size in ((short, 2), (long, 3)):
            at = a[which]
            mark[at + 1] = False
            end = at + size
            mark[end[end < n]] = True
    return np.flatnonzero(mark)


def tokens(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number in each row) of the pre-tokens."""
    s = starts(b, offs)
    return s, np.append(s[1:], len(b))[: len(s)], np.diff(np.searchsorted(s, offs))
