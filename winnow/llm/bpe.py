"""Byte-level BPE: vocabulary, exact merging of many strings at once, the encoding transducer and the streaming decoder."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import pretok, vec
from winnow.llm.common import kept, texts

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_NONE = np.iinfo(np.int32).max
_WIDE = 48
#: What a worker remembers before it starts afresh; results are the same.
_STATES, _WORDS = 1 << 18, 1 << 20
#: The longest pre-token that the transducer runs, and how many it runs side by side.
_LONG, _ABREAST = 256, 1 << 15


def read_ranks(path: str = VOCAB) -> dict[bytes, int]:
    """Bytes to id of a rank file; ids are merge priorities too."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Merger:
    """Merges by rank, lowest first and leftmost of equals, of many byte strings at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, vals = [], []
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(r)
        self.pair = dict(zip(keys, vals))
        self.map = vec.Lookup(20)
        self.map.put(vec.mix64(np.array(keys, np.uint64)), np.array(vals, np.int32))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.map.get(vec.mix64(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)))
        return np.where(r < 0, _NONE, r)

    def one(self, s: bytes) -> list[int]:
        """The tokens of one string."""
        return self._merge(s)[0]

    def last_pair(self, s: bytes) -> tuple[int, int]:
        """The two tokens that the last merge of a string puts together."""
        return self._merge(s)[1]

    def _merge(self, s: bytes) -> tuple[list[int], tuple[int, int]]:
        """By a heap over a linked list: n log n for a string of n bytes."""
        pair = (-1, -1)
        ids, n = [int(self.byte[x]) for x in s], len(s)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.pair.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], pair = r, False, (a, b)
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t, ok in zip(ids, alive) if ok], pair

    def counts(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of tokens of each byte range of b."""
        size = end - start
        out = size.astype(np.int64)
        for i in np.flatnonzero(size > _WIDE):
            out[i] = len(self.one(b[start[i] : end[i]].tobytes()))
        lo = 1
        while lo < _WIDE:
            hi = lo * 2 if lo < 16 else _WIDE
            pick = np.flatnonzero((size > lo) & (size <= hi))
            for k in range(0, len(pick), 1 << 16):
                i = pick[k : k + (1 << 16)]
                out[i] = self._merged(b, start[i], size[i], hi)
            lo = hi
        return out

    def _merged(self, b: np.ndarray, start: np.ndarray, size: np.ndarray, wide: int) -> np.ndarray:
        col = np.arange(wide)
        there = col < size[:, None]
        ids = np.where(there, self.byte[b[np.where(there, start[:, None] + col, 0)]], -1)
        rank = np.full((len(ids), wide), _NONE, np.int32)
        two = there[:, 1:]
        rank[:, :-1][two] = self.rank(ids[:, :-1][two], ids[:, 1:][two])
        left = size.astype(np.int64)
        rows = np.arange(len(ids))
        while len(rows):
            at = rank.argmin(1)
            go = rank[np.arange(len(rows)), at] < _NONE
            if not go.all():
                rows, ids, rank, at = rows[go], ids[go], rank[go], at[go]
            if not len(rows):
                break
            me = np.arange(len(rows))
            new = rank[me, at]
            src = np.minimum(col + (col > at[:, None]), wide - 1)
            ids, rank = np.take_along_axis(ids, src, 1), np.take_along_axis(rank, src, 1)
            ids[:, -1], rank[:, -1] = -1, _NONE
            ids[me, at] = new
            left[rows] -= 1
            n = left[rows]
            for shift in (0, -1):
                p = at + shift
                ok = (p >= 0) & (p + 1 < n)
                q = np.flatnonzero(ok)
                rank[q, p[q]] = self.rank(ids[q, p[q]], ids[q, p[q] + 1])
                q = np.flatnonzero((p >= 0) & ~ok)
                rank[q, p[q]] = _NONE
        return left


def provable(merger: Merger) -> list[bytes]:
    """The vocabulary strings that merging turns into one token: proved for each by merging it."""
    words = list(merger.ranks)
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    n = merger.counts(np.frombuffer(b"".join(words), np.uint8), end - size, end)
    return [w for w, k in zip(words, n.tolist()) if k == 1]


class Compiled:
    """What is worked out from a vocabulary once, on the driver, and broadcast: the proof, the trie, and how tokens come apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merger = Merger(ranks)
        self.whole = provable(self.merger)
        child: list[dict[int, int]] = [{}]
        ends = [-1]
        top = max(ranks.values()) + 1
        self.left, self.right, self.age = np.zeros(top, np.int32), np.zeros(top, np.int32), np.full(top, -1, np.int32)
        for w in self.whole:
            node, t = 0, ranks[w]
            for x in w:
                nxt = child[node].get(x)
                if nxt is None:
                    nxt = child[node][x] = len(child)
                    child.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = t
            if len(w) > 1:
                self.left[t], self.right[t], self.age[t] = *self.merger.last_pair(w), t
        self.ends, self.open = np.array(ends, np.int32), np.array([bool(c) for c in child])
        self.child = vec.Lookup(18)
        self.child.put(vec.mix64(np.array([n << 8 | x for n, c in enumerate(child) for x in c], np.uint64)), np.array([y for c in child for y in c.values()], np.int32))

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the strings of tokens a and b, put together, merge back to a and b; a is -1 where nothing stands before b.

        Merges are undone at the seam, the latest first, by ranks: a pair across the seam that would have merged before the
        merge undone last refutes it. Of equal ranks the left one merges first.
        """
        ok = np.ones(len(a), bool)
        i = np.flatnonzero(a >= 0)
        x, y, limit = a[i], b[i], np.full(len(i), _NONE, np.int64)
        while len(i):
            bad = self.merger.rank(x, y) < limit
            ok[i[bad]] = False
            p, q = self.age[x], self.age[y]
            go = ~bad & ((p >= 0) | (q >= 0))
            i, x, y, p, q = i[go], x[go], y[go], p[go], q[go]
            late = p > q
            limit = np.where(late, p, q + 1)
            x, y = np.where(late, self.right[x], x), np.where(late, y, self.left[y])
        return ok


class _Rows:
    """An array that grows at its end."""

    def __init__(self, kind: type, *width: int):
        self.n, self.x = 0, np.empty((1024, *width), kind)

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.x):
            self.x = np.concatenate([self.x, np.empty((max(len(self.x), len(rows)), *self.x.shape[1:]), self.x.dtype)])
        self.x[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


class Transducer:
    """The merges as a deterministic finite-state transducer whose states are made when they are first met.

    The encoding of a prefix ends in exactly one token, and a sequence of tokens is an encoding if each neighbouring pair is
    (its two strings, put together, merge back to these two). So after each byte it is enough to know, for each place where
    a token that is not over yet may have begun, how far in the vocabulary's trie it has come and which tokens led up to
    that place. These places, with the tokens not emitted yet, are the state; tokens that all places agree on are emitted,
    and the last of these is kept only while a place stands right behind it. A place dies when no vocabulary string goes on
    that way, so lookahead is bounded by the longest token and its overlaps.

    Many strings are run side by side, a byte of each at a time, and the transitions that they lack are made together. A
    state is known by a 64-bit hash of its places: with 2^18 states two share one with probability 2e-9.
    """

    def __init__(self, compiled: Compiled):
        self.c = compiled
        self.reset()

    def reset(self) -> None:
        self.wide = 4
        self.node, self.tail, self.size = _Rows(np.int32), _Rows(np.int32, self.wide), _Rows(np.int32)  # places
        self.first, self.many = _Rows(np.int64), _Rows(np.int32)  # states: where their places begin, and how many
        self.end_at, self.end_n = _Rows(np.int64), _Rows(np.int32)  # what a state emits at the end of the string
        self.to, self.at, self.n = _Rows(np.int32), _Rows(np.int64), _Rows(np.int32)  # transitions: next state, emission
        self.flat = _Rows(np.int32)
        self.known, self.step = vec.Lookup(16), vec.Lookup(16)
        begin = np.full((1, self.wide), -2, np.int32)
        begin[0, 0] = -1
        self._states(np.zeros(1, np.int32), begin, np.ones(1, np.int32), np.zeros(1, np.int64), np.ones(1, np.int32))

    def _emit(self, tokens: np.ndarray, n: np.ndarray, at: _Rows, many: _Rows) -> None:
        at.add(self.flat.n + np.cumsum(n) - n)
        many.add(n)
        self.flat.add(tokens)

    def _states(self, node: np.ndarray, tail: np.ndarray, size: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The states of these lists of places, new or not."""
        h = vec.mix64(node.astype(np.uint64) << np.uint64(8) | size.astype(np.uint64))
        for k in range(self.wide):
            h = np.where(k < size, vec.mix64(h + tail[:, k].astype(np.uint64)), h)
        h = vec.mix64(h + (np.arange(len(node)) - np.repeat(start, n)).astype(np.uint64))
        key = vec.mix64(np.add.reduceat(h, start))
        key = np.where(key == 0, np.uint64(1), key)
        got = self.known.get(key)
        if (got < 0).any():
            miss = np.flatnonzero(got < 0)
            new, which = np.unique(key[miss], return_index=True)
            which = miss[which]
            self.known.put(new, np.arange(self.first.n, self.first.n + len(new), dtype=np.int32))
            many = n[which]
            rows = vec.expand(start[which], many)
            self.first.add(self.node.n + np.cumsum(many) - many)
            self.many.add(many)
            last = start[which] + many - 1
            cols = np.arange(1, self.wide)
            self._emit(tail[last, 1:][cols < size[last, None]], size[last] - 1, self.end_at, self.end_n)
            for own, x in ((self.node, node), (self.tail, tail), (self.size, size)):
                own.add(x[rows])
            got = self.known.get(key)
        return got

    def _widen(self) -> None:
        old = self.tail
        self.tail = _Rows(np.int32, 2 * self.wide)
        self.tail.add(np.pad(old.x[: old.n], ((0, 0), (0, self.wide)), constant_values=-2))
        self.wide *= 2

    def _make(self, state: np.ndarray, byte: np.ndarray) -> None:
        """The transitions of distinct (state, byte)."""
        m, c = len(state), self.c
        n = self.many.x[state]
        at, own = vec.expand(self.first.x[state], n), np.repeat(np.arange(m), n)
        nxt = c.child.get(vec.mix64(self.node.x[at].astype(np.uint64) << np.uint64(8) | byte[own].astype(np.uint64)))
        on = nxt >= 0
        at, own, nxt = at[on], own[on], nxt[on]
        if self.size.x[at].max(initial=0) >= self.wide:
            self._widen()
        tail, size, token = self.tail.x[at], self.size.x[at], c.ends[nxt]
        may = np.flatnonzero(token >= 0)
        hit = may[c.fits(tail[may, size[may] - 1], token[may])]
        has, one = np.unique(own[hit], return_index=True)
        if len(has) != m:
            raise ValueError("the vocabulary's merges are not closed: a prefix has no last token")
        hit, goes = hit[one], c.open[nxt]
        found = tail[hit]
        found[np.arange(m), size[hit]] = token[hit]
        order = np.argsort(np.concatenate([own[goes], np.arange(m)]), kind="stable")  # the place after the found token comes last
        own = np.concatenate([own[goes], np.arange(m)])[order]
        node = np.concatenate([nxt[goes], np.zeros(m, np.int32)])[order]
        tail, size = np.concatenate([tail[goes], found])[order], np.concatenate([size[goes], size[hit] + 1])[order]
        start = np.searchsorted(own, np.arange(m))
        least = np.minimum.reduceat(size, start)
        agree = np.minimum.reduceat(tail, start, axis=0) == np.maximum.reduceat(tail, start, axis=0)
        out = np.minimum(np.cumprod(agree[:, 1:], axis=1).sum(1), least - 1).astype(np.int32)
        cols = np.arange(self.wide)
        emitted = tail[start, 1:][cols[1:] <= out[:, None]]
        shift = out[own]
        tail = np.take_along_axis(tail, np.minimum(cols + shift[:, None], self.wide - 1), 1)
        size = size - shift
        tail[cols >= size[:, None]] = -2
        tail[(least - out > 1)[own], 0] = -1
        n = np.diff(np.append(start, len(own))).astype(np.int32)
        self.step.put(vec.mix64(state.astype(np.uint64) << np.uint64(8) | byte.astype(np.uint64)), np.arange(self.to.n, self.to.n + m, dtype=np.int32))
        self._emit(emitted, out, self.at, self.n)
        self.to.add(self._states(node, tail, size, start, n))

    def moves(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The transitions that these states take on these bytes."""
        key = vec.mix64(state.astype(np.uint64) << np.uint64(8) | byte.astype(np.uint64))
        got = self.step.get(key)
        if (got < 0).any():
            miss = np.flatnonzero(got < 0)
            _, one = np.unique(key[miss], return_index=True)
            self._make(state[miss[one]], byte[miss[one]])
            got[miss] = self.step.get(key[miss])
        return got

    def encode(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all byte ranges of b in turn, how many each has)."""
        if self.first.n > _STATES:
            self.reset()
        size = end - start
        order = np.argsort(-size, kind="stable")
        at, falling = start[order], -size[order]
        state = np.zeros(len(at), np.int32)
        where, n, own = [], [], []
        for d in range(int(size.max(initial=0))):
            live = int(np.searchsorted(falling, -d))
            go = self.moves(state[:live], b[at[:live] + d])
            state[:live] = self.to.x[go]
            emits = np.flatnonzero(self.n.x[go])
            where.append(self.at.x[go[emits]])
            n.append(self.n.x[go[emits]])
            own.append(order[emits])
        where, n, own = (np.concatenate([*x, y]) for x, y in ((where, self.end_at.x[state]), (n, self.end_n.x[state]), (own, order)))
        o = np.argsort(own, kind="stable")
        return self.flat.x[vec.expand(where[o], n[o])], np.bincount(own, n, len(size)).astype(np.int64)

    def stream(self, s: bytes) -> Iterator[list[int]]:
        """After each byte, and at the end, the tokens that are certain by then and were not before."""
        state = np.zeros(1, np.int32)
        for x in s:
            go = self.moves(state, np.array([x], np.uint8))[0]
            state[0] = self.to.x[go]
            yield self.flat.x[self.at.x[go] : self.at.x[go] + self.n.x[go]].tolist()
        yield self.flat.x[self.end_at.x[state[0]] : self.end_at.x[state[0]] + self.end_n.x[state[0]]].tolist()


class Encoder:
    """Token ids of whole Arrow chunks; the transducer runs once for each distinct pre-token that a worker meets. Pre-tokens of
    more than _LONG bytes, too few to be run side by side, are merged by the heap."""

    def __init__(self, compiled: Compiled):
        self.machine = Transducer(compiled)
        self.decoder = Decoder(compiled)
        self._reset()

    def _reset(self) -> None:
        self.map, self.flat, self.off, self.size = vec.Lookup(18), _Rows(np.int32), _Rows(np.int64), _Rows(np.int32)

    def _learn(self, b: np.ndarray, key: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        order = np.argsort(e - s, kind="stable")
        key, s, e = key[order], s[order], e[order]
        self.map.put(key, np.arange(self.off.n, self.off.n + len(key), dtype=np.int32))
        short = int(np.searchsorted(e - s, _LONG, "right"))
        for k in range(0, short, _ABREAST):
            at = slice(k, min(short, k + _ABREAST))
            new, n = self.machine.encode(b, s[at], e[at])
            self._add(new, n)
        for i, j in zip(s[short:].tolist(), e[short:].tolist()):
            new = np.array(self.machine.c.merger.one(b[i:j].tobytes()), np.int32)
            self._add(new, np.array([len(new)]))

    def _add(self, new: np.ndarray, n: np.ndarray) -> None:
        self.off.add(self.flat.n + np.cumsum(n) - n)
        self.size.add(n)
        self.flat.add(new)

    def chunk(self, b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, how many each row has)."""
        s, e, n = pretok.tokens(b, offs)
        h = vec.Hasher(b)(s, e)
        k = self.map.get(h)
        if (k < 0).any():
            miss = np.flatnonzero(k < 0)
            key, first = np.unique(np.where(h[miss] == 0, np.uint64(1), h[miss]), return_index=True)
            if self.off.n and self.off.n + len(key) > _WORDS:  # start afresh, with all that this chunk needs
                self._reset()
                miss = np.arange(len(h))
                key, first = np.unique(np.where(h == 0, np.uint64(1), h), return_index=True)
            self._learn(b, key, s[miss[first]], e[miss[first]])
            k = self.map.get(h)
        size = self.size.x[k].astype(np.int64)
        each = np.append(0, np.cumsum(size))
        ends = np.append(0, np.cumsum(n))
        return self.flat.x[vec.expand(self.off.x[k], size)], np.diff(each[ends])


def _utf8_table() -> np.ndarray:
    """next state of (state, byte): 0 between characters, 9 refused, others wait for continuation bytes."""
    t = np.full((10, 256), 9, np.uint8)
    t[0, :0x80] = 0
    t[0, 0xC2:0xE0] = 1
    t[0, 0xE0], t[0, 0xE1:0xED], t[0, 0xED], t[0, 0xEE:0xF0] = 4, 2, 5, 2
    t[0, 0xF0], t[0, 0xF1:0xF4], t[0, 0xF4] = 6, 3, 7
    t[1, 0x80:0xC0], t[2, 0x80:0xC0], t[3, 0x80:0xC0] = 0, 1, 2
    t[4, 0xA0:0xC0], t[5, 0x80:0xA0] = 1, 1
    t[6, 0x90:0xC0], t[7, 0x80:0x90] = 2, 2
    return t


_UTF8 = _utf8_table().tolist()


class Utf8Machine:
    """Incremental UTF-8: feed() bytes in pieces of any length, get back the text that is complete.

    Only the bytes of a character that a piece leaves open go through the table one by one; complete stretches are converted
    whole. Bytes that are not UTF-8 become U+FFFD, maximal parts at a time, as a whole-text decoding with "replace" gives.
    """

    def __init__(self) -> None:
        self.open = b""

    def feed(self, piece: bytes, last: bool = False) -> str:
        data = self.open + piece
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                state = 0
                for x in data[-back:]:
                    state = _UTF8[state][x]
                if state not in (0, 9):
                    cut -= back
                break
        self.open = b"" if last else data[cut:]
        return (data if last else data[:cut]).decode("utf-8", "replace")


class Decoder:
    def __init__(self, compiled: Compiled):
        ranks = compiled.merger.ranks
        top = max(ranks.values()) + 1
        self.name = [b""] * top
        for t, r in ranks.items():
            self.name[r] = t
        self.size = np.fromiter(map(len, self.name), np.int64, top)
        self.off = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.name), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        ids = ids[(ids >= 0) & (ids < len(self.size))]
        return self.flat[vec.expand(self.off[ids], self.size[ids])]

    def stream(self, pieces: Iterable[np.ndarray]) -> Iterator[str]:
        """Text as pieces of tokens come in, never half a character."""
        machine = Utf8Machine()
        for ids in pieces:
            yield machine.feed(self.bytes_of(np.asarray(ids)).tobytes())
        yield machine.feed(b"", True)

    def text(self, ids: np.ndarray, piece: int = 4096) -> str:
        return "".join(self.stream(ids[k : k + piece] for k in range(0, len(ids), piece)))


def _once(kind: type, compiled: Broadcast, key: str):
    """One object per worker process and vocabulary."""
    return kept((kind, key), lambda: kind(compiled.value))


def _shared(docs: DataFrame, vocab: str) -> tuple[Broadcast, str]:
    """The compiled vocabulary, broadcast, and what tells it from others. Its size is the vocabulary's, whatever the corpus."""
    with open(vocab, "rb") as f:
        key = hashlib.md5(f.read()).hexdigest()
    if key not in _COMPILED:
        _COMPILED[key] = Compiled(read_ranks(vocab))
    return docs.sparkSession.sparkContext.broadcast(_COMPILED[key]), key


_COMPILED: dict[str, Compiled] = {}


class Counter:
    """Token counts: 1 at once for pre-tokens proved to be whole tokens, merging for each further distinct one."""

    def __init__(self, compiled: Compiled):
        self.merger, self.whole = compiled.merger, compiled.whole
        self._reset()

    def _reset(self) -> None:
        size = np.array([len(w) for w in self.whole])
        end = np.cumsum(size)
        key = vec.Hasher(np.frombuffer(b"".join(self.whole), np.uint8))(end - size, end)
        self.map = vec.Lookup(18)
        self.map.put(key, np.zeros(len(key), np.int32))  # 0: whole, one token

    def chunk(self, b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, pre-tokens, whole-token pre-tokens) of each row."""
        s, e, n = pretok.tokens(b, offs)
        h = vec.Hasher(b)(s, e)
        k = self.map.get(h)
        if (k < 0).any():
            if self.map.n > _WORDS:
                self._reset()
                k = self.map.get(h)
            miss = np.flatnonzero(k < 0)
            key, first, back = np.unique(np.where(h[miss] == 0, np.uint64(1), h[miss]), return_index=True, return_inverse=True)
            got = self.merger.counts(b, s[miss[first]], e[miss[first]]).astype(np.int32)
            self.map.put(key, got)
            k[miss] = got[back]
        ends = np.append(0, np.cumsum(n))
        sums = np.append(0, np.cumsum(np.where(k == 0, 1, k)))
        whole = np.append(0, np.cumsum(k == 0))
        return np.diff(sums[ends]), n, np.diff(whole[ends])


def token_counts(docs: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_whole) of each document.

    A null or empty text has no tokens. Repeated rows are counted one by one; rows without doc_id are left out.
    """
    compiled, key = _shared(docs, vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _once(Counter, compiled, key)
        for batch in batches:
            for i, b, offs in vec.chunks(batch.column(1)):
                got = counter.chunk(b, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(offs) - 1), *(pa.array(x) for x in got)], names=["doc_id", "n_tokens", "n_pretokens", "n_whole"])

    return texts(docs).mapInArrow(count, "doc_id bigint, n_tokens bigint, n_pretokens bigint, n_whole bigint")


def encode(docs: DataFrame, vocab: str = VOCAB, check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of each document; round_trip: the streaming decoder gives the text back (null
    if check is off).

    A null text has null tokens, an empty one none. Repeated rows are encoded one by one; rows without doc_id are left out.
    """
    compiled, key = _shared(docs, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once(Encoder, compiled, key)
        for batch in batches:
            for i, b, offs in vec.chunks(batch.column(1)):
                ids, n = encoder.chunk(b, offs)
                at = np.append(0, np.cumsum(n)).astype(np.int32)
                null = batch.column(1).slice(i, len(n)).is_null()
                tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(ids), mask=null) if null.true_count else pa.ListArray.from_arrays(pa.array(at), pa.array(ids))
                same = pa.nulls(len(n), pa.bool_())
                if check:
                    o, data, t = offs.tolist(), b.tobytes(), at.tolist()
                    same = pa.array([encoder.decoder.text(ids[t[k] : t[k + 1]]) == data[o[k] : o[k + 1]].decode() for k in range(len(n))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(n)), pa.array(n), tokens, same], names=["doc_id", "n_tokens", "tokens", "round_trip"])

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, tokens array<int>, round_trip boolean")


def decode(encoded: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens): ids that the vocabulary lacks are skipped, null tokens give a null text."""
    compiled, key = _shared(encoded, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _once(Decoder, compiled, key)
        for batch in batches:
            out = [None if x.as_py() is None else decoder.text(np.asarray(x.values.fill_null(-1))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")).filter(F.col("doc_id").isNotNull())
    return rows.mapInArrow(run, "doc_id bigint, text string")
