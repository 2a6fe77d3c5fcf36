"""SimHash near-dedup through segment popcounts.

A document's fingerprint has BITS bits, each the sign of a sum over its distinct words (lower case), weighted by 1 + ln of
their count. Every PART-bit part is cut into 2-bit segments and mapped to the vector of their popcounts, a point in a grid of unit
cells; the Manhattan distance of two such vectors never exceeds the Hamming distance of the parts.

The join by Hamming distance is lossless: it gives every pair that differs in at most MAX_BITS bits. The bits are dealt to parts, and
each part has a radius, such that a pair within MAX_BITS is within the radius of at least one. A part of radius t has 2^(t+1) - 1 masks:
each of its bits has a vector of t + 1 bits, and mask v holds the bits whose vector has odd parity with v. The vectors of t differing
bits span less than the whole space, so a nonzero v is even with all of them: under its mask the two agree (covering LSH). Each mask
sorts the fingerprints by what it lets through and compares those that agree, whatever the size of such a group. Where fewer pairs
than that work are to be had, or the masks let too many meet, every pair is compared instead; which way is taken changes no result.

Up to 2 * BLOCK fingerprints are one block, more are split into blocks of about BLOCK by hash; each pair of blocks is a task, or
several that share its masks out.

Copies with equal fingerprints are joined as one representative, so thousands of copies cost one point. Groups are connected
components of the pairs. To find these, a task passes over pairs that its own links connect already: near copies meet under
most masks, but are compared only until they are connected. Every pair that could connect two groups is compared.

Defined results: a null, empty or wordless text matches nothing. Rows that share a doc_id are one document: with any of
their texts it can match, and they stay or go together. The least doc_id of a group stays. Rows without doc_id are left
out of the report, which cannot name them; to keep_one() each is a document of its own, which stays only where its group
has no doc_id, and then one of them. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import vec
from winnow.llm.common import cut, forget, groups, texts

BITS, PART, MAX_BITS = 384, 24, 64
#: Bits of the vectors of a part's masks, at most; those of longer masks, where more than LONG fingerprints would meet too often; fingerprints to a block; tasks at least.
VECTOR, WIDE, LONG, BLOCK, SLICES = 10, 11, 1 << 19, 7 << 17, 12
#: A sorted fingerprint costs as much as SORTED compared pairs, a candidate as much as MET; one mask in SAMPLED is tried to foresee candidates.
SORTED, MET, SAMPLED = 6, 10, 256
#: Masks of a part whose neighbours are linked before any others meet.
_CHAINED = 2
_N = BITS // 64
_F = [f"f{k}" for k in range(_N)]
_SEEDS = vec.seeded(_N, 5)
_BLOCK, _BATCH = 1 << 14, 1 << 17
#: Words compared before the others.
_FIRST = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_DEALT = np.argsort(vec.seeded(BITS, 21), kind="stable")
_PLACES = (4 ** np.arange(PART // 2)).astype(np.float32)


def fingerprints(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x _N uint64 fingerprints, which rows have a word) of a chunk."""
    low = vec.lower(b)
    s, e = vec.words(low, offs)
    row = vec.owners(s, offs)
    h = vec.Hasher(low)(s, e)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)])
    n = np.diff(np.append(new, len(h)))
    h, row = h[new], row[new]
    w = np.rint(16 * (1 + np.log(n))).astype(np.float32)  # whole numbers, so sums are exact in any order
    rows = len(offs) - 1
    edge = np.searchsorted(row, np.arange(rows + 1))
    sums = np.zeros((rows, BITS), np.float32)
    at = 0
    while at < len(h):
        end = min(len(h), at + _BLOCK)
        bits = vec.mix64(h[at:end, None] ^ _SEEDS).astype(">u8").view(np.uint8).reshape(end - at, _N * 8)
        signs = np.unpackbits(bits, axis=1).astype(np.float32)
        for r in range(row[at], row[end - 1] + 1):
            i, j = max(edge[r], at) - at, min(edge[r + 1], end) - at
            sums[r] += w[at + i : at + j] @ signs[i:j]
        at = end
    total = np.zeros(rows, np.float32)
    np.add.at(total, row, w)
    f = np.packbits(2 * sums > total[:, None], axis=1).view(">u8").astype(np.uint64)
    return f, edge[1:] > edge[:-1]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for i, b, offs in vec.chunks(batch.column(1)):
            f, has = fingerprints(b, offs)
            ids = batch.column(0).slice(i, len(has))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(f[:, k].view(np.int64) if f.flags.f_contiguous else np.ascontiguousarray(f[:, k]).view(np.int64)) for k in range(_N))], names=["doc_id", *_F]).filter(pa.array(has))


def _bits(f: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(f.astype(">u8")).view(np.uint8).reshape(len(f), -1), axis=1)


def cells(f: np.ndarray) -> np.ndarray:
    """rows x parts: the grid cell of each part, its 2-bit popcounts side by side."""
    bits = _bits(f)
    segments = (bits[:, ::2] + bits[:, 1::2]).reshape(len(f), BITS // PART, PART // 2)
    return (segments.astype(np.float32) @ _PLACES).astype(np.uint64)  # below 2^24, so exact


def _word(bits: np.ndarray) -> np.ndarray:
    """Rows of at most 64 bits as one uint64 each."""
    wide = np.zeros((len(bits), 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(">u8").astype(np.uint64).ravel()


@lru_cache
def masks(max_bits: int = MAX_BITS, vector: int = VECTOR) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places of its bits, masks over them) of each part. The vectors are chosen so that no mask has few bits, as few
    let many meet: each is replaced in turn by one that lowers the sum of 0.62^bits, the share of unlike texts that meet."""
    parts = -(-(max_bits + 1) // vector)
    sizes = np.diff(np.arange(parts + 1) * (max_bits + 1) // parts)  # radius + 1; that they add up to max_bits + 1 makes the join lossless
    edges = np.append(0, np.cumsum(sizes)) * BITS // (max_bits + 1)
    share, out = 0.62 ** np.arange(66), []
    for k, size in enumerate(sizes.tolist()):
        own = _DEALT[edges[k] : min(edges[k + 1], edges[k] + 64)]  # more bits than a word holds are not needed
        v, draws = np.arange(1, 1 << size), vec.seeded(1600 + len(own), 40 + k) % np.uint64((1 << size) - 1) + np.uint64(1)
        inside = np.stack([np.bitwise_count(v & c) & 1 for c in draws[: len(own)].astype(np.int64)], 1)
        n = inside.sum(1, dtype=np.int64)
        for i, c in enumerate(draws[len(own) :].astype(np.int64)):
            column = np.bitwise_count(v & c) & 1
            other = n - inside[:, i % len(own)] + column
            if share[other].sum() < share[n].sum():
                n, inside[:, i % len(own)] = other, column
        out.append((own, _word(inside)))
    return out


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row of each row's component, after links between x and y; label: before."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((least := label[label]) != label).any():
            label = least


def _permute(f: np.ndarray, order: np.ndarray) -> None:
    """In place and by columns, as two workers of an executor hold up to 2 * BLOCK rows each."""
    for k in range(f.shape[1]):
        f[:, k] = f[order, k]


class _Linked:
    """Rows in the order of their components, which grow by links. f is kept in that order; at: the rows' own places."""

    def __init__(self, f: np.ndarray, split: int, max_bits: int):
        self.f, self.n, self.split, self.max_bits = f, len(f), split, max_bits
        self.at, self.label, self.own, self.word, self.new, self.waiting = *(np.arange(self.n) for _ in range(3)), None, [], 0
        self.order = np.uint64(max(1, self.n).bit_length())

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        """Compare places x and y and keep those near for join()."""
        if self.split:
            across = (self.at[x] < self.split) != (self.at[y] < self.split)
            x, y = x[across], y[across]
        d = self.f.take(x, 0)
        d ^= self.f.take(y, 0)
        c = np.bitwise_count(d).view(np.uint16)
        c = c[:, 0] + c[:, 1] + c[:, 2]  # two sums of three words, of at most 192 each
        near = np.flatnonzero((c & np.uint16(255)) + (c >> np.uint16(8)) <= self.max_bits)
        if len(near):
            self.new.append((self.at[x[near]], self.at[y[near]]))
            self.waiting += len(near)

    def join(self) -> None:
        if not self.new:
            return
        self.label = _joined(self.label, *map(np.concatenate, zip(*self.new)))
        self.new, self.waiting = [], 0
        order = np.argsort(self.label[self.at], kind="stable")
        self.at = self.at[order]
        if self.word is not None:
            self.word = self.word[order]
        self.own = self.label[self.at]
        _permute(self.f, order)

    def take(self, places: np.ndarray) -> None:
        self.word = _words([self.f[:, k] for k in range(_N)], places)

    def neighbours(self, mask: np.uint64) -> None:
        row, key = _by_mask(self.word, mask, self.order)
        at = np.flatnonzero(key[1:] == key[:-1])
        for k in range(0, len(at), _BATCH):
            self.link(row[at[k : k + _BATCH]], row[at[k : k + _BATCH] + 1])

    def meeting(self, mask: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that meet others, and for each from where on and how many later ones of other components it meets there."""
        row, key = _by_mask(self.word, mask, self.order)
        equal = key[1:] == key[:-1]
        at = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
        row, key = row[at], key[at]
        own = self.own[row]
        other = key[1:] != key[:-1]
        ends = [np.append(np.flatnonzero(e) + 1, len(at)) for e in (other, other | (own[1:] != own[:-1]))]
        last, start = (np.repeat(e, np.diff(e, prepend=0)) for e in ends)
        return row, start, last - start

    def compare(self, mask: np.uint64) -> None:
        """Link what meets under a mask and is not of one component."""
        row, start, n = self.meeting(mask)
        at = np.flatnonzero(n)
        total = np.cumsum(n[at])
        k = 0
        while k < len(at):
            m = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + _BATCH, "right")))
            self.link(row[np.repeat(at[k:m], n[at[k:m]])], row[vec.expand(start[at[k:m]], n[at[k:m]])])
            k = m
        if self.waiting > self.n >> 3:
            self.join()


def _words(f: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """What the fingerprints have at these places, as words."""
    out = np.zeros(len(f[0]), np.uint64)
    for at in range(0, len(out), _BLOCK):
        own, part = out[at : at + _BLOCK], [np.ascontiguousarray(c[at : at + _BLOCK]) for c in f]
        for k, p in enumerate(places.tolist()):
            own |= (part[p // 64] >> np.uint64(63 - p % 64) & np.uint64(1)) << np.uint64(63 - k)
    return out


def _by_mask(word: np.ndarray, mask: np.uint64, order: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of a hash of what the mask lets through, and that hash: a false meeting is only one more candidate."""
    key = word & mask
    key *= _ODD
    key >>= order
    key <<= order
    key |= np.arange(len(word), dtype=np.uint64)
    key.sort()
    row = (key & ((np.uint64(1) << order) - np.uint64(1))).view(np.int64)
    key >>= order
    return row, key


def linked(f: np.ndarray, split: int, max_bits: int, part: int, of: int) -> np.ndarray:
    """The least row of each row's component by a part of the work on the rows of f; with split, by pairs across it alone.
    The components of all parts' together are those of all near pairs. All tasks of the same rows come to the same choice of way.
    f is put into another order."""
    pairs = split * (len(f) - split) if split else len(f) * (len(f) - 1) // 2
    sets = [masks(max_bits)] + ([masks(max_bits, WIDE)] if len(f) > LONG else [])
    at = _Linked(f, split, max_bits)
    costs = [SORTED * len(f) * sum(len(own) for _, own in sets[0])]
    if pairs > costs[0]:
        for places, own in sets[0]:
            at.take(places)
            for mask in own[:: -(-len(own) // _CHAINED)]:
                at.neighbours(mask)
            at.join()
        costs = [SORTED * len(f) * sum(len(own) for _, own in way) for way in sets]
        for k, way in enumerate(sets):
            for places, own in way:
                at.take(places)
                costs[k] += MET * len(own) * int(at.meeting(own[len(own) // 2])[2].sum())
    if pairs <= min(costs):
        own = np.argsort(at.at)
        for x, y, _ in _Block([np.ascontiguousarray(f[own, k]) for k in range(_N)], split, max_bits).direct(part, of):
            at.new.append((x, y))
            if len(at.new) > 1 << 12:
                at.join()
        at.join()
        return at.label
    for places, own in sets[int(np.argmin(costs))]:
        at.take(places)
        for mask in own[part::of]:
            at.compare(mask)
    at.join()
    return at.label


class _Block:
    """Fingerprints as columns of words; pairs are any two rows, or with split those of a row before split and one from it on."""

    def __init__(self, f: list[np.ndarray], split: int, max_bits: int):
        self.f, self.n, self.split, self.max_bits = f, len(f[0]), split, max_bits
        self.pairs = split * (self.n - split) if split else self.n * (self.n - 1) // 2
        self.order = np.uint64(max(1, self.n).bit_length())

    def _near(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        """(places among the pairs, distances) of those within max_bits; x, y: places of rows, or one row and a slice."""
        few = sum((np.bitwise_count(c[x] ^ c[y]) for c in self.f[:_FIRST]), np.uint8(0))  # 256 counts as 0, which only keeps the pair
        at = np.flatnonzero(few <= self.max_bits)
        if not len(at):
            return at, few[:0]
        x, y = (x, at + y.start) if isinstance(y, slice) else (x[at], y[at])
        d = sum((np.bitwise_count(c[x] ^ c[y]) for c in self.f), np.uint16(0))
        near = d <= self.max_bits
        return at[near], d[near]

    def direct(self, part: int, of: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, rows, distances) of the near pairs by comparing all; part of the work."""
        for x in range(part, self.split or self.n, of):
            y = self.split or x + 1
            at, d = self._near(x, slice(y, None))
            if len(at):
                yield np.full(len(at), x), at + y, d

    def _meeting(self, row: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of rows of one key, about _BATCH at once."""
        at = np.flatnonzero(key[1:] == key[:-1])
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, self.n)
        later = ends[np.searchsorted(ends, at, "right")] - at - 1
        total = np.cumsum(later)
        k = 0
        while k < len(at):
            m = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + _BATCH, "right")))
            x, y = row[np.repeat(at[k:m], later[k:m])], row[vec.expand(at[k:m] + 1, later[k:m])]
            if self.split:
                across = (x < self.split) != (y < self.split)
                x, y = x[across], y[across]
            yield x, y
            k = m

    def covered(self, part: int, of: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same pairs by part of the masks; a pair can come from several parts of the work."""
        held, most = [np.empty(0, np.int64)], 1 << 20
        for places, own in masks(self.max_bits):
            word = _words(self.f, places)
            for mask in own[part::of]:
                row, key = _by_mask(word, mask, self.order)
                for x, y in self._meeting(row, key):
                    near, d = self._near(x, y)
                    if len(near):
                        x, y = x[near], y[near]
                        held.append((np.minimum(x, y) << 32 | np.maximum(x, y)) << 9 | d)
                if sum(map(len, held)) > most:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) > 1 << 22:
                        yield self._rows(held.pop())
                    most = 2 * sum(map(len, held)) + (1 << 20)
        if held:
            yield self._rows(np.unique(np.concatenate(held)))

    @staticmethod
    def _rows(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return code >> 41, code >> 9 & 0xFFFFFFFF, code & 0x1FF

    def near(self, part: int, of: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Near pairs in whichever way is cheaper. All tasks of the same rows come to the same choice."""
        count = sum(len(own) for _, own in masks(self.max_bits))
        if self.pairs <= SORTED * count * self.n:
            return self.direct(part, of)
        met = 0
        for places, own in masks(self.max_bits):
            word = _words(self.f, places)
            for mask in own[::SAMPLED]:
                _, key = _by_mask(word, mask, self.order)
                n = np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))
                met += int((n * (n - 1) // 2).sum()) * len(own) // len(own[::SAMPLED])
        return self.direct(part, of) if MET * met + SORTED * count * self.n > self.pairs else self.covered(part, of)


def _in_order(side: np.ndarray, ids: np.ndarray, f: list[np.ndarray]) -> np.ndarray:
    """Places of the rows by side, id and fingerprint. Shuffled rows arrive in any order, and tasks that share a block's rows out
    must number them alike."""
    return np.lexsort((*f, ids, side))


def _by_blocks(reps: DataFrame, block: int, work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(ids, fingerprints, split, part, of) on the rows (id, f0...) of each block and of each two blocks."""
    n = reps.count()
    blocks = 1 if n <= 2 * block else -(-n // block)
    both = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    slices = -(-SLICES // len(both))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.zeros(batch.num_rows, np.uint64)
            for k in range(1 + _N):
                h = vec.mix64(h ^ batch.column(k).to_numpy().view(np.uint64))
            h %= np.uint64(blocks)
            for k, (i, j) in enumerate(both):
                own = np.flatnonzero((h == i) | (h == j))
                rows, right = batch.take(pa.array(own)), pa.array((h[own] != i).astype(np.int8))
                for s in range(slices if len(own) else 0):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k * slices + s, np.int32)), right, *rows.columns], names=["task", "side", "id", *_F])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        task, got = 0, []
        for batch in batches:  # copied, so that Spark's batches can go
            if batch.num_rows:
                task = batch.column(0)[0].as_py()
                got.append((batch.column(1).to_numpy().copy(), batch.column(2).to_numpy().copy(), np.stack([c.to_numpy() for c in batch.columns[3:]], 1).view(np.uint64)))
        if not got:
            return
        side, ids, f = (np.concatenate(c) for c in zip(*got))
        got.clear()
        order = _in_order(side, ids, list(f.T))
        k, s = divmod(task, slices)
        i, j = both[k]
        _permute(f, order)
        split, ids = int((side == 0).sum()), ids[order]
        del side, order
        if i == j or split not in (0, len(ids)):
            yield from work(ids, f, split if i != j else 0, s, slices)

    tasks = reps.select("id", *_F).mapInArrow(dealt, "task int, side tinyint, id bigint, " + ", ".join(f"{k} bigint" for k in _F))
    return tasks.repartitionById(len(both) * slices, F.col("task")).mapInArrow(joined, schema).distinct()


def similar(reps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b, bits), a < b, of the rows (id, f0...) of different fingerprints that differ in at most max_bits: all of them."""

    def pairs(ids: np.ndarray, f: np.ndarray, split: int, part: int, of: int) -> Iterator[pa.RecordBatch]:
        for x, y, d in _Block([np.ascontiguousarray(c) for c in f.T], split, max_bits).near(part, of):
            a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
            other = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[other]), pa.array(b[other]), pa.array(d[other].astype(np.int32))], names=["a", "b", "bits"])

    return _by_blocks(reps, block, pairs, "a bigint, b bigint, bits int")


def connected(reps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, of the rows (id, f0...) of different fingerprints, whose connected components are those of similar()."""

    def links(ids: np.ndarray, f: np.ndarray, split: int, part: int, of: int) -> Iterator[pa.RecordBatch]:
        least = linked(f, split, max_bits, part, of)
        other = np.flatnonzero(ids != ids[least])
        for k in range(0, len(other), _BATCH):
            a, b = ids[least[other[k : k + _BATCH]]], ids[other[k : k + _BATCH]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _by_blocks(reps, block, links, "a bigint, b bigint")


def _members(named: DataFrame, max_bits: int) -> DataFrame:
    """(id, group) of each id of named (doc_id, text) that is near another, and the least id of its group."""
    prints = cut(named.mapInArrow(_prints, "doc_id bigint, " + ", ".join(f"{k} bigint" for k in _F)))
    reps = cut(prints.groupBy(*_F).agg(F.min("doc_id").alias("id")).select("id", *_F))
    copies = prints.join(reps, _F).select(F.col("id").alias("a"), F.col("doc_id").alias("b")).filter("a <> b")
    return groups(connected(reps, max_bits).union(copies))


def duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, duplicate_of) of each document that goes and the document of its group that stays."""
    return _members(texts(docs), max_bits).filter("id <> group").select(F.col("id").alias("doc_id"), F.col("group").alias("duplicate_of"))


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, all columns, without the duplicates of a document that stays."""
    doc_id = F.col("doc_id").cast("bigint")
    if docs.filter(doc_id.isNull()).select("doc_id").isEmpty():
        gone = duplicates(docs, max_bits).select(F.col("doc_id").alias("__gone"))
        return docs.join(gone, doc_id == F.col("__gone"), "left_anti")
    rows = cut(docs.filter(doc_id.isNull()).withColumn("__row", F.monotonically_increasing_id()))
    turn = 0
    while True:  # numbers of their own, which are nobody's doc_id: xxhash64 of one number is a bijection
        numbered = rows.withColumn("__own", F.xxhash64(F.col("__row") + F.lit(turn).cast("bigint")))
        if docs.select(doc_id.alias("__own")).join(numbered.select("__own"), "__own", "left_semi").isEmpty():
            break
        turn += 1
    both = texts(docs).union(numbered.select("__own", F.col("text").cast("string")))
    members = cut(_members(both, max_bits).join(numbered.select(F.col("__own").alias("id"), F.lit(True).alias("nameless")), "id", "left"))
    stays = members.groupBy("group").agg(F.coalesce(F.min(F.when(F.col("nameless").isNull(), F.col("id"))), F.min("id")).alias("stays"))
    gone = members.join(stays, "group").filter("id <> stays").select(F.col("id").alias("__gone"))
    named = docs.filter(doc_id.isNotNull()).join(gone, doc_id == F.col("__gone"), "left_anti")
    return named.union(numbered.join(gone, F.col("__own") == F.col("__gone"), "left_anti").select(*docs.columns))
