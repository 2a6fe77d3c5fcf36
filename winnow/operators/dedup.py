"""Deduplication that keeps the first: by key, by MinHash signature, by perceptual hash.

Greedy removal drops a row if it is similar to an earlier row that was itself kept. Candidates come from a lossless filter (bands of
a hash, bits of a signature), each is verified, and the order-dependent choice is made in rounds over the verified pairs alone: a
row with no open or kept earlier neighbour stays, a row with a kept one goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import text as T
from winnow.operators.order import cut

PERMUTATIONS, SIMILAR = 128, 0.8
IMAGE_BITS, IMAGE_BANDS = 8, 8
#: Bits of each number in a sketch; rows that one block takes, rows of a block at most, pairs that the driver may hold or whose ids are broadcast.
PLANES, SMALL, BLOCK, FEW = 8, 1 << 11, 1 << 18, 500_000
_ROWS, _SHINGLES, _KNOWN, _HASHES = 128, 1 << 17, {}, np.empty((1 << 10, PERMUTATIONS), np.uint32)
_PREFIXES = [f"{i}_".encode() for i in range(PERMUTATIONS)]


def keep_first(df: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """The first row of each key, in the order of pos."""
    w = Window.partitionBy("__key").orderBy(pos)
    return df.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__key", "__n")


def _minhashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A worker hashes each distinct shingle once; _SHINGLES of them are remembered at a time, which changes no result. Of a batch's
    shingles, those of _ROWS rows are looked up at a time, each distinct one as a string once: a batch is never held as Python objects."""
    global _HASHES
    for whole in batches:
        for start in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(start, _ROWS)
            if len(_KNOWN) > _SHINGLES:
                _KNOWN.clear()
            parts = batch.column(1).flatten().dictionary_encode()
            own = parts.dictionary.to_pylist()
            at = np.fromiter(map(_KNOWN.get, own, repeat(-1)), np.int64, len(own))
            for k in np.flatnonzero(at < 0):
                n = at[k] = _KNOWN[own[k]] = len(_KNOWN)
                if n == len(_HASHES):
                    _HASHES = np.concatenate([_HASHES, np.empty_like(_HASHES)])
                _HASHES[n] = [int.from_bytes(md5(p + own[k].encode()).digest()[12:], "big") for p in _PREFIXES]
            at, out, i = at[parts.indices.to_numpy()], [], 0
            for size in pc.list_value_length(batch.column(1)).to_pylist():
                best = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
                for k in range(i, i + size, 512):
                    np.minimum(best, _HASHES[at[k : min(k + 512, i + size)]].min(0), out=best)
                out.append(best.tobytes())
                i += size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "signature"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, PERMUTATIONS)


def _signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, signature binary): 128 numbers of 32 bits."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), T.shingles(F.col(text)).alias("shingles"))
    return rows.mapInArrow(_minhashes, "id bigint, signature binary")


def signatures(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, signature) with 128 minima of the low 32 bits of md5("i_shingle") over the text's shingles."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, m.size + 1, PERMUTATIONS, dtype=np.int32), pa.array(m.ravel()))], names=["id", "signature"])

    return _signed(df, key, text).mapInArrow(listed, "id bigint, signature array<bigint>")


def agreement(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x) / F.size(a)


def greedy(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ids of nodes (id) that stay; pairs (a, b), a < b, are the similar ones. Up to FEW of them are gone through in order by the
    driver, which holds no more; others take rounds, in each of which many rows are settled at once."""
    edges = cut(pairs.select("a", "b").distinct())
    if edges.count() <= FEW:
        out: set[int] = set()
        listed = edges.toArrow().sort_by([("b", "ascending"), ("a", "ascending")])
        for a, b in zip(listed["a"].to_pylist(), listed["b"].to_pylist()):
            if a not in out:
                out.add(b)
        if not out:
            return nodes.select("id")
        gone = nodes.sparkSession.createDataFrame(pa.table({"id": pa.array(sorted(out), pa.int64())}))
        return nodes.join(F.broadcast(gone), "id", "left_anti").select("id")
    states = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while states.filter("kept IS NULL").limit(1).count():
        by = edges.join(states.select(F.col("id").alias("a"), F.col("kept").alias("earlier")), "a")
        verdict = by.groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("earlier", F.lit(False))).alias("out"), F.bool_or(F.col("earlier").isNull()).alias("open"))
        states = cut(states.join(verdict, "id", "left").select("id", F.coalesce("kept", F.when(F.coalesce("out", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))).alias("kept")))
    return nodes.join(states.filter("NOT kept"), "id", "left_anti").select("id")


def _sketch(m: np.ndarray) -> np.ndarray:
    """(n, 2 * PLANES) words: two for each of the lowest bits of the 128 numbers."""
    return np.concatenate([np.packbits((m >> np.uint32(k) & np.uint32(1)).astype(np.uint8), axis=1).view(np.uint64) for k in range(PLANES)], axis=1)


def _apart(x: np.ndarray, y: np.ndarray, planes: int) -> np.ndarray:
    """How many of the 128 numbers the lowest bits tell apart: no more than differ."""
    d = x[:, : 2 * planes] ^ y[:, : 2 * planes]
    return np.bitwise_count(np.bitwise_or.reduce(d.reshape(-1, planes, 2), axis=1)).sum(1)


def _close(x: np.ndarray, y: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in x, places in y, numbers told apart) of all rows of x and y that the sketches tell apart in at most `most` numbers."""
    high, wide = 16, 8192
    u, v = np.ascontiguousarray(x[:, :2].T), np.ascontiguousarray(y[:, :2].T)
    d, n, both = np.empty((high, wide), np.uint64), np.empty((high, wide), np.uint8), np.empty((high, wide), np.uint8)
    for j in range(0, len(y), wide):
        for i in range(0, len(x), high):
            r, c = min(high, len(x) - i), min(wide, len(y) - j)
            for w, out in ((0, both), (1, n)):
                np.bitwise_xor(u[w, i : i + r, None], v[w, None, j : j + c], out=d[:r, :c])
                np.bitwise_count(d[:r, :c], out=out[:r, :c])
            both[:r, :c] += n[:r, :c]
            a, b = np.nonzero(both[:r, :c] <= most)
            a, b = a + i, b + j
            for planes in (2, PLANES):
                found = _apart(x[a], y[b], planes)
                a, b, found = a[found <= most], b[found <= most], found[found <= most]
            if len(a):
                yield a, b, found


def _tiles(left: DataFrame, right: DataFrame | None, rows: int, most: int, every: bool) -> DataFrame:
    """(a, b, apart, found) of the rows (id, sketch) of left and right, or of left alone with a < b, whose sketches are close.

    Rows are dealt to blocks, and a task compares two blocks: it holds their sketches alone, and a row is sent as often as there are
    blocks. Without `every` a task gives for each b its closest a and the number found; pairs never outnumber rows times blocks.
    """
    blocks = 1 if rows <= SMALL else max(8, -(-rows // BLOCK))
    h, k = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k")
    if right is None:
        dealt = left.select("id", "sketch", h.alias("h"), k).select((F.least("h", "k") * blocks + F.greatest("h", "k")).alias("task"), (F.col("h") > F.col("k")).alias("second"), "id", "sketch")
    else:
        sides = left.select("id", "sketch", h.alias("h"), F.lit(False).alias("second"), k).union(right.select("id", "sketch", h.alias("h"), F.lit(True).alias("second"), k))
        dealt = sides.select(F.when(F.col("second"), F.col("k") * blocks + F.col("h")).otherwise(F.col("h") * blocks + F.col("k")).alias("task"), "second", "id", "sketch")
    alone = right is None

    def batch(a: np.ndarray, b: np.ndarray, apart: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(apart, pa.int32()), pa.array(found, pa.int64())], names=["a", "b", "apart", "found"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, within = [], False
        for rows in batches:
            if rows.num_rows:
                task = rows.column(0)[0].as_py()
                within = alone and task // blocks == task % blocks
                got.append((rows.column(1).to_numpy(False), rows.column(2).to_numpy().copy(), np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint64).reshape(-1, 2 * PLANES)))
        if not got:
            return
        second, ids, words = (np.concatenate(c) for c in zip(*got))
        got.clear()
        other = np.flatnonzero(second)
        first = np.flatnonzero(~second)
        if within:
            other = first
        x, y = ids[first], ids[other]
        near = _close(words[first], words[other], most)
        if every:
            held, n = [], 0
            for a, b, apart in near:
                a, b = x[a], y[b]
                if within:
                    once = a < b
                    a, b, apart = a[once], b[once], apart[once]
                elif alone:
                    a, b = np.minimum(a, b), np.maximum(a, b)
                held.append((a, b, apart, np.ones(len(a), np.int64)))
                n += len(a)
                if n >= 1 << 16:
                    yield batch(*(np.concatenate(c) for c in zip(*held)))
                    held, n = [], 0
            if held:
                yield batch(*(np.concatenate(c) for c in zip(*held)))
            return
        best, at, found = np.full(len(y), PERMUTATIONS + 1), np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
        for a, b, apart in near:
            np.add.at(found, b, 1)
            order = np.lexsort((apart, b))
            a, b, apart = a[order], b[order], apart[order]
            lead = np.append(True, b[1:] != b[:-1])
            a, b, apart = a[lead], b[lead], apart[lead]
            nearer = apart < best[b]
            best[b[nearer]], at[b[nearer]] = apart[nearer], a[nearer]
        hit = np.flatnonzero(found)
        for k in range(0, len(hit), 1 << 16):
            part = hit[k : k + (1 << 16)]
            yield batch(x[at[part]], y[part], best[part], found[part])

    return dealt.repartitionById(blocks * blocks, F.col("task")).mapInArrow(compared, "a bigint, b bigint, apart int, found bigint")


def text_dedup(df: DataFrame, pos: str = "pos", text: str = "text", similar: float = SIMILAR, first: int = 1 << 13) -> DataFrame:
    """df without rows whose signature agrees in at least `similar` places with that of an earlier row that stays.

    A null text counts as empty. Rows of equal signatures, as equal texts have, are compared once, by their first: a later copy always
    goes, with its first or instead of it. Rows come up in stretches of their order, of about `first` at the start and each twice
    as far as the last. A stretch loses what is similar to a row that stays from before, and only its rest is compared with itself: of
    a large group of similar rows few stay, so that the many pairs within it are never made. Rows are compared by the lowest bits of
    the 128 numbers, which leaves out no similar pair; whole signatures decide.
    """
    sig = cut(_signed(df, pos, text).filter("id IS NOT NULL").groupBy("signature").agg(F.min("id").alias("id")))
    least = int(np.ceil(similar * PERMUTATIONS - 1e-9))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in _sketch(_matrix(batch.column(1)))], pa.binary())], names=["id", "sketch"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(1) if batch.num_rows else np.zeros(0)
            yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    def true(pairs: DataFrame, n: int) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        named = sig.join(F.broadcast(ids) if n <= FEW else ids, "id", "left_semi")  # so that few signatures are shuffled
        both = pairs.select("a", "b").join(named.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(named.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
        return cut(both.select("a", "b", "sa", "sb").mapInArrow(verified, "a bigint, b bigint"))

    rows = cut(sig.select("id", "signature").mapInArrow(sketched, "id bigint, sketch binary"))
    n = rows.count()
    shares = [2.0**-k for k in range(max(0, int(np.ceil(np.log2(max(n, 1) / first)))), 0, -1)]
    edges = [None, *(sorted(set(rows.agg(F.percentile_approx("id", shares, 10_000)).first()[0])) if shares else []), None]
    kept, stayed = None, 0
    for low, high in zip(edges, edges[1:]):
        new = rows.filter((F.lit(True) if low is None else F.col("id") > low) & (F.lit(True) if high is None else F.col("id") <= high))
        if kept is not None:
            size = max(stayed, new.count())
            near = cut(_tiles(kept, new, size, PERMUTATIONS - least, False).groupBy("b").agg(F.min(F.struct("apart", "a")).alias("at"), F.sum("found").alias("found")).select("at.a", "b", "found"))
            gone = true(near, near.count()).select(F.col("b").alias("id"))
            open_ = cut(near.filter("found > 1").select(F.col("b").alias("id")).join(gone, "id", "left_anti"))
            if open_.limit(1).count():  # its closest by sketch is not similar; another may be
                rest = cut(_tiles(kept, new.join(open_, "id", "left_semi"), size, PERMUTATIONS - least, True).select("a", "b"))
                gone = gone.union(true(rest, rest.count()).select(F.col("b").alias("id")).distinct())
            new = cut(new.join(gone, "id", "left_anti"))
        near = cut(_tiles(new, None, new.count(), PERMUTATIONS - least, True).select("a", "b"))
        new = cut(new.join(greedy(new.select("id"), true(near, near.count())), "id", "left_semi"))
        kept, stayed = new if kept is None else kept.union(new), stayed + new.count()
    return df.join(kept.select(F.col("id").alias("__kept")), F.col(pos) == F.col("__kept"), "left_semi")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def image_dedup(df: DataFrame, pos: str = "pos", phash: str = "phash", below: int = IMAGE_BITS) -> DataFrame:
    """df without rows whose hash differs in fewer than `below` bits from that of an earlier row that stays, and without rows
    of null hash. Fewer than 8 flips leave one of eight bytes as it is."""
    if below > IMAGE_BANDS:
        raise ValueError("banding is lossless for up to 8 bits")
    first = cut(df.filter(F.col(phash).isNotNull()).groupBy(F.col(phash).alias("h")).agg(F.min(pos).alias("id")))
    rows = first.select("id", "h", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("h", 8 * k).bitwiseAND(F.lit(255)).alias("v")) for k in range(IMAGE_BANDS)])).alias("band"))
    near = rows.alias("x").join(rows.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id")) & (hamming(F.col("x.h"), F.col("y.h")) < below))
    kept = greedy(first.select("id"), near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))).withColumnRenamed("id", "__kept")
    return df.join(kept, F.col(pos) == F.col("__kept"), "left_semi")


def _resample(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Lanczos-3 resampling, as wide as the scale when shrinking."""
    for axis, n in ((0, h), (1, w)):
        size = x.shape[axis]
        scale = size / n
        wide = max(1.0, scale)
        at = (np.arange(n) + 0.5) * scale
        d = (np.arange(size)[None] + 0.5 - at[:, None]) / wide
        weight = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0)
        weight /= weight.sum(1, keepdims=True)
        x = np.moveaxis(np.tensordot(weight, x, (1, axis)), 0, axis)
    return np.clip(np.rint(x), 0, 255)


def dhash(pixels: np.ndarray) -> int:
    """64 horizontal comparisons of a 9 x 8 reduction of grey pixels (rows x columns), first bit lowest, as a signed integer."""
    small = _resample(np.asarray(pixels, float), 8, 9)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def ahash(pixels: np.ndarray) -> int:
    small = _resample(np.asarray(pixels, float), 8, 8)
    return int(np.packbits((small >= small.mean()).ravel(), bitorder="little").view("<i8")[0])


def entropy(pixels: np.ndarray) -> float:
    p = np.bincount(np.asarray(pixels, np.uint8).ravel(), minlength=256) / np.size(pixels)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def sharpness(pixels: np.ndarray) -> float:
    """Variance of the Laplacian; the border is mirrored."""
    p = np.pad(np.asarray(pixels, float), 1, mode="symmetric")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def image_features(df: DataFrame, key: str = "pos", pixels: str = "pixels", width: str = "width") -> DataFrame:
    """(key, phash, average_hash, entropy, blur) from grey pixels in rows of `width`; all null where they can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, w in zip(b["p"], b["w"]):
                ok = p is not None and w == w and w and w > 0 and len(p) and len(p) % int(w) == 0
                x = np.asarray(p, float).reshape(-1, int(w)) if ok else None
                out.append((dhash(x), ahash(x), entropy(x), sharpness(x)) if ok else (None,) * 4)
            res = pd.DataFrame(out, columns=["phash", "average_hash", "entropy", "blur"]).astype({"phash": "Int64", "average_hash": "Int64"})
            yield pd.concat([b[["id"]].reset_index(drop=True).rename(columns={"id": key}), res], axis=1)

    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(pixels).alias("p"), F.col(width).cast("int").alias("w"))
    return rows.mapInPandas(run, f"{key} bigint, phash bigint, average_hash bigint, entropy double, blur double")


def clean(df: DataFrame, pos: str = "pos") -> tuple[DataFrame, dict[str, int]]:
    """Image dedup, text dedup, quality gate, in this order, and the rows left after each. Only places are kept from step to step:
    df is read again instead of being written once a step, and the gate's filter goes down to the scan."""
    from winnow.operators.filters import quality_gate

    counts = {"input": df.count()}
    for name, step in (("image_dedup", lambda d: image_dedup(d, pos)), ("text_dedup", lambda d: text_dedup(d, pos, "source_text"))):
        left = cut(step(df).select(F.col(pos).alias("__left")))
        df = df.join(left, F.col(pos) == F.col("__left"), "left_semi")
        counts[name] = left.count()
    df = quality_gate(df)
    counts["quality"] = df.count()
    return df, counts
