"""Media columns: copies of images, cropped or edited, by local descriptors.

Images (binary PGM, PPM or PNG of 8 or 16 bits, not interlaced) are read as grey levels. On three scales Harris corners are
taken, the strongest ones, a fixed number for every stretch of area (SCALES); each has an orientation, that of its patch's
intensity centroid, and descriptors of BITS comparisons of smoothed points, rotated to the two nearest of _TURNS orientations,
so that two corners whose orientation falls on either side of a bound still share one. Descriptors are cut into TABLES of
WIDTH bits; two images' descriptors that agree in a table and differ in at most MAX_BITS match, and each match counts once, in the
first table where it is found. Matches of a pair of images then vote: each proposes a similarity transform (scale, turn, shift),
and the pair is linked if MIN_INLIERS matches with distinct places on either side agree with one transform within TOLERANCE.

Images with equal features are one class, and classes are compared: copies are not expanded into pairs. Every class meets every
other through the tables; no candidate is capped. A row in the join is 48 bytes.

Defined results: a null, unreadable, too small or featureless image is its own class and group, without links. Of one id's rows
with different images each is in a class of its own; the id has the least of their classes and groups, and the most links.
Ties in corner strength go to the upper, then the left one. Rows without id are left out; empty input gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import class_report, cut

TABLES, WIDTH, MAX_BITS, MIN_INLIERS, TOLERANCE, SEED = 8, 23, 30, 5, 5.0, 42
BITS, _WORD = TABLES * WIDTH, 62  # a descriptor lies in three int64 of 62 bits
#: Scales, and the pixels of the scaled image for which there is one corner: 8, 6 and 4 corners for 96 x 96 pixels.
SCALES = ((1.0, 1152), (2**-0.5, 768), (0.5, 576))
_R, _TURNS = 12, 32
_PIXELS = 1 << 18  # pixels of images described at once; a larger image is alone


def _pattern() -> np.ndarray:
    """turns x BITS x 2 points x (dy, dx)."""
    r = np.random.default_rng(SEED)
    p = np.clip(r.normal(0, 6.0, (BITS, 2, 2)), -_R + 1.5, _R - 1.5)
    p *= np.minimum(1, (_R - 1) / np.maximum(np.linalg.norm(p, axis=2, keepdims=True), 1e-9))
    a = np.arange(_TURNS) * 2 * np.pi / _TURNS
    c, s = np.cos(a)[:, None, None], np.sin(a)[:, None, None]
    return np.rint(np.stack([p[..., 0] * c + p[..., 1] * s, p[..., 1] * c - p[..., 0] * s], -1)).astype(np.int64)


_PATTERN = _pattern()


def _png(data: bytes) -> np.ndarray:
    at, head, body, palette = 8, b"", b"", b""
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        head, body = part if kind == b"IHDR" else head, body + part if kind == b"IDAT" else body
        palette = part if kind == b"PLTE" else palette
        at += 12 + n
    w, h, depth, colour, lace = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12]
    if depth not in (8, 16) or lace:
        raise ValueError("8 or 16 bits, not interlaced")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * (depth // 8)  # bytes of a pixel
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * bands)
    out, up = np.empty((h, w * bands), np.uint8), np.zeros(w * bands, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 0:
            now = line.copy()
        elif kind == 2:
            now = line + up
        elif kind == 1:
            now = np.cumsum(line.reshape(w, bands), 0, dtype=np.uint8).ravel()
        else:
            now = line.copy()
            for i in range(w * bands):
                a, b, c = (int(now[i - bands]) if i >= bands else 0), int(up[i]), (int(up[i - bands]) if i >= bands else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    q = a + b - c
                    guess = min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2]
                now[i] = (int(line[i]) + guess) & 255
        out[y] = up = now
    out = out.reshape(h, w, bands)[..., :: depth // 8]  # of 16 bits the upper 8
    bands //= depth // 8
    if colour == 3:
        return np.frombuffer(palette, np.uint8).reshape(-1, 3)[out[..., 0]]
    return out[..., :3] if bands >= 3 else out[..., :1]


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == len(data):
            raise ValueError("the header is cut off")
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields
    bands = 1 if data[:2] == b"P5" else 3
    if top > 255:
        raise ValueError("8 bits")
    return np.frombuffer(data, np.uint8, w * h * bands, at + 1).reshape(h, w, bands)


def grey(data: bytes | None) -> np.ndarray | None:
    """Grey levels of an image; None where it can't be read."""
    try:
        x = _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else _netpbm(data) if data[:2] in (b"P5", b"P6") else None
    except (ValueError, KeyError, IndexError, TypeError, zlib.error):
        return None
    return None if x is None or not x.size else (x.astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32) if x.shape[2] == 3 else x[..., 0].astype(np.float32))


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1; the edge repeats."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p = np.pad(x, pad, mode="edge")
        n = x.shape[axis]
        total = p[:, :n].copy() if axis == 1 else p[:, :, :n].copy()
        for k in range(1, 2 * r + 1):
            total += p[:, k : k + n] if axis == 1 else p[:, :, k : k + n]
        total /= np.float32(2 * r + 1)
        x = total
    return x


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear; height and width from scale."""
    if scale == 1:
        return x
    h, w = (max(1, int(round(n * scale))) for n in x.shape[1:])
    for axis, n in ((1, h), (2, w)):
        at = np.clip((np.arange(n) + 0.5) * x.shape[axis] / n - 0.5, 0, x.shape[axis] - 1)
        lo = np.floor(at).astype(int)
        hi = np.minimum(lo + 1, x.shape[axis] - 1)
        f = (at - lo).astype(np.float32).reshape((-1, 1) if axis == 1 else (1, -1))
        x = np.take(x, lo, axis) * (1 - f) + np.take(x, hi, axis) * f
    return x


def features(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, x y scale turn, descriptor as 3 int64) of the keypoints of images of one size."""
    own, place, bits = [], [], []
    for scale, per in SCALES:
        x = _resized(images, scale)
        b, h, w = x.shape
        most = -(-h * w // per)
        m = _R + 1
        if h <= 2 * m or w <= 2 * m:
            continue
        soft = _box(x, 1)
        gy, gx = np.zeros_like(soft), np.zeros_like(soft)
        gy[:, 1:-1], gx[:, :, 1:-1] = soft[:, 2:] - soft[:, :-2], soft[:, :, 2:] - soft[:, :, :-2]
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
        peak = r.copy()
        for axis in (1, 2):
            p = np.pad(peak, [(0, 0) if k != axis else (2, 2) for k in range(3)], constant_values=-np.inf)
            n = peak.shape[axis]
            peak = p[:, :n].copy() if axis == 1 else p[:, :, :n].copy()
            for k in range(1, 5):
                np.maximum(peak, p[:, k : k + n] if axis == 1 else p[:, :, k : k + n], out=peak)
        r = np.where((r == peak) & (r > 1.0), r, 0)[:, m:-m, m:-m]
        flat = r.reshape(b, -1)
        top = np.argsort(-flat, axis=1, kind="stable")[:, :most]
        i, k = np.nonzero(np.take_along_axis(flat, top, 1) > 0)
        y, xs = np.divmod(top[i, k], w - 2 * m)
        y, xs = y + m, xs + m
        d = np.arange(-_R, _R + 1)
        disc = (d[:, None] ** 2 + d**2 <= _R * _R).astype(np.float32)
        patch = soft[i[:, None, None], y[:, None, None] + d[:, None], xs[:, None, None] + d] * disc
        turn = np.arctan2((patch * d[:, None].astype(np.float32)).sum((1, 2)), (patch * d.astype(np.float32)).sum((1, 2)))
        q = np.floor(turn / (2 * np.pi) * _TURNS).astype(int) % _TURNS
        q, i, y, xs, turn = np.concatenate([q, (q + 1) % _TURNS]), np.tile(i, 2), np.tile(y, 2), np.tile(xs, 2), np.tile(turn, 2)
        blur = _box(soft, 1)
        o = _PATTERN[q]
        v = blur[i[:, None, None], y[:, None, None] + o[..., 0], xs[:, None, None] + o[..., 1]]
        own.append(i)
        place.append(np.stack([(xs + 0.5) / scale, (y + 0.5) / scale, np.full(len(i), scale), turn], 1))
        bits.append(v[..., 0] < v[..., 1])
    if not own:
        return np.empty(0, np.int64), np.empty((0, 4)), np.empty((0, 3), np.int64)
    bit = np.pad(np.concatenate(bits), ((0, 0), (0, 3 * _WORD - BITS))).reshape(-1, 3, _WORD).astype(np.uint64)
    return np.concatenate(own), np.concatenate(place), (bit << np.arange(_WORD, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)


def _packed(place: np.ndarray) -> np.ndarray:
    """x, y (1/8 pixel, below 131,072), scale level and turn (1/4096) in an int64."""
    x, y = (np.rint(place[:, k] * 8).astype(np.int64) for k in (0, 1))
    if len(place) and max(x.max(), y.max()) >> 20:
        raise ValueError("an image is wider or higher than 131,071 pixels")
    level = np.rint(-2 * np.log2(place[:, 2])).astype(np.int64)
    turn = np.rint(place[:, 3] / (2 * np.pi) * 4096).astype(np.int64) % 4096
    return x << 40 | y << 20 | level << 14 | turn


def _unpacked(g: np.ndarray) -> tuple[np.ndarray, ...]:
    return (g >> 40) / 8, (g >> 20 & 0xFFFFF) / 8, 2.0 ** (-(g >> 14 & 63) / 2), (g & 4095) * 2 * np.pi / 4096


_POINT = np.dtype([("at", "<i8"), ("d", "<i8", 3)])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, features: the points of an image, sorted) of batches of (id, image); of an image without, nothing."""
    for batch in batches:
        by: dict[tuple, list[tuple[int, np.ndarray]]] = {}
        for id_, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            pixels = grey(x.as_py())
            if pixels is not None:
                own = by.setdefault(pixels.shape, [])
                own.append((id_, pixels))
                if len(own) * pixels.size >= _PIXELS:
                    yield _points(by.pop(pixels.shape))
        for own in by.values():
            yield _points(own)


def _points(images: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    own, place, desc = features(np.stack([x for _, x in images]))
    points = np.empty(len(own), _POINT)
    points["at"], points["d"] = _packed(place), desc
    order = np.lexsort((desc[:, 2], desc[:, 1], desc[:, 0], points["at"], own))
    edge = np.searchsorted(own[order], np.arange(len(images) + 1))
    blobs = [points[order[i:j]].tobytes() for i, j in zip(edge, edge[1:])]
    there = [k for k, x in enumerate(blobs) if x]
    return pa.RecordBatch.from_arrays([pa.array([images[k][0] for k in there], pa.int64()), pa.array([blobs[k] for k in there], pa.binary())], names=["id", "f"])


def _masks(t: int) -> list[tuple[int, int]]:
    """(word, mask) of the bits of table t."""
    mask = ((1 << WIDTH) - 1) << (WIDTH * t)
    return [(w, m) for w in range(3) if (m := mask >> (_WORD * w) & ((1 << _WORD) - 1))]


def _part(desc: np.ndarray, t: int) -> np.ndarray:
    """The bits of table t of each descriptor."""
    w, s = divmod(WIDTH * t, _WORD)
    key = desc[:, w] >> s
    if s + WIDTH > _WORD:
        key = key | desc[:, w + 1] << (_WORD - s)
    return key & ((1 << WIDTH) - 1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            blobs = part.column(1).to_pylist()
            points = np.frombuffer(b"".join(blobs), _POINT)
            own = np.repeat(part.column(0).to_numpy(), [len(x) // _POINT.itemsize for x in blobs])
            at, desc = points["at"], points["d"]
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(_part(desc, t) | t << 32), pa.array(own), pa.array(np.ascontiguousarray(at)), *(pa.array(np.ascontiguousarray(desc[:, j])) for j in range(3))], names=["key", "id", "at", "d0", "d1", "d2"])


def _consensus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        lists = batch.column(2)
        edge = lists.offsets.to_numpy()
        ga, gb = (lists.values.field(k).to_numpy() for k in (0, 1))
        for i in range(len(a)):
            p, q = ga[edge[i] : edge[i + 1]], gb[edge[i] : edge[i + 1]]
            n = _inliers(p, q)
            if n >= MIN_INLIERS:
                out.append((a[i], b[i], n))
        if out:
            x, y, n = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(n, pa.int32())], names=["id_a", "id_b", "inliers"])


def _inliers(p: np.ndarray, q: np.ndarray) -> int:
    """The most matches, with distinct places on either side, that one match's transform explains."""
    ax, ay, asc, at = _unpacked(p)
    bx, by, bsc, bt = _unpacked(q)
    ratio, turn = asc / bsc, bt - at
    za, zb = ax + 1j * ay, bx + 1j * by
    f = ratio * np.exp(1j * turn)
    best = 0
    for k in range(0, len(p), 256):
        s = slice(k, k + 256)
        error = np.abs(f[s, None] * (za - za[s, None]) + zb[s, None] - zb)
        ok = error <= TOLERANCE * np.maximum(1, ratio[s, None])
        votes = ok.sum(1)
        for row in np.argsort(-votes, kind="stable"):
            if votes[row] <= best:  # distinct places are no more than votes
                break
            best = max(best, min(len(set((p[ok[row]] >> 20).tolist())), len(set((q[ok[row]] >> 20).tolist()))))
    return best


def _classes(images: DataFrame, id_col: str, image_col: str, prepare: Callable | None) -> tuple[DataFrame, DataFrame]:
    """(id, f) of the images that have features, and (c, f, rep): the distinct features, numbered, with the least id of each."""
    rows = images.select(F.col(id_col).cast("bigint").alias("id"), F.col(image_col).alias("image")).filter("id IS NOT NULL")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _described(prepare(batches) if prepare else batches)

    members = cut(rows.mapInArrow(described, "id bigint, f binary"))
    return members, cut(members.groupBy("f").agg(F.min("id").alias("rep")).select(F.monotonically_increasing_id().alias("c"), "f", "rep"))


def _linked(reps: DataFrame) -> DataFrame:
    """(id_a, id_b, inliers) of the linked classes, a < b."""
    rows = reps.select("c", "f").mapInArrow(_keyed, "key bigint, id bigint, at bigint, d0 bigint, d1 bigint, d2 bigint")
    x, y = rows.alias("x"), rows.alias("y")
    apart = [F.col(f"x.d{k}").bitwiseXOR(F.col(f"y.d{k}")) for k in range(3)]
    near = sum((F.bit_count(d) for d in apart), F.lit(0)) <= MAX_BITS
    table, first = F.shiftright(F.col("x.key"), 32), F.lit(None).cast("int")
    for t in reversed(range(TABLES)):
        same = [apart[w].bitwiseAND(F.lit(m)) == 0 for w, m in _masks(t)]
        first = F.when(reduce(and_, same), F.lit(t)).otherwise(first)
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & near & (table == first))
    pairs = found.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.collect_set(F.struct(F.col("x.at").alias("p"), F.col("y.at").alias("q"))).alias("m"))  # a corner's two orientations stand at one place
    return pairs.filter(F.size("m") >= MIN_INLIERS).mapInArrow(_consensus, "id_a bigint, id_b bigint, inliers int")


def copies(images: DataFrame, id_col: str = "id", image_col: str = "image", prepare: Callable | None = None) -> DataFrame:
    """(id_a, id_b, inliers) of the linked classes, each by its least id, a < b; of several rows of two ids the most inliers count.

    `prepare` turns Arrow batches of (id, image_col) into batches of (id, image) within the same task, so that images made
    from something smaller never pass through the JVM. For stored images spark.sql.execution.arrow.maxRecordsPerBatch
    should keep a batch of them within an executor's memory.
    """
    _, reps = _classes(images, id_col, image_col, prepare)
    named = reps.select("c", "rep")
    both = _linked(reps).join(named.select(F.col("c").alias("id_a"), F.col("rep").alias("x")), "id_a").join(named.select(F.col("c").alias("id_b"), F.col("rep").alias("y")), "id_b").filter("x <> y")
    return both.groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("inliers").alias("inliers"))


def classes(images: DataFrame, id_col: str = "id", image_col: str = "image", prepare: Callable | None = None) -> DataFrame:
    """(id, class_id, n_links, group_id) of each id: the least id whose image has equal features, the number of other classes that
    its class is linked with, and the least id that links lead to. For `prepare` see copies()."""
    members, reps = _classes(images, id_col, image_col, prepare)
    links = _linked(reps).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    every = images.select(F.col(id_col).cast("bigint").alias("id")).filter("id IS NOT NULL")
    return class_report(every, members.select("id", F.md5("f").alias("h")), reps.select("c", F.md5("f").alias("h"), "rep"), links)


def drawer(side: int = 96, cells: int = 48, seed: int = SEED) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns batches of (id, 64-number vector) into (id, PGM picture): a fixed random map makes a field of cells x cells of
    the vector, which is shaded to side x side pixels, so that close vectors give pictures with small edits. Null where a
    vector is null, of another length or not finite."""
    at = np.clip((np.arange(side) + 0.5) * cells / side - 0.5, 0, cells - 1)
    lo = np.floor(at).astype(int)
    up = np.zeros((side, cells), np.float32)
    up[np.arange(side), lo] += (1 - (at - lo)).astype(np.float32)
    up[np.arange(side), np.minimum(lo + 1, cells - 1)] += (at - lo).astype(np.float32)
    spread = np.random.default_rng(seed).normal(0, 60, (64, cells * cells)).astype(np.float32)
    head = f"P5\n{side} {side}\n255\n".encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                read = [None if v is None or len(v) != 64 or None in v else np.array(v, np.float32) for v in part.column(1).to_pylist()]
                out: list[bytes | None] = [None] * len(read)
                good = [i for i, v in enumerate(read) if v is not None and np.isfinite(v).all()]
                if good:
                    field = (np.stack([read[i] for i in good]) @ spread).reshape(-1, cells, cells)
                    for i, x in zip(good, np.clip(np.rint(up @ field @ up.T + 128), 0, 255).astype(np.uint8)):
                        out[i] = head + x.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["id", "image"])

    return run


def drawn(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, image) with the drawer's picture of each vector."""
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).mapInArrow(drawer(), "id bigint, image binary")
