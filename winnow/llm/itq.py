"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Equal vectors are one class, kept once; classes are what is compared. Unit vectors are centred and projected on their principal
axes; a rotation of these is learned by turns of "code = signs of the rotated vectors" and "rotation = the orthogonal matrix
that carries the vectors closest to their codes". As the projections have mean zero the codes' bits are balanced. Axes and
rotations are learned on about FIT_ROWS classes, chosen by the hash of their vectors; all classes are indexed.

Several rotations, begun from different random ones, give as many bits as wanted. They are cut into tables of log2(classes)
bits, so that a key holds a few unrelated vectors whatever their number; two classes are candidates if they agree in some
table but for at most one bit. The number of tables follows from that width: a pair whose cosine is THRESHOLD itself shares none
with probability MISS (bits of random hyperplanes), a closer one with less. A class has tables x (width + 2) rows in the join:
126 at 5e4 vectors, 220 at 1e6, 522 at 1e8. Rows carry one rotation's code, which discards unrelated vectors before
they are shuffled. Candidates are reranked with their original vectors; those with a cosine of at least THRESHOLD are links.

Defined results: a vector that is null, has a null, NaN or infinite element, is all zero, or has not the length that most
vectors have (of equals, the greater) matches nothing: it is its own class and group, without links. Of one id's rows with
unequal vectors each is in a class of its own; the id has the least of their classes and groups, and the most links. Rows
without id are left out. Ties do not matter: every pair is judged alone. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import class_report, cut

THRESHOLD, MISS, FIT_ROWS, ITERATIONS, SEED = 0.95, 0.01, 1 << 16, 10, 42
_NARROW, _BROAD, _BLOCK = 12, 38, 1 << 11

def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """An Arrow column of dim-float binaries as rows."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) else np.empty(0, np.uint8)
    return data[at[0] : at[-1]].view(np.float32).reshape(-1, dim) if len(col) else np.empty((0, dim), np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    step = x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * step, step, dtype=np.int32)), pa.py_buffer(x)])


def unit_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id bigint, v binary) of the usable vectors, and their length."""
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("e")).filter("id IS NOT NULL AND e IS NOT NULL AND size(e) > 0")
    usual = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = int(usual["d"]) if usual else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            n = np.linalg.norm(x, axis=1)
            ok = np.isfinite(n) & (n > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), _binary(x[ok] / n[ok, None])], names=["id", "v"])

    return rows.filter(F.size("e") == dim).mapInArrow(run, "id bigint, v binary"), dim


def learn(x: np.ndarray, bits: int, rotations: int, iterations: int = ITERATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection dim x (bits x rotations)) of the quantiser, from a sample of unit vectors."""
    x = x.astype(np.float64)
    mean = x.mean(0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean) / len(x))
    axes = axes[:, ::-1][:, :bits]
    z, r, out = (x - mean) @ axes, np.random.default_rng(seed), []
    for _ in range(rotations):
        turn = np.linalg.qr(r.normal(size=(bits, bits)))[0]
        for _ in range(iterations):
            u, _, v = np.linalg.svd(z.T @ np.where(z @ turn > 0, 1.0, -1.0))
            turn = u @ v
        out.append(axes @ turn)
    return mean, np.concatenate(out, 1)


def tables_for(n: int, bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int, int]:
    """(width of a table, number of tables, number of rotations) for n classes."""
    width = min(bits, max(_NARROW, min(_BROAD, int(np.ceil(np.log2(max(2, n)))))))
    p = np.arccos(min(1.0, threshold)) / np.pi  # of a random hyperplane, to part the two
    meet = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    tables = int(np.ceil(np.log(miss) / np.log(max(1e-12, 1 - meet)))) if meet < 1 else 1
    return width, tables, -(-tables // (bits // width))


def candidates(reps: DataFrame, dim: int, n: int, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, plan: tuple[int, int, int] | None = None) -> DataFrame:
    """Distinct (a, b), a < b, of the classes (c, v) that share a table but for a bit."""
    bits = min(64, dim)
    width, tables, rotations = plan or tables_for(n, bits, threshold)
    share = int((1 << 31) * min(1.0, fit_rows / max(1, n)))
    sample = reps.filter(F.pmod(F.xxhash64("v", F.lit(SEED)), F.lit(1 << 31)) < share).select("v").collect()  # about fit_rows
    mean, w = learn(np.frombuffer(b"".join(bytes(r[0]) for r in sample), np.float32).reshape(-1, dim), bits, rotations)
    each = bits // width
    cols = np.array([t // each * bits + t % each * width for t in range(tables)])[:, None] + np.arange(width)
    p = np.arccos(min(1.0, threshold)) / np.pi
    apart = int(np.ceil(bits * p + 6.5 * np.sqrt(bits * p * (1 - p))))

    def points(flip: bool):
        masks = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(width * flip, dtype=np.uint64)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, _BLOCK):
                    part = batch.slice(k, _BLOCK)
                    bit = ((_matrix(part.column(1), dim) - mean) @ w > 0).astype(np.uint64)
                    code = (bit[:, :bits] << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
                    c = part.column(0).to_numpy()
                    for t in range(tables):
                        own = (bit[:, cols[t]] << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)
                        key = (own[:, None] ^ masks).ravel() | np.uint64(t) << np.uint64(40)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(c, len(masks))), pa.array(np.repeat(code, len(masks)))], names=["key", "c", "code"])

        return run

    left = reps.mapInArrow(points(True), "key bigint, c bigint, code bigint").alias("l")
    right = reps.mapInArrow(points(False), "key bigint, c bigint, code bigint").alias("r")
    near = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.c") < F.col("r.c")) & (F.bit_count(F.col("l.code").bitwiseXOR(F.col("r.code"))) <= apart))
    return near.select(F.col("l.c").alias("a"), F.col("r.c").alias("b")).distinct()


def _classes(rows: DataFrame) -> DataFrame:
    """(c, v, rep): the distinct vectors, numbered, with the least id of each."""
    return cut(rows.groupBy("v").agg(F.min("id").alias("rep")).select(F.monotonically_increasing_id().alias("c"), "v", "rep"))


def _linked(reps: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b, s) of the linked classes, a < b."""
    n = reps.count()
    if n < 2:
        return reps.sparkSession.createDataFrame([], "a bigint, b bigint, s double")
    slim = reps.select("c", "v")
    near = candidates(slim, dim, n, threshold)
    found = near.join(slim.select(F.col("c").alias("a"), F.col("v").alias("va")), "a").join(slim.select(F.col("c").alias("b"), F.col("v").alias("vb")), "b").select("a", "va", "b", "vb")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.einsum("ij,ij->i", _matrix(batch.column(1), dim).astype(np.float64), _matrix(batch.column(3), dim).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.minimum(1.0, np.round(s, 6)))], names=["a", "b", "s"]).filter(pa.array(s >= threshold))

    return found.mapInArrow(verified, "a bigint, b bigint, s double")


def pairs(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id_a, vec_id_b, similarity) of the linked classes, each by its least id, a < b. Where one id has several vectors its
    pairs with another id count once, by the closest, and those with itself not at all."""
    rows, dim = unit_vectors(table, id_col, vec_col)
    reps = _classes(rows)
    named = reps.select("c", "rep")
    both = _linked(reps, dim, threshold).join(named.select(F.col("c").alias("a"), F.col("rep").alias("x")), "a").join(named.select(F.col("c").alias("b"), F.col("rep").alias("y")), "b").filter("x <> y")
    return both.groupBy(F.least("x", "y").alias("vec_id_a"), F.greatest("x", "y").alias("vec_id_b")).agg(F.max("s").alias("similarity"))


def classes(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, n_links, group_id) of each id: the least id with an equal vector, the number of other classes that
    its class is linked with, and the least id that links lead to."""
    rows, dim = unit_vectors(table, id_col, vec_col)
    rows = cut(rows)
    reps = _classes(rows)
    links = _linked(reps, dim, threshold).select("a", "b")
    every = table.select(F.col(id_col).cast("bigint").alias("id")).filter("id IS NOT NULL")
    report = class_report(every, rows.select("id", F.md5("v").alias("h")), reps.select("c", F.md5("v").alias("h"), "rep"), links)
    return report.withColumnRenamed("id", "vec_id")


def keep_one(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The rows of table, all columns, but one vector of each group: its least id stays."""
    gone = classes(table, threshold, id_col, vec_col).filter("vec_id <> group_id").select(F.col("vec_id").alias("__gone"))
    return table.join(gone, F.col(id_col).cast("bigint") == F.col("__gone"), "left_anti")
