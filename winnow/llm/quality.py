"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network with calibrated probabilities.

Every word owns a sparse random index vector (NONZERO entries of +1 or -1 among DIM). A word's vector is the sum of the
index vectors of the words within WINDOW places of it, over every occurrence in the whole corpus; each task sums its own
part and the parts are added by blocks of rows, so what is gathered per task is one table. Words, and runs of symbols,
are told apart by hash: the table has 2^ROW_BITS rows whatever the corpus, and words that share a row share a vector.
A document is the mean of its words' unit vectors, the mean's length (repetition makes it long) and its log word count.

The network (tanh layer, logistic output) is fitted in numpy on at most FIT_ROWS labelled documents, taken in the order
of the md5 of their id; a fifth of them is held out to choose the temperature that makes its probabilities calibrated.

Defined results: a null, empty or blank text has no word: probability 0, rejected. Documents whose labels disagree, or
are neither 0 nor 1, are not fitted on. With no label of one class the probability is the share of the other class (1
where there are no labels at all). Repeated rows are scored one by one. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import vec
from winnow.llm.common import forget, partitions, texts

DIM, NONZERO, WINDOW, ROW_BITS = 32, 2, 2, 16
HIDDEN, EPOCHS, BATCH, RATE, FIT_ROWS, SEED, THRESHOLD = 32, 40, 256, 0.01, 8192, 42, 0.5
_ROWS, _BLOCKS = 1 << ROW_BITS, 64
_CHUNK = 1 << 19  # bytes of text at once, for the memory that two workers share with an executor


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's index vector."""
    r = vec.seeded(_ROWS, 3)
    first = (r % np.uint64(DIM)).astype(np.int64)
    second = (first + 1 + ((r >> np.uint64(16)) % np.uint64(DIM - 1)).astype(np.int64)) % DIM
    sign = np.stack([1 - 2 * ((r >> np.uint64(40 + k)) & np.uint64(1)).astype(np.int64) for k in range(NONZERO)], 1)
    return np.stack([first, second], 1), sign


def _words(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table row of each word or run of symbols, and how many each document has."""
    s, e, _ = vec.runs(b, offs)
    return (vec.Hasher(b)(s, e) >> np.uint64(64 - ROW_BITS)).astype(np.int64), vec.counts_of(s, offs)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    place, sign = _index_vectors()
    table, seen = np.zeros(_ROWS * DIM, np.int64), False
    for batch in batches:
        for _, b, offs in vec.chunks(batch.column(0), 2 * _CHUNK):
            row, n = _words(b, offs)
            own = np.repeat(np.arange(len(n)), n)
            cells, weights = [], []
            for o in range(1, WINDOW + 1):
                near = np.flatnonzero(own[o:] == own[:-o])
                for x, y in ((row[near], row[near + o]), (row[near + o], row[near])):
                    for k in range(NONZERO):
                        cells.append(x * DIM + place[y, k])
                        weights.append(sign[y, k].astype(np.float64))
            table += np.bincount(np.concatenate(cells), np.concatenate(weights), _ROWS * DIM).astype(np.int64)
            seen = True
    if seen:
        parts = table.reshape(_BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["block", "part"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(part.as_buffer(), np.int64)
            sums[k] = sums[k] + x if k in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["block", "part"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors by table row, from all of docs; a row no word has is zero. 8 MB, whatever the corpus."""
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_contexts, "block int, part binary")
    sums = parts.repartition(min(_BLOCKS, partitions(docs.sparkSession)), "block").mapInArrow(_added, "block int, part binary").collect()
    table = np.zeros((_BLOCKS, _ROWS // _BLOCKS, DIM), np.float32)
    for r in sums:
        table[r["block"]] = np.frombuffer(r["part"], np.float32).reshape(-1, DIM)
    table = table.reshape(_ROWS, DIM)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, length, out=np.zeros_like(table), where=length > 0)


def pooled(vectors: np.ndarray, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) of each text of an Arrow column."""
    forget()
    feats, words = np.zeros((len(col), DIM + 2), np.float32), np.zeros(len(col), np.int64)
    for i, b, offs in vec.chunks(col, _CHUNK):
        row, n = _words(b, offs)
        has = np.flatnonzero(n)
        if len(has):
            mean = np.add.reduceat(vectors[row], (np.cumsum(n) - n)[has], axis=0) / n[has, None]
            feats[i + has, :DIM] = mean
            feats[i + has, DIM] = np.linalg.norm(mean, axis=1)
            feats[i + has, DIM + 1] = np.log1p(n[has])
        words[i : i + len(n)] = n
    return feats, words


class Network:
    """Two layers on standardised features; prob() is the calibrated probability of class 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        self.constant = None if len(np.unique(y)) == 2 else float(y.mean()) if len(y) else 1.0
        if self.constant is not None:
            return
        rng = np.random.default_rng(seed)
        held = np.arange(len(y)) % 5 == 0
        held = held if len(np.unique(y[held])) == 2 and len(np.unique(y[~held])) == 2 else np.zeros(len(y), bool)
        self.mu, self.sd = x[~held].mean(0), x[~held].std(0) + 1e-6
        z, t = (x - self.mu) / self.sd, y.astype(np.float64)
        d = x.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        fit = np.flatnonzero(~held)
        for _ in range(EPOCHS):
            rng.shuffle(fit)
            for k in range(0, len(fit), BATCH):
                i = fit[k : k + BATCH]
                h = np.tanh(z[i] @ self.w[0] + self.w[1])
                err = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - t[i]) / len(i)
                back = np.outer(err, self.w[2]) * (1 - h * h)
                grads = [z[i].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ err + 1e-4 * self.w[2], np.array([err.sum()])]
                step += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    self.w[j] -= RATE * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if held.any():
            logit, t = self._logit(x[held]), t[held]
            heat = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
            loss = [np.logaddexp(0, np.where(t > 0, -1, 1) * logit / q).mean() for q in heat]
            self.temperature = float(heat[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mu) / self.sd @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def prob(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, Network]:
    """The corpus's word vectors and the network fitted to labels (doc_id, quality)."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("quality").cast("int").alias("__y")).filter("__id IS NOT NULL")
    known = known.groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).filter("__y = __z AND __y IN (0, 1)").drop("__z")
    known = known.orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(fit_rows)  # bounded, so fit to broadcast
    sample = texts(docs).join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = pooled(shared.value, batch.column(1))
            keep = n > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(2).filter(pa.array(keep)), pa.array([r.tobytes() for r in x[keep]], pa.binary())], names=["doc_id", "y", "x"])

    rows = sorted(tuple(r) for r in sample.mapInArrow(features, "doc_id bigint, y int, x binary").collect())
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float64).reshape(len(rows), DIM + 2)
    return vectors, Network(x, np.array([r[1] for r in rows], np.int64))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, probability, keep) of each document, keep where its probability of good quality reaches threshold."""
    vectors, net = fit(docs, labels, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = pooled(shared.value[0], batch.column(1))
            p = np.where(n > 0, shared.value[1].prob(x), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold) & (n > 0))], names=["doc_id", "probability", "keep"])

    return texts(docs).mapInArrow(score, "doc_id bigint, probability double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, all columns, that classify() keeps; scored and filtered in one pass, without a join."""
    vectors, net = fit(docs, labels, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = pooled(shared.value[0], batch.column(at))
            yield batch.filter(pa.array((n > 0) & (shared.value[1].prob(x) >= threshold)))

    return docs.mapInArrow(good, docs.schema)
