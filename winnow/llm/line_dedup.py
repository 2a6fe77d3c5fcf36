"""Line dedup: keep the first occurrence of every line of the corpus.

Lines are hashed to 128 bits where the text lies. Hashes are uniform, so the bounds of the hash ranges are known without
sampling: rows go to their range by the hash's leading bits and are sorted by (hash, document, position) there, and one
streaming pass marks first occurrences. Within a map task only the first copy of a line is sent on, as no other can be the
corpus's first; a line that half of the corpus repeats so costs a row per task, not a row per document. What comes back
is a run-length compressed bitmap per document, no text.

Defined results: lines are split at "\\n" alone and compared byte by byte; first means least (doc_id, position). A blank
line (white space only) is always kept. A null text counts as empty: one blank line. Rows without doc_id are left out.
Rows that share a doc_id give one bitmap, as long as the longest of them, in which a position is kept if it is a first
occurrence in any of them; identical repeated rows thus count once. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import vec
from winnow.llm.common import forget, partitions, texts

_ROWS = "h bigint, g bigint, doc_id bigint, pos int"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i, b, offs in vec.chunks(batch.column(1)):
            s, e, row = vec.lines(b, offs)
            first = np.searchsorted(row, np.arange(len(offs) - 1))
            pos = np.arange(len(row)) - first[row]
            dense = np.append(0, np.cumsum(vec.BYTE_CLASS[b] != vec.SPACE))
            blank = dense[e] == dense[s]
            doc = ids[i + row]
            h, g = vec.Hasher(b)(s, e), vec.Hasher(b, 1)(s, e)
            own = vec.mix64(doc.astype(np.uint64) + vec.mix64(pos.astype(np.uint64)))  # a blank line meets no other
            h, g = np.where(blank, own, h), np.where(blank, np.uint64(0), g)
            order = np.lexsort((pos, doc, g, h))
            h, g, doc, pos = h[order], g[order], doc[order], pos[order]
            new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | ((g[1:] == 0) & (doc[1:] != doc[:-1])))[: len(h)]
            here = ids[i : i + len(offs) - 1]
            heads = vec.mix64(here.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h[new], heads]).view(np.int64)),
                    pa.array(np.concatenate([g[new], np.zeros(len(here), np.uint64)]).view(np.int64)),
                    pa.array(np.concatenate([doc[new], here])),
                    pa.array(np.concatenate([pos[new], -vec.counts_of_rows(row, len(here))]).astype(np.int32)),
                ],
                names=["h", "g", "doc_id", "pos"],
            )


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, those that open a hash, and the documents' own rows (pos < 0: minus the number of lines)."""
    last = (None, None)
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g, pos = (batch.column(k).to_numpy() for k in (0, 1, 3))
        new = np.append((h[0], g[0]) != last, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
        last = (h[-1], g[-1])
        yield batch.filter(pa.array(new | (g == 0))).select(["doc_id", "pos"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of kept and dropped lines of each document, from rows sorted by (doc_id, pos)."""
    doc, pos = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        doc = np.append(doc, batch.column(0).to_numpy())
        pos = np.append(pos, batch.column(1).to_numpy().astype(np.int64))
        whole = int(np.searchsorted(doc, doc[-1])) if len(doc) else 0  # the last document may go on
        if whole:
            yield _encode(doc[:whole], pos[:whole])
            doc, pos = doc[whole:], pos[whole:]
    if len(doc):
        yield _encode(doc, pos)


def _encode(doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    ids, first, n = np.unique(doc, return_index=True, return_counts=True)
    total = -pos[first]
    kept = pos >= 0
    d, p = np.repeat(np.arange(len(ids)), n)[kept], pos[kept]
    fresh = np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1]))[: len(d)]
    d, p = d[fresh], p[fresh]
    opens = np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1))[: len(d)]
    at = np.flatnonzero(opens)
    run_d, run_p, run_n = d[at], p[at], np.diff(np.append(at, len(d)))
    lo, out = np.searchsorted(run_d, np.arange(len(ids) + 1)), []
    for k, t in enumerate(total.tolist()):
        r, end = [], 0
        for a, m in zip(run_p[lo[k] : lo[k + 1]].tolist(), run_n[lo[k] : lo[k + 1]].tolist()):
            if a > end or not r and a:
                r += [0, a] if not r else [a - end]
            r.append(m)
            end = a + m
        if not r:
            r = [0, t]
        elif end < t:
            r.append(t - end)
        out.append(",".join(map(str, r)))
    got = np.bincount(d, minlength=len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total), pa.array(got), pa.array(out)], names=["doc_id", "n_lines", "n_kept", "keep_runs"])


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, keep_runs) of each document. keep_runs is the bitmap's run lengths, kept and dropped by turns,
    beginning with kept: "0,2,5" drops two lines and keeps five."""
    n = partitions(docs.sparkSession)
    rows = texts(docs).mapInArrow(_hashed, _ROWS)
    ranges = (F.shiftrightunsigned(F.col("h"), 40) * n / (1 << 24)).cast("int")
    first = rows.repartitionById(n, ranges).sortWithinPartitions("h", "g", "doc_id", "pos").mapInArrow(_first, "doc_id bigint, pos int")
    return first.repartition(n, "doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(_bitmaps, "doc_id bigint, n_lines bigint, n_kept bigint, keep_runs string")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("__runs").to_pylist()):
            if text is not None and runs is not None:
                lines, keep, at, kept = text.split("\n"), True, 0, []
                for n in map(int, runs.split(",")):
                    if keep:
                        kept += lines[at : at + n]
                    keep, at = not keep, at + n
                text = "\n".join(kept) if any(x.strip() for x in kept) or not text.strip() else None
                out.append((text, text is not None))
            else:
                out.append((text, True))
        col = pa.array([t for t, _ in out], pa.string())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", col).filter(pa.array([k for _, k in out], pa.bool_()))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs without the repeated lines; a document of which no line with content is left goes, one that had none stays.
    n_chars, where there is one, is counted anew. Rows without doc_id pass as they are."""
    marks = keep_bitmaps(docs).filter("n_kept < n_lines").select(F.col("doc_id").alias("__doc"), F.col("keep_runs").alias("__runs"))
    both = docs.join(marks, F.col("doc_id").cast("bigint") == F.col("__doc"), "left").drop("__doc")
    out = both.mapInArrow(_rebuilt, both.schema).drop("__runs")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(docs.columns)
