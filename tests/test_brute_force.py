"""Operators that SQL cannot express, against plain Python written from their definitions."""

import hashlib
import math
import re

import numpy as np
import pytest

from winnow.operators import dedup, extract, metrics

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").filter("doc_id < 60").select("doc_id", "text")


def kept_in_turn(ids, similar):
    """Greedy: a row goes if it is similar to an earlier one that stayed."""
    kept = []
    for i in ids:
        if not any(similar(i, k) for k in kept):
            kept.append(i)
    return kept


def signature(text):
    t = (text or "").strip()
    grams = {t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else {t}
    return [min(int(hashlib.md5(f"{i}_{g}".encode()).hexdigest(), 16) & 0xFFFFFFFF for g in grams) for i in range(128)]


def test_signatures_and_text_dedup(spark, docs):
    rows = [(r.doc_id, r.text[:400]) for r in docs.orderBy("doc_id").limit(25).collect()]
    rows += [(100, rows[0][1][:390]), (101, rows[3][1] + " and"), (102, None), (103, ""), (104, "ab"), (105, "a\nb\n\nc"), (106, rows[0][1])]
    df = spark.createDataFrame(rows, "pos bigint, text string")
    want = {i: signature(t) for i, t in rows}
    assert {r["id"]: list(r["signature"]) for r in dedup.signatures(df, "pos").collect()} == want
    same = lambda i, k: sum(a == b for a, b in zip(want[i], want[k])) >= 0.8 * 128
    left = kept_in_turn(sorted(want), same)
    assert sorted(r["pos"] for r in dedup.text_dedup(df).collect()) == left and len(left) < len(want) - 2


def test_image_dedup_and_composed_cleaning(spark):
    r = np.random.default_rng(0)
    base = r.integers(-(2**63), 2**63, 30)
    hashes = [int(h) for b in base for h in (b, b ^ np.int64(int(sum(1 << int(k) for k in r.choice(62, r.integers(1, 12), replace=False)))))]
    df = spark.createDataFrame(list(enumerate(hashes)), "pos bigint, phash bigint")
    near = lambda i, k: bin((hashes[i] ^ hashes[k]) & (2**64 - 1)).count("1") < 8
    want = kept_in_turn(range(len(hashes)), near)
    assert sorted(x["pos"] for x in dedup.image_dedup(df).collect()) == want and 30 < len(want) < 60
    rows = [(i, h, f"text number {i} " * 3 if i % 4 else "short", 200.0 if i % 5 else 1.0, 7.0) for i, h in enumerate(hashes)]
    out, counts = dedup.clean(spark.createDataFrame(rows, "pos bigint, phash bigint, source_text string, blur double, entropy double"))
    sig = {i: signature(rows[i][2]) for i in want}
    texts = kept_in_turn(want, lambda i, k: sum(a == b for a, b in zip(sig[i], sig[k])) >= 0.8 * 128)
    last = [i for i in texts if len(rows[i][2]) >= 20 and rows[i][3] >= 100]
    assert sorted(x["pos"] for x in out.collect()) == last
    assert counts == {"input": 60, "image_dedup": len(want), "text_dedup": len(texts), "quality": len(last)}


def words(t):
    return re.findall(r"[^\W]+", t.lower())


def one_way(tokens):
    factors, start = 0.0, 0
    for i in range(len(tokens)):
        part = tokens[start : i + 1]
        if len(set(part)) / len(part) <= 0.72:
            factors, start = factors + 1, i + 1
    part = tokens[start:]
    if part:
        factors += (1 - len(set(part)) / len(part)) / (1 - 0.72)
    return len(tokens) / factors if factors else len(tokens)


def test_mtld(spark, docs):
    rows = [r.text for r in docs.collect()] + ["", " ", None, "one", "a a a a"]
    got = metrics.mtld(spark.createDataFrame([(t,) for t in rows], "t string"), "t").first()[0]
    each = [(one_way(w) + one_way(w[::-1])) / 2 if len(w := words(t)) > 1 else 0.0 for t in rows if t and t.strip()]
    assert got == pytest.approx(sum(each) / len(each), rel=1e-9)


def bleu(hyp, ref):
    if len(hyp) < 4 or not ref:
        return 0.0
    total = 0.0
    for n in range(1, 5):
        grams = lambda x: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]  # noqa: B023, E731
        left, hits = grams(ref), 0
        for g in grams(hyp):
            if g in left:
                left.remove(g)
                hits += 1
        total += 0.25 * math.log((hits + 1e-9) / (len(grams(hyp)) + 1e-9) if hits else 1e-9)
    return math.exp(total + min(0.0, 1 - len(ref) / len(hyp)))


def test_self_bleu_of_drawn_pairs(spark, docs):
    rows = [(r.doc_id, r.text[:300]) for r in docs.orderBy("doc_id").collect()] + [(1000, "  "), (1001, None)]
    got = metrics.self_bleu(spark.createDataFrame(rows, "pos bigint, t string"), "t", sample=40).first()[0]
    full = [words(t) for _, t in sorted(rows) if t and t.strip()]
    n = len(full)
    draw = lambda tag, k, m: int(hashlib.md5(f"0:{tag}:{k}".encode()).hexdigest()[:12], 16) % m
    pairs = [(i := draw("i", k, n), (i + 1 + draw("j", k, n - 1)) % n) for k in range(40)]
    assert got == pytest.approx(sum(bleu(full[i], full[j]) for i, j in pairs) / 40, rel=1e-6)


def test_chunks_hold_the_sentences_in_order(spark, docs):
    got = {}
    for r in extract.chunks(docs).orderBy("doc_id", "n").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    for r in docs.collect():
        parts = [s.strip() for s in re.split(r"(?<=[。！？；?!])\s*|\n+", r["text"])]
        parts = [s for s in parts if s]
        assert " ".join(parts) == " ".join(got.get(r["doc_id"], []))
        for a, b in zip(got.get(r["doc_id"], []), got.get(r["doc_id"], [])[1:]):
            assert len(a) >= 300 and (len(b) >= 200 or len(a) + len(b) > 800)


def test_text_dedup_in_stretches(spark):
    r = np.random.default_rng(3)
    base = ["".join(chr(97 + x) for x in r.integers(0, 26, 60)) for _ in range(6)]
    texts = []
    for _ in range(240):
        t = list(base[r.integers(6)])
        for k in r.choice(60, r.integers(0, 5), replace=False):
            t[k] = "z"
        texts.append("".join(t))
    ids = [int(x) for x in r.permutation(10_000)[:240]]
    sig = {i: np.array(signature(t)) for i, t in zip(ids, texts)}
    left = kept_in_turn(sorted(ids), lambda i, k: (sig[i] == sig[k]).mean() >= 0.8)
    df = spark.createDataFrame(list(zip(ids, texts)), "pos bigint, text string")
    for first, small in ((1000, 2048), (10, 4)):  # one stretch in one block; five stretches, whose rows go to eight blocks
        with pytest.MonkeyPatch.context() as m:
            m.setattr(dedup, "SMALL", small)
            assert sorted(x["pos"] for x in dedup.text_dedup(df, first=first).collect()) == left
    assert 20 < len(left) < 220


def test_sketches_leave_out_no_similar_pair():
    r = np.random.default_rng(4)
    x = r.integers(0, 2**32, (50, 128), np.uint32)
    y = x.copy()
    for k, row in enumerate(y):
        row[r.choice(128, k // 2, replace=False)] ^= np.uint32(1) << np.uint32(k % 32)  # 0 to 24 numbers differ, by one bit
    a, b, found = (np.concatenate(c) for c in zip(*dedup._close(dedup._sketch(x), dedup._sketch(y), 25)))
    assert {(k, k) for k in range(50)} <= set(zip(a.tolist(), b.tolist())) and (found <= 25).all()


def test_clean_writes_no_text(spark, monkeypatch):
    written = []
    monkeypatch.setattr(dedup, "cut", lambda d, real=dedup.cut: (written.append(d.columns), real(d))[1])
    rows = [(i, i, f"a text of the number {i * i}", 200.0, 7.0) for i in range(6)]
    out, counts = dedup.clean(spark.createDataFrame(rows, "pos bigint, phash bigint, source_text string, blur double, entropy double"))
    assert "source_text" in out.columns and counts["input"] == 6 and written and not any("source_text" in c for c in written)


def test_signatures_across_lookups(spark, monkeypatch):
    monkeypatch.setattr(dedup, "_ROWS", 2)
    monkeypatch.setattr(dedup, "_SHINGLES", 5)
    monkeypatch.setattr(dedup, "_KNOWN", {})
    import pyarrow as pa

    texts = ["abcdef", "abcabc", "xyz", "defabcxyz", "q"]
    grams = [sorted({t[i : i + 3] for i in range(len(t) - 2)}) or [t] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(grams)], names=["id", "shingles"])
    got = list(dedup._minhashes(iter([batch.slice(0, 3), batch.slice(3)])))
    assert [b.num_rows for b in got] == [2, 1, 2]  # a few rows at a time, not the batch
    assert np.concatenate([dedup._matrix(b.column(1)) for b in got]).tolist() == [signature(t) for t in texts]
