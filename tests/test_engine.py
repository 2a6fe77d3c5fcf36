"""Behaviour of the engine's operators on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from winnow.functions import text as T
from winnow.operators import analysis, benchmarks, dedup, extract, grounded, metrics, mixing
from winnow.plans.registry import Registry
from winnow.plans.rounds import Round, should_stop
from winnow.sources import readers, writers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("q, kind", [("How many people are in the photo?", "counting"), ("What objects are on the table?", "objects"), ("Why is the umbrella open?", "reasoning"), ("What is to the left of the red car?", "spatial"), ("What is the woman doing?", "actions"), ("What does the sign say?", "text_ocr"), ("", "objects")])
def test_question_types(spark, q, kind):
    assert one(spark, T.qa_type(F.col("q")), q=q) == kind


def test_text_functions(spark):
    assert one(spark, T.normalise_answer(F.col("a")), a=" The  Cat. ") == "the cat"
    assert one(spark, T.first_line(F.col("a")), a="\n \r\n x \ny") == "x"
    assert one(spark, T.choice_letter(F.col("a"), F.array(F.lit("B"), F.lit("C"))), a="a is wrong, b") == "B"
    assert one(spark, T.pope_yes_no(F.col("a")), a="nothing") == "no" and one(spark, T.pope_yes_no(F.col("a")), a="maybe") is None
    assert one(spark, T.nls(F.col("a"), F.col("b")), a="hello", b="Hello ") == 1.0
    assert one(spark, T.numbers(F.col("a")), a="3/4 of 50% is 3") == ["3", "3/4", "50%"]
    assert one(spark, T.after_think(F.col("a")), a="x</think> y </think>z") == "y </think>z"
    assert one(spark, T.qa_pair(F.col("a")), a="Q: one?\nA: two").asDict() == {"question": "one?", "answer": "two"}
    assert one(spark, T.first_field(F.col("a"), F.col("b")), a=" ", b="x") == ""
    assert one(spark, T.shingles(F.col("a")), a="ab") == ["ab"] and one(spark, T.shingles(F.col("a")), a="abcab") == ["abc", "bca", "cab"]


def test_greedy_keeps_what_a_dropped_row_resembled(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id bigint")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint")
    assert {r[0] for r in dedup.greedy(nodes, pairs).collect()} == {1, 3, 4}


def test_text_dedup_against_brute_force(spark):
    r = np.random.default_rng(0)
    base = ["".join(chr(97 + x) for x in r.integers(0, 26, 120)) for _ in range(12)]
    texts = [t[:k] + "zz" + t[k + 1 :] for t in base for k in (0, 30, 60)] + [None, "", "ab", "ab", base[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string")
    sig = {r["id"]: np.array(r["signature"]) for r in dedup.signatures(df, "pos").collect()}
    kept = []
    for i in range(len(texts)):
        if not any((sig[i] == sig[k]).mean() >= 0.8 for k in kept):
            kept.append(i)
    assert sorted(r["pos"] for r in dedup.text_dedup(df).collect()) == kept
    assert dedup.text_dedup(df.limit(0)).count() == 0


def test_image_dedup(spark):
    df = spark.createDataFrame([(0, 0), (1, 0b1111111), (2, 0b11111111), (3, None)], "pos bigint, phash bigint")
    assert sorted(r["pos"] for r in dedup.image_dedup(df).collect()) == [0, 2]
    pixels = np.arange(72).reshape(8, 9)
    assert dedup.dhash(pixels) == 0 and dedup.dhash(pixels[:, ::-1]) == -1
    assert dedup.entropy(np.array([[0, 255]])) == 1.0 and dedup.sharpness(np.ones((4, 4))) == 0


def test_metrics(spark):
    same = spark.createDataFrame([("the cat sat on mat",)] * 10, "t string")
    assert metrics.distinct_n(same, "t", (2,)).first()["distinct_share"] == 0.1
    assert metrics.distinct_n(same.limit(0), "t", (2,)).first()["distinct_share"] == 0
    assert metrics._bleu("a b c d".split(), "a b c d".split()) == pytest.approx(1.0)
    assert metrics._one_way(["a"] * 10, 0.72) < metrics._one_way(list("abcdefghij"), 0.72)
    scored = spark.createDataFrame([((i / 100, i / 100, 0.5, 0.5, i / 100),) for i in range(101)], f"cycle_scores {readers.SCORES}")
    got = {(r["component"], r["percent"]): r["value"] for r in metrics.percentiles(scored).collect()}
    assert got["composite", 50] == 0.5 and got["composite", 90] == 0.9
    r = {(x["x"], x["y"]): x["r"] for x in metrics.pearson(scored).collect()}
    assert r["ar", "clip"] == pytest.approx(1) and r["ar", "qr"] == 0.0
    answers = spark.createDataFrame([(1, "i", "the table stands"), (2, "i", "")], "pos bigint, image_path string, answer string")
    total, per = metrics.chair(answers, spark.createDataFrame([("i", "table", True)], "image_path string, noun string, present boolean"))
    assert total.first()["chair_s"] == 1 and {x["noun"]: x["hallucinated"] for x in per.collect()} == {"table": 0, "stands": 1}


def test_pool_and_mixing(spark):
    schema = "key string, pos bigint, score double, round_added int"
    old = spark.createDataFrame([("k", 0, 0.86, 0), ("m", 1, 0.9, 0)], schema)
    new = spark.createDataFrame([("k", 5, 0.97, None), ("m", 6, 0.9, None), ("n", 7, 0.5, None)], schema)
    got = [(r["key"], r["score"], r["round_added"]) for r in mixing.upsert_pool(old, new, 1).collect()]
    assert got == [("k", 0.97, 1), ("m", 0.9, 0)]
    assert mixing.caps({"objects": 600, **{t: 50 for t in T.QA_TYPES if t != "objects"}}, 0, 0.4)["objects"] == 166
    assert mixing.scheduled((0.6, 0.5), 9) == 0.5 and mixing.scheduled((), 1) == 0.0
    with pytest.raises(ValueError):
        mixing.lora_settings(0, ())
    pool = spark.createDataFrame([("a", 1)] * 10, "key string, pos bigint")
    assert mixing.mix_pools(pool, pool, pool, 20, (0.5, 0.5, 0), 1).count() == 1


def test_verdicts(spark):
    raw = ['```json\n{"supported": "true", "error_type": "none", "reason": "ok"}\n```', 'so {"supported": true, "error_type": "odd"} end', "nothing", "[1]", '{"supported": true, "error_type": "none", "reason": "9 seen", "corrected_answer": ""}']
    df = spark.createDataFrame([(i, "Which?", "It is 3", x) for i, x in enumerate(raw)], "i int, question string, answer string, raw_output string")
    got = grounded.post_checked(grounded.parsed(df)).orderBy("i").collect()
    assert [r["supported"] for r in got] == [True, True, False, False, True]
    assert [r["error_type"] for r in got] == ["none", "other", "other", "other", "none"]
    assert got[0]["post_supported"] and not got[0]["manual_review"] and got[4]["review_reasons"] == ["answer_reason_numeric_mismatch"]


def test_benchmarks_and_tables(spark):
    said = spark.createDataFrame([("yes", "yes" if i % 2 else "no") for i in range(10)], "prediction string, gold string")
    r = benchmarks.yes_no(said).first()
    assert (r["accuracy"], r["recall"], r["yes_ratio"]) == (0.5, 1.0, 1.0)
    res = spark.createDataFrame([("full", "v", 0.8), ("drop_ar", "v", 0.7)], "method string, benchmark string, score double")
    assert {x["method"]: x["cell"] for x in analysis.ablation(res).collect()} == {"full": "0.800", "drop_ar": "0.700 (-0.100)"}
    with pytest.raises(ValueError):
        analysis.grid(res.union(res))
    k = analysis.kappa(spark.createDataFrame([("a", "a"), ("", "a"), ("b", "b")], "x string, y string"), "x", "y").first()
    assert (k["n"], k["kappa"]) == (2, 1.0)


def test_stop_rules():
    ok = dict(data_diversity_score=0.9, pass_rate=0.5, mean_cycle_score=0.8)
    h = lambda **k: [Round.of({"round_id": i} | ok | {a: b[i] for a, b in k.items()}) for i in range(3)]
    assert should_stop(h(pass_rate=[0.8, 0.6, 0.4]))[1] == "pass-rate-collapse"
    assert should_stop(h(mean_cycle_score=[0.8, 0.75, 0.7]))[1] == "cycle-score-decreasing"
    assert should_stop(h(data_diversity_score=[0.9, 0.9, 0.55]))[1] == "diversity-collapse"
    assert should_stop(h(drift_from_prev=[None, 0.1, 0.01]))[1] == "drift-converged"
    assert should_stop(h(), max_rounds=3)[1] == "max-rounds" and not should_stop([])[0]
    assert Round.of({"round_id": 1, "odd": 2}).extras == {"odd": 2}
    with pytest.raises(ValueError):
        r = Registry()
        r.add("x")(len)
        r.add("x")


def test_extraction():
    assert extract.packed(["a" * 250, "b" * 100, "c" * 400, "d" * 50]) == ["a" * 250 + " " + "b" * 100, "c" * 400 + " " + "d" * 50]
    assert extract.packed([]) == []
    p = extract._Images()
    p.feed("<img src='a.png'><p>next</p><figure><img src='b.png' alt='x'><figcaption>Cap</figcaption></figure><img src=''>")
    assert p.images("http://h/") == [("http://h/a.png", "next"), ("http://h/b.png", "Cap")]


def test_files(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"question": "a"}\n{broken\n\n{"question": "b"}\n')
    (tmp_path / "p.json").write_text('[{"question": "a"}, {"question": "b"}]')
    for f in ("p.jsonl", "p.json"):
        assert {r["question"] for r in readers.json_pool(spark, f"{tmp_path}/{f}").collect() if r["question"]} == {"a", "b"}
    assert readers.json_pool(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "g.json").write_text('{"7": {"question": "q"}}')
    assert readers.json_by_key(spark, f"{tmp_path}/g.json", "struct<question string>").first().asDict() == {"question_id": "7", "question": "q"}
    (tmp_path / "dataset_info.json").write_text("{broken")
    writers.register_dataset(spark.createDataFrame([("x",)], "question string"), "d", str(tmp_path))
    assert json.loads((tmp_path / "dataset_info.json").read_text())["d"]["file_name"] == "d.json"
    assert writers.report(spark.range(3), {"n": lambda d: d.count(), "bad": lambda d: 1 / 0}, ["n", "bad", "no"]) == {"n": 3, "bad": {"error": "ZeroDivisionError: division by zero"}, "no": {"status": "not_registered"}}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_attach_answers_at_one_pos(spark):
    notes = spark.createDataFrame([(1, 2, "b", 7), (1, 2, "a", 3), (1, 1, "c", 0), (2, 1, "d", 0)], "question_id int, pos int, last string, row int")
    got = benchmarks.attach_answers(spark.createDataFrame([(1,), (3,)], "question_id int"), notes, ties=("row",))
    assert [tuple(r) for r in got.collect()] == [(1, "a")]


def test_attach_answers_query_is_its_sql(spark):
    import duckdb

    from winnow import queries

    d, c = "/root/testdata/sf0.1", duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = sorted(c.execute(queries.SQL["j1_attach_answers"]).fetchall())
    assert sorted((r[0], r[1]) for r in queries.QUERIES["j1_attach_answers"](spark, d).collect()) == want


def test_csv_texts_query_keeps_white_space(spark, tmp_path):
    import hashlib

    from winnow import queries

    texts = [" a ", "\na\n", "a\t", "\n", " ", "\r", 'a"', "a\\", "a\r\nb", "a,b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: r[1] for r in queries.QUERIES["s6_csv_texts"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5(t.encode()).hexdigest() for k, t in enumerate(texts)}
