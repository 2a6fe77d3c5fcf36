"""Rounds, experiments, benchmarks and metrics by name, files and hooks, with stand-ins for models."""

import json
import logging
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from winnow.operators import analysis, extract, filters, metrics
from winnow.plans import generation
from winnow.plans.registry import BASELINES, BENCHMARKS, METRICS
from winnow.plans.rounds import Hooks, run_benchmarks, run_experiment, run_rounds
from winnow.sources import readers, writers
from winnow.streaming import pool as stream_pool

ROW = "key string, pos bigint, question string, answer string, score double, messages array<struct<role string, content string>>, images array<string>"


def samples(spark, n, start=0, kind="What objects are on table"):
    rows = [(f"k{i}", i, f"{kind} {i}?", f"answer {i}", 0.8 + i % 20 / 100, [("user", f"<image>{kind} {i}?"), ("assistant", f"answer {i}")], [f"{i}.jpg"]) for i in range(start, start + n)]
    return spark.createDataFrame(rows, ROW)


def test_rounds_with_stand_in_hooks(spark, tmp_path):
    kinds = ("How many cups", "Why is it", "What is to the left of", "What is the dog doing", "What does the sign say", "Which items")
    trained = []

    def generate(r, model):
        rows = samples(spark, 6, 100 * r)
        for k, kind in enumerate(kinds):
            rows = rows.union(samples(spark, 4, 1000 * (k + 1) + 100 * r, kind))
        return 60, rows

    hooks = Hooks(generate, lambda r, data, lora: trained.append((r, data, lora)) or f"adapter{r}", lambda r, adapter: f"model-{adapter}")
    history, why = run_rounds(spark, str(tmp_path), samples(spark, 30, 50_000, kinds[0]).union(samples(spark, 30, 60_000, kinds[1])), hooks, rounds=2, total=60)
    assert [h.round_id for h in history] == [0, 1] and why == "max-rounds" and [t[0] for t in trained] == [0, 1]
    assert all(h.generated == 60 and h.passed == 30 and h.pass_rate == 0.5 for h in history) and history[0].drift_from_prev is None
    for r in range(2):
        data = json.loads((tmp_path / f"round_{r}" / f"mixed_round_{r}.json").read_text())
        assert data and set(data[0]) == {"messages", "images"} and all(x["messages"][0]["role"] == "user" for x in data)
        assert json.loads((tmp_path / f"round_{r}" / "dataset_info.json").read_text())[f"mixed_round_{r}"]["formatting"] == "sharegpt"
    assert [m["round_id"] for m in readers.round_metrics(spark, str(tmp_path)).collect()] == [0, 1]
    pool = spark.read.parquet(str(tmp_path / "pool" / "round_1"))
    assert pool.count() > 0 and pool.agg(F.min("score")).first()[0] >= 0.85


def test_experiment(spark, tmp_path):
    spec = {"name": "e", "methods": [{"name": "no_filter", "params": {"n": 3}}, {"name": "short", "kind": "length_heuristic"}, {"name": "ours", "params": {"pool": "/none"}}]}
    pool = samples(spark, 8)
    evaluate = lambda model: [{"benchmark": "pope", "score": 0.5}]
    assert run_experiment(spark, spec, pool, lambda path: path + ".model", str(tmp_path), evaluate) == 1
    got = json.loads((tmp_path / "experiment.json").read_text())
    assert got["num_methods"] == 2 and [f["method"] for f in got["failed_methods"]] == ["ours"]
    assert len(json.loads((tmp_path / "no_filter" / "no_filter.json").read_text())) == 3
    assert {r["method"] for r in readers.runs(spark, str(tmp_path)).collect()} == {"no_filter", "short", "ours"}
    assert run_experiment(spark, spec, pool, lambda path: path, str(tmp_path / "b"), evaluate, ["short"]) == 0
    assert set(BASELINES) == {"no_filter", "clip_only", "length_heuristic", "random_k", "external_dataset", "ours"}


def test_all_benchmarks_through_the_runner(spark, tmp_path, caplog):
    df = spark.createDataFrame
    examples = {
        "gqa": df([("Cat.", "cat", "x"), ("dog", "cat", "")], "prediction string, gold string, category string"),
        "mmbench": df([("A", "A", ["A", "B"], "vis"), ("A", "B", ["A", "B"], "vis"), ("C", "C", ["C"], "ocr")], "prediction string, gold string, choices array<string>, category string"),
        "docvqa": df([("hello", ["hello"], ""), ("zzz", ["world"], "")], "prediction string, golds array<string>, category string"),
        "vqav2": df([("Cat.", ["cat", "cat", "dog"])], "prediction string, golds array<string>"),
        "pope": df([("yes", "yes" if i % 2 else "no") for i in range(10)], "prediction string, gold string"),
        "hallusion": df([("yes", "1", 1, 1, 1), ("no", "1", 1, 2, 1)], "prediction string, gold string, set_id int, question_id int, figure_id int"),
    }
    with caplog.at_level(logging.WARNING):
        got = {r["benchmark"]: r for r in run_benchmarks(examples, lambda d: d, [*BENCHMARKS, "unknown", {"name": "pope", "max_samples": 4}], str(tmp_path))}
    assert "unknown" in caplog.text and set(got) == set(examples) == set(BENCHMARKS)
    assert {k: round(v["score"], 4) for k, v in got.items()} == {"gqa": 0.5, "mmbench": 0.6667, "docvqa": 0.5, "vqav2": 0.6667, "pope": 0.5, "hallusion": 0.5}
    assert got["mmbench"]["sub_scores"] == {"vis": 0.5, "ocr": 1.0} and got["pope"]["num_samples"] == 4 and got["hallusion"]["sub_scores"]["q_acc"] == 0
    assert json.loads((tmp_path / "gqa.json").read_text())["num_samples"] == 2


def test_metrics_by_name_on_chat_rows(spark, tmp_path):
    chat = samples(spark, 12).drop("question", "answer").withColumn("cycle_scores", F.expr("struct(0.5D AS ar, 0.5D AS clip, 0.5D AS qr, 0.5D AS ppl, 0.7D AS composite)"))
    out = writers.report(chat, METRICS, ["diversity", "linguistic", "hallucination", "cycle_score_stats", "qa_type_stats", "none"], str(tmp_path))
    assert out["diversity"]["num_samples"] == 12 and out["diversity"]["distinct_1_q"] == 17 / 72 and 0 < out["diversity"]["self_bleu_4_q"] < 1
    assert out["linguistic"]["template_repeat_rate_q"] == 1.0 and out["linguistic"]["answer_length"]["mean"] == 2.0 and out["hallucination"] == {}
    assert {r["component"]: (r["count"], r["p50"]) for r in out["cycle_score_stats"]}["composite"] == (12, 0.7)
    assert {r["qa_type"]: r["n"] for r in out["qa_type_stats"]}["objects"] == 12 and out["none"] == {"status": "not_registered"}
    empty = {r["component"]: (r["count"], r["mean"]) for r in metrics.component_stats(chat.limit(0)).collect()}
    assert empty == {c: (0, None) for c in metrics.COMPONENTS}

    def faulty(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return (b.str.contains("1") for b in batches)

    assert metrics.grammar_error_rate(samples(spark, 4), faulty).first()[0] == 0.25


def test_chat_keeps_what_is_there(spark):
    kept = filters.to_chat(samples(spark, 2).withColumn("image_path", F.lit("other.jpg")).withColumn("messages", F.when(F.col("pos") == 0, F.col("messages")))).orderBy("pos").collect()
    assert kept[0]["images"] == ["0.jpg"] and kept[0]["messages"][0]["content"].startswith("<image>What")
    assert kept[1]["images"] == ["other.jpg"] and kept[1]["messages"][1]["role"] == "assistant"


def test_files_of_other_kinds(spark, tmp_path):
    t = pa.table({"a": [1, 2, 3], "b": ["x", None, "z"]})
    for name, new in (("one", pa.ipc.new_file), ("two", pa.ipc.new_stream)):
        with pa.OSFile(str(tmp_path / f"{name}.arrow"), "wb") as f, new(f, t.schema) as w:
            w.write_table(t)
    rows = readers.arrow(spark, str(tmp_path), "a bigint, b string")
    assert sorted(tuple(r) for r in rows.collect() if r["b"]) == [(1, "x"), (1, "x"), (3, "z"), (3, "z")]
    writers.convert_arrow(rows, str(tmp_path / "c.json"))
    assert len(json.loads((tmp_path / "c.json").read_text())) == 6 and not list(tmp_path.glob("*.parts*"))
    writers.write_json_array(rows.limit(0), str(tmp_path / "empty.json"))
    assert json.loads((tmp_path / "empty.json").read_text()) == []
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.PNG").write_bytes(b"1")
    (tmp_path / "img" / "a.txt").write_text("no")
    assert [r["content"] for r in readers.image_files(spark, str(tmp_path / "img")).collect()] == [b"1"]
    with pytest.raises(ValueError):
        readers.image_files(spark, str(tmp_path / "img" / "a.txt"))
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    assert readers.whole_text(spark, str(tmp_path / "t.txt")).first()["text"] == "one\ntwo\n"
    (tmp_path / "s.yaml").write_text("methods: [{name: a}]\nbenchmarks: [pope, {name: gqa, max_samples: 7}]\n")
    assert [b["max_samples"] for b in readers.spec(str(tmp_path / "s.yaml"), True)["benchmarks"]] == [20, 7]
    (tmp_path / "log.jsonl").write_text('{"loss": 2.5, "step": 1}\n{"eval": 1}\n{"loss": 1.5, "step": 2}\n')
    assert readers.training_losses(spark, str(tmp_path / "log.jsonl")) == (2.5, 1.5) and readers.training_losses(spark, str(tmp_path / "no")) == (0.0, 0.0)
    (tmp_path / "r.csv").write_text("pair_id,rater_1,rater_2\n0,A,b\n1,tie,A\n")
    rated, raters = readers.ratings(spark, str(tmp_path / "r.csv"))
    assert raters == ["rater_1", "rater_2"] and {r["label"]: r["n"] for r in analysis.win_rates(rated, raters).collect()} == {"a": 2, "b": 1, "tie": 1}
    sheet = writers.rating_sheet(samples(spark, 2), samples(spark, 2)).collect()
    assert [r["pair_id"] for r in sheet] == [0, 1] and sheet[0]["rater_1"] == ""
    table = spark.createDataFrame([("m_1", None)], "method string, b string")
    assert writers.markdown(table) == "| method | b |\n| --- | --- |\n| m_1 | -- |\n" and writers.comma_grid(table) == "method,b\nm_1,--\n" and r"m\_1 & --" in writers.latex(table)
    with pytest.raises(ValueError):
        writers.markdown(spark.range(writers.TABLE_ROWS + 1))
    writers.file_logger("w-test", str(tmp_path / "logs")).info("said")
    assert "said" in next((tmp_path / "logs").iterdir()).read_text()


def test_sweep_of_runs(spark, tmp_path):
    for name, score in (("theta_0p55", 0.5), ("theta_0p4", 0.4), ("other", 0.9)):
        writers.write_json({"method": name, "results": [{"benchmark": "pope", "score": score}]}, str(tmp_path / name / "run.json"))
    got = analysis.sweep(readers.sweep_results(spark, str(tmp_path))).collect()
    assert [(r["benchmark"], [tuple(x) for x in r["series"]]) for r in got] == [("pope", [(0.4, 0.4), (0.55, 0.5)])]


def test_fetching_survives_faults(spark):
    def fetch(address):
        if "bad" in address:
            raise OSError("no network")
        return b"data" if "none" not in address else None

    rows = spark.createDataFrame([("http://h/a.png",), ("http://h/bad.png",), ("http://h/none.gif",)], "src string")
    assert [(r["src"], r["content"]) for r in extract.fetched(rows, fetch).collect()] == [("http://h/a.png", b"data")]
    with pytest.raises(KeyError):
        generation.typed_prompt("odd")
    assert set(generation.TYPED) == set(r for r in ("objects", "spatial", "actions", "counting", "text_ocr", "reasoning"))


def test_pool_refreshed_by_a_stream(spark, tmp_path):
    schema = "key string, pos bigint, score double"
    for k, rows in enumerate(([("a", 1, 0.9), ("b", 2, 0.5)], [("a", 3, 0.95), ("c", 4, 0.99)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream_pool.refresh(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "pool"), str(tmp_path / "ck"))
        query.awaitTermination(120)
    got = {r["key"]: (r["score"], r["round_added"]) for r in spark.read.parquet(str(tmp_path / "pool" / "1")).collect()}
    assert got == {"a": (0.95, 1), "c": (0.99, 1)}
