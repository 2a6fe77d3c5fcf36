"""The controller of training rounds: external hooks generate, train and merge; everything between is DataFrames.

A round's inputs are cut before they are used twice, the pool is written to a new folder each round and never overwritten
while it is read, so a lost executor costs a recomputation of one round at most.
"""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import text as T
from winnow.operators import filters
from winnow.operators import metrics as M
from winnow.operators import mixing
from winnow.operators.order import cut
from winnow.plans import baselines as _registered  # noqa: F401
from winnow.plans.registry import BASELINES, BENCHMARKS
from winnow.sources import readers
from winnow.sources.writers import register_dataset, write_json
from winnow.sources.writers import _small as small

log = logging.getLogger(__name__)


@dataclass
class Round:
    round_id: int
    generated: int = 0
    passed: int = 0
    pass_rate: float = 0.0
    mean_cycle_score: float = 0.0
    data_diversity_score: float = 0.0
    drift_from_prev: float | None = None
    timestamp: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    extras: dict = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict) -> Round:
        """Unknown keys go to extras."""
        own = {k: v for k, v in values.items() if k in cls.__dataclass_fields__}
        return cls(**own | {"extras": dict(own.get("extras") or {}) | {k: v for k, v in values.items() if k not in own}})


def should_stop(history: Sequence[Round], max_rounds: int = 5, patience: int = 2, least_diversity: float = 0.6, least_drift: float = 0.02, drop: float = 0.15) -> tuple[bool, str]:
    """(stop, why), by the first rule that holds: rounds used up, diversity collapsed, drift converged (not in round 0), then,
    over the last patience + 1 rounds, pass rate dropping each time by more than `drop`, mean score falling each time."""
    if not history:
        return False, "healthy"
    last = history[-1]
    if len(history) >= max_rounds:
        return True, "max-rounds"
    if last.data_diversity_score < least_diversity:
        return True, "diversity-collapse"
    if last.round_id >= 1 and last.drift_from_prev is not None and last.drift_from_prev < least_drift:
        return True, "drift-converged"
    if len(history) > patience:
        tail = history[-patience - 1 :]
        if all(a.pass_rate - b.pass_rate > drop for a, b in zip(tail, tail[1:])):
            return True, "pass-rate-collapse"
        if all(a.mean_cycle_score > b.mean_cycle_score for a, b in zip(tail, tail[1:])):
            return True, "cycle-score-decreasing"
    return False, "healthy"


@dataclass
class Hooks:
    """generate(round, model) -> (number generated, passed rows with key, pos, question, score, messages, images); train and merge -> paths."""

    generate: Callable[[int, str], tuple[int, DataFrame]]
    train: Callable[[int, str, tuple[int, int, float]], str]
    merge: Callable[[int, str], str]


def run_rounds(spark: SparkSession, folder: str, original: DataFrame, hooks: Hooks, base: str = "base", rounds: int = 5, total: int = 2000, ratios: Sequence[Sequence[float]] = ((0.6, 0.6, 0.5), (0.3, 0.2, 0.2), (0.1, 0.2, 0.3)), max_share: float = 0.40, pool_size: int = 5000, pool_least: float = 0.85) -> tuple[list[Round], str]:
    """Rounds of generate, mix, rebalance, export, train from the base model, merge, measure, refresh the pool; stops early."""
    history: list[Round] = []
    before: DataFrame | None = None
    pool = spark.createDataFrame([], original.schema)
    pool = pool.withColumn("round_added", F.lit(None).cast("int")) if "round_added" not in pool.columns else pool
    model, why = base, "max-rounds"
    for r in range(rounds):
        made, passed = hooks.generate(r, model)
        passed = cut(passed)
        share = [mixing.scheduled(s, r) for s in ratios]
        mixed = cut(mixing.rebalance(mixing.mix_pools(passed, original, pool, total, share, r), max_share, r))
        at = os.path.join(folder, f"round_{r}")
        data = register_dataset(mixed.orderBy("place").select("messages", "images"), f"mixed_round_{r}", at)
        adapter = hooks.train(r, data, mixing.lora_settings(r))
        model = hooks.merge(r, adapter)
        types = cut(M.type_distribution(mixed))
        n = passed.count()
        now = Round(r, made, n, n / made if made else 0.0, float(passed.agg(F.avg("score")).first()[0] or 0.0), float(M.type_diversity(types).first()[0]), None if before is None else float(M.drift(types, before).first()[0]))
        write_json(asdict(now), os.path.join(at, "metrics.json"))
        before = types
        pool_at = os.path.join(folder, "pool", f"round_{r}")
        mixing.upsert_pool(pool, passed, r, pool_least, pool_size).write.mode("overwrite").parquet(pool_at)
        pool = spark.read.parquet(pool_at)
        history.append(now)
        stop, why = should_stop(history, rounds)
        if stop:
            break
    return history, why


def run_method(spark: SparkSession, method: dict, pool: DataFrame, train: Callable[[str], str], folder: str, evaluate: Callable[[str], list[dict]]) -> dict:
    """Prepares a baseline's data, trains and evaluates; a failure is reported in the run, not raised."""
    name, took = method["name"], {}
    run: dict = {"method": name, "results": []}
    try:
        t = time.perf_counter()
        data = BASELINES[method.get("kind") or name](pool, **(method.get("params") or {}))
        path = register_dataset(filters.to_chat(data).select("messages", "images"), name, os.path.join(folder, name))
        took["prep_sec"], t = time.perf_counter() - t, time.perf_counter()
        model = train(path)
        took["train_sec"], t = time.perf_counter() - t, time.perf_counter()
        run["results"] = evaluate(model)
        took["eval_sec"] = time.perf_counter() - t
    except Exception as e:  # noqa: BLE001
        run["error"] = f"{type(e).__name__}: {e}"[:500]
    write_json(run | took, os.path.join(folder, name, "run.json"))
    return run | took


def run_benchmarks(examples: dict[str, DataFrame], infer: Callable[[DataFrame], DataFrame], wanted: Sequence[str | dict], folder: str | None = None) -> list[dict]:
    """[{benchmark, score, num_samples, sub_scores}] of the wanted benchmarks; a dict may give max_samples beside its name. One that
    is not registered, or has no examples, is skipped with a warning. With a folder each result is written there too."""
    out = []
    for w in wanted:
        w = {"name": w} if isinstance(w, str) else w
        name = w["name"]
        if name not in BENCHMARKS or name not in examples:
            log.warning("benchmark %s is skipped: %s", name, "no examples" if name in BENCHMARKS else "not registered")
            continue
        rows = examples[name].limit(w["max_samples"]) if w.get("max_samples") else examples[name]
        got = {r["category"]: r.asDict() for r in small(BENCHMARKS[name](infer(rows)))}
        if "all" in got:
            whole = got.pop("all")
            more = {k: v for k, v in whole.items() if k not in ("category", "n", "score")} | {k: v["score"] for k, v in got.items()}
            out.append({"benchmark": name, "score": whole["score"], "num_samples": whole["n"], "sub_scores": more})
            if folder:
                write_json(out[-1], os.path.join(folder, f"{name}.json"))
    return out


def run_experiment(spark: SparkSession, spec: dict, pool: DataFrame, train: Callable[[str], str], folder: str, evaluate: Callable[[str], list[dict]], only: Sequence[str] = ()) -> int:
    """Runs the spec's methods one after another and writes experiment.json; 1 if any failed, else 0. A failed method stops none."""
    methods = [m for m in spec["methods"] if not only or m["name"] in only]
    runs = [run_method(spark, m, pool, train, folder, evaluate) for m in methods]
    failed = [{"method": r["method"], "error": r["error"]} for r in runs if "error" in r]
    write_json({"experiment": spec.get("name", ""), "num_methods": len(runs) - len(failed), "failed_methods": failed}, os.path.join(folder, "experiment.json"))
    return int(bool(failed))


def ours(spark: SparkSession, round_data: str | None = None, filtered_pool: str | None = None, pool: str | None = None, round_id: int = 0) -> DataFrame:
    """Our own method's data: the given round's file, else the filtered pool, else the pool folder's mixed file."""
    for path in (round_data, filtered_pool, pool and os.path.join(pool, f"round_{round_id}", f"mixed_round_{round_id}.json")):
        if path and readers.exists(spark, path):
            return readers.json_pool(spark, path)
    raise ValueError("none of round_data, filtered_pool and pool is there")


def heavy_hooks_skipped() -> bool:
    """Whether the environment asks for runs without models: the callers' hooks should then be stand-ins."""
    return os.environ.get("CI_SKIP_HEAVY") == "1"


def question_of(messages: str = "messages", question: str = "question") -> F.Column:
    """The user's turn, else the question; without image marks."""
    user = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]
    return T.strip(F.regexp_replace(F.coalesce(F.nullif(user, F.lit("")), F.col(question)), r"<image>\s*", ""))
