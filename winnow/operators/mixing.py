"""Pools of samples: mixing by ratios, bounded upsert, rebalancing of question types, schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import text as T
from winnow.operators.dedup import keep_first


def scheduled(schedule: Sequence[float], round_id: int, default: float | None = 0.0) -> float:
    """The schedule's entry for the round; beyond its ends the nearest one."""
    if not schedule:
        if default is None:
            raise ValueError("an empty schedule")
        return default
    return schedule[min(max(round_id, 0), len(schedule) - 1)]


LORA = ((8, 16, 2e-4), (8, 16, 1e-4), (16, 32, 1e-4), (16, 32, 5e-5), (32, 64, 5e-5))


def lora_settings(round_id: int, table: Sequence[tuple[int, int, float]] = LORA) -> tuple[int, int, float]:
    return scheduled(table, round_id, None)


def _key(seed: int, key: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_exact(df: DataFrame, n: int, seed: int, key: str = "key") -> DataFrame:
    """n rows without replacement, or all if there are no more."""
    return df.orderBy(_key(seed, key), key).limit(max(0, n))


def mix_pools(new: DataFrame, original: DataFrame, historical: DataFrame, total: int, ratios: Sequence[float], seed: int, key: str = "key") -> DataFrame:
    """Samples of int(total * ratio) rows of the three pools, one row per key by priority new, original, historical, in a
    seeded order (`place`). The samples are taken before repeats are removed: the result may be smaller than total."""
    parts = []
    for k, (pool, ratio, add) in enumerate(zip((new, original, historical), ratios, (0, 0, 1))):
        parts.append(sample_exact(pool, int(total * ratio), seed + add, key).withColumn("pool", F.lit(("new", "original", "historical")[k])).withColumn("__p", F.lit(k)))
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    once = keep_first(both.withColumn("__o", F.struct("__p", _key(seed, key))), F.col(key), "__o").drop("__o", "__p")
    return once.withColumn("place", _key(seed, key))


def upsert_pool(existing: DataFrame, candidates: DataFrame, round_id: int, least: float = 0.85, size: int = 5000, key: str = "key", pos: str = "pos") -> DataFrame:
    """The pool after a round: candidates (key, pos, score) that reach `least` join; per key the higher score stays, of equals
    the row that was there; the best `size` rows, of equals the key that was there first."""
    old = existing.withColumn("__new", F.lit(0))
    if "round_added" not in candidates.columns:
        candidates = candidates.withColumn("round_added", F.lit(None).cast("int"))
    fresh = candidates.filter(F.col("score") >= least).withColumn("round_added", F.coalesce("round_added", F.lit(round_id))).withColumn("__new", F.lit(1))
    both = old.unionByName(fresh.select(old.columns) if set(old.columns) <= set(fresh.columns) else fresh, allowMissingColumns=True)
    w = Window.partitionBy(key)
    best = both.withColumn("__first", F.min(F.struct("__new", pos)).over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc("score"), "__new", pos))).filter("__n = 1")
    return best.orderBy(F.desc("score"), "__first", key).limit(size).drop("__new", "__first", "__n")


def caps(counts: dict[str, int], others: int, share: float) -> dict[str, int]:
    """How many rows each type may keep so that none exceeds `share`, by turns over the types until nothing changes."""
    now = {t: counts.get(t, 0) for t in T.QA_TYPES}
    while True:
        changed = False
        for t in T.QA_TYPES:
            rest = others + sum(n for k, n in now.items() if k != t)
            if now[t] and rest:
                most = max(1, int(share * rest / (1 - share) + 1e-9))
                if now[t] > most:
                    now[t], changed = most, True
        if not changed:
            return now


def rebalance(df: DataFrame, share: float = 0.40, seed: int = 0, key: str = "key", question: str = "question") -> DataFrame:
    """df with random rows of too frequent question types removed; rows without a question stay and count as others."""
    typed = df.withColumn("__type", F.when(F.coalesce(F.col(question), F.lit("")) != "", T.qa_type(F.col(question))))
    counts = {r[0]: r[1] for r in typed.groupBy("__type").count().collect()}  # seven rows at most
    allowed = caps({k: v for k, v in counts.items() if k}, counts.get(None, 0), share)
    most = F.coalesce(*[F.when(F.col("__type") == t, F.lit(n)) for t, n in allowed.items()], F.lit(0))
    ranked = typed.withColumn("__n", F.when(F.col("__type").isNotNull(), F.row_number().over(Window.partitionBy("__type").orderBy(_key(seed, key), key))))
    return ranked.filter(F.col("__type").isNull() | (F.col("__n") <= most)).drop("__type", "__n")
