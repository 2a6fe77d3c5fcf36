"""Dataset metrics: diversity, score statistics, language, hallucination, alignment. Empty input gives 0, not null, where a share or mean is asked for."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import text as T
from winnow.operators.order import cut, numbered

COMPONENTS = ("ar", "clip", "qr", "ppl", "composite")


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def type_distribution(df: DataFrame, question: str = "question") -> DataFrame:
    """(qa_type, n, share) for all six types, of rows that have a question."""
    types = df.sparkSession.createDataFrame([(t,) for t in T.QA_TYPES], "qa_type string")
    n = df.filter(F.coalesce(F.col(question), F.lit("")) != "").groupBy(T.qa_type(F.col(question)).alias("qa_type")).agg(F.count("*").alias("n"))
    full = types.join(n, "qa_type", "left").na.fill(0, ["n"])
    return full.crossJoin(full.agg(F.sum("n").alias("total"))).select("qa_type", "n", _or0(F.try_divide(F.col("n"), F.col("total"))).alias("share"))  # six rows by one


def type_diversity(distribution: DataFrame) -> DataFrame:
    """Entropy of the shares, 1 for an even spread."""
    p = F.col("share")
    return distribution.agg(_or0(-F.sum(F.when(p > 0, p * F.ln(p))) / math.log(len(T.QA_TYPES))).alias("diversity"))


def under_represented(distribution: DataFrame, below: float = 0.05) -> DataFrame:
    return distribution.filter(F.col("share") < below)


def drift(now: DataFrame, before: DataFrame) -> DataFrame:
    both = now.select("qa_type", F.col("share").alias("p")).join(before.select("qa_type", F.col("share").alias("q")), "qa_type", "full")
    return both.agg(_or0(F.sum(F.abs(_or0(F.col("p")) - _or0(F.col("q")))) / 2).alias("drift"))


def js_divergence(p: DataFrame, q: DataFrame, key: str = "qa_type") -> DataFrame:
    """Jensen-Shannon divergence in nats; a key that one side lacks counts 0 there."""
    both = p.select(key, F.col("share").alias("p")).join(q.select(key, F.col("share").alias("q")), key, "full").select(_or0(F.col("p")).alias("p"), _or0(F.col("q")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(0.0)
    return both.agg(_or0(F.sum(part("p") + part("q")) / 2).alias("js"))


def long_scores(df: DataFrame, scores: str = "cycle_scores") -> DataFrame:
    """(component, value) of the scores that are numbers."""
    pairs = F.array(*[F.struct(F.lit(c).alias("component"), F.expr(f"try_cast({scores}.{c} AS double)").alias("value")) for c in COMPONENTS])
    return df.select(F.explode(pairs).alias("x")).select("x.*").filter("value IS NOT NULL AND NOT isnan(value)")


def score_summary(df: DataFrame) -> DataFrame:
    return long_scores(df).groupBy("component").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def percentiles(df: DataFrame, points: Sequence[int] = (25, 50, 75, 90, 95, 99)) -> DataFrame:
    """(component, percent, value): the value at place round((percent / 100) (n - 1)), halves to even."""
    rows = long_scores(df)
    counted = rows.groupBy("component", "value").agg(F.count("*").alias("m"))
    w = Window.partitionBy("component").orderBy("value")
    ends = counted.withColumn("hi", F.sum("m").over(w)).withColumn("n", F.sum("m").over(Window.partitionBy("component")))
    want = ends.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in points]))).withColumn("at", F.bround(F.col("percent") / 100 * (F.col("n") - 1)) + 1)
    return want.filter((F.col("at") <= F.col("hi")) & (F.col("at") > F.col("hi") - F.col("m"))).select("component", "percent", "value")


def histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """(component, bin, n) of equal bins between least and greatest; one bin if they are equal."""
    rows = long_scores(df)
    ends = rows.groupBy("component").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("value") - F.col("lo"), w)), F.lit(bins - 1))).cast("int")
    return rows.join(F.broadcast(ends), "component").groupBy("component", at.alias("bin")).agg(F.count("*").alias("n"))  # five rows


def pearson(df: DataFrame, scores: str = "cycle_scores") -> DataFrame:
    """(x, y, r) of all component pairs over rows where all five are numbers; 0 without variance."""
    cols = [F.expr(f"try_cast({scores}.{c} AS double)").alias(c) for c in COMPONENTS]
    rows = df.select(*cols).na.drop()
    out = []
    for x in COMPONENTS:
        for y in COMPONENTS:
            cov, var = F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)
            out.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.when((F.count("*") < 2) | (F.stddev_pop(x) < 1e-12) | (F.stddev_pop(y) < 1e-12), 0.0).otherwise(_or0(F.try_divide(cov, var))).alias("r")))
    return rows.agg(F.array(*out).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def pass_rates(df: DataFrame, thresholds: Sequence[float] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    rows = long_scores(df).filter("component = 'composite'")
    one = rows.agg(*[_or0(F.avg((F.col("value") >= t).cast("double"))).alias(f"t{k}") for k, t in enumerate(thresholds)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f"{t:.2f}").alias("threshold"), F.col(f"t{k}").alias("pass_rate")) for k, t in enumerate(thresholds)])).alias("e")).select("e.*")


def by_type(df: DataFrame, least: float = 0.7) -> DataFrame:
    s = F.col("cycle_scores.composite")
    return df.filter(s.isNotNull()).groupBy(T.qa_type(F.col("question")).alias("qa_type")).agg(F.count("*").alias("n"), F.avg(s).alias("mean_composite"), F.avg((s >= least).cast("double")).alias("pass_rate"))


def distinct_n(df: DataFrame, text: str, orders: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(n, distinct_share): distinct n-grams of all texts over all of them, n below 8; none crosses a text.

    One scan hashes each text's words; grams are hashes of neighbouring hashes, with n in their lowest bits, so no gram is
    shuffled as text. Of 1e10 distinct grams about 40 share their 61 bits with another.
    """
    w = df.select(F.transform(T.words(F.col(text)), lambda x: F.xxhash64(x)).alias("w"))
    many = lambda n: F.greatest(F.size("w") - (n - 1), F.lit(0))

    def of_order(n: int) -> Column:
        g = F.slice("w", 1, many(n))
        for k in range(1, n):
            g = F.zip_with(g, F.slice("w", k + 1, many(n)), lambda x, y: F.xxhash64(x, y))
        return F.transform(g, lambda x: F.shiftleft(x, 3).bitwiseOR(F.lit(n).cast("bigint")))

    grams = w.select(F.explode(F.flatten(F.array(*[of_order(n) for n in orders]))).alias("g"))
    got = grams.groupBy("g").agg(F.count("*").alias("m")).groupBy(F.col("g").bitwiseAND(F.lit(7)).cast("int").alias("n")).agg((F.count("*") / F.sum("m")).alias("distinct_share"))
    return df.sparkSession.createDataFrame([(n,) for n in orders], "n int").join(got, "n", "left").na.fill(0.0)


def type_token_ratio(df: DataFrame, text: str) -> DataFrame:
    return distinct_n(df, text, (1,)).select(F.col("distinct_share").alias("ttr"))


def length_stats(df: DataFrame, text: str) -> DataFrame:
    n = F.size(T.words(F.col(text), lower=False))
    return df.filter(F.col(text).isNotNull()).agg(F.count("*").alias("n"), _or0(F.avg(n)).alias("mean"), _or0(F.stddev_pop(n)).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"))


def _one_way(tokens: list[str], threshold: float) -> float:
    factors, seen, n = 0.0, set(), 0
    for t in tokens:
        seen.add(t)
        n += 1
        if len(seen) <= threshold * n + 1e-12:
            factors, seen, n = factors + 1, set(), 0
    if n:
        factors += (1 - len(seen) / n) / (1 - threshold)
    return len(tokens) / factors if factors else float(len(tokens))


def mtld(df: DataFrame, text: str, threshold: float = 0.72) -> DataFrame:
    """One row: the mean over non-empty texts of the lexical-diversity length, forwards and backwards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"v": [(_one_way(list(w), threshold) + _one_way(list(w)[::-1], threshold)) / 2 if len(w) > 1 else 0.0 for w in b["w"]]})

    rows = df.filter(T.has_text(F.col(text))).select(T.words(F.col(text)).alias("w"))
    return rows.mapInPandas(run, "v double").agg(_or0(F.avg("v")).alias("mtld"))


def sampled_pairs(n: int, pairs: int, seed: int = 0):
    """(i, j), j other than i, numbered from 1: places drawn by md5, the same in any engine."""
    draw = lambda tag, k: F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:{tag}:"), F.col("id").cast("string"))), F.lit(12)), 16, 10).cast("bigint") % k
    i = draw("i", n)
    return lambda spark: spark.range(pairs).select((i + 1).alias("i"), ((i + 1 + draw("j", max(n - 1, 1))) % n + 1).alias("j"))


def _drawn(df: DataFrame, pos: str, sample: int, seed: int) -> tuple[DataFrame, DataFrame] | None:
    """(pairs (i, j), places (__p, __n) of the rows that they name), None for fewer than two rows. Only the places are numbered; of
    the rows themselves 2 x sample at most are read further, met by a broadcast of so many numbers."""
    places = numbered(df.select(F.col(pos).alias("__p")), [F.col("__p")], "__n")
    n = places.count()
    if n < 2:
        return None
    pairs = sampled_pairs(n, min(sample, n * (n - 1)), seed)(df.sparkSession)
    wanted = pairs.select(F.col("i").alias("__n")).union(pairs.select("j")).distinct()
    ids = cut(places.join(F.broadcast(wanted), "__n").select("__p", "__n"))
    return pairs, F.broadcast(ids)


def _bleu(hyp: list[str], ref: list[str]) -> float:
    if len(hyp) < 4 or not ref:
        return 0.0
    log = 0.0
    for n in range(1, 5):
        h, r = (Counter(zip(*[x[k:] for k in range(n)])) for x in (hyp, ref))
        both = sum(min(m, r[g]) for g, m in h.items())
        total = sum(h.values())
        log += 0.25 * math.log((both + 1e-9) / (total + 1e-9) if both else 1e-9)
    return math.exp(log + (0.0 if len(hyp) > len(ref) else 1 - len(ref) / len(hyp)))


def self_bleu(df: DataFrame, text: str, pos: str = "pos", sample: int = 200, seed: int = 0) -> DataFrame:
    """One row: mean BLEU-4 of sampled pairs of texts; 0 for fewer than two."""
    full = df.filter(T.has_text(F.col(text)))
    drawn = _drawn(full, pos, sample, seed)
    if drawn is None:
        return df.sparkSession.createDataFrame([(0.0,)], "self_bleu double")
    pairs, ids = drawn
    rows = full.join(ids, F.col(pos) == F.col("__p"), "inner").select("__n", T.words(F.col(text)).alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"v": [_bleu(list(x), list(y)) for x, y in zip(b["x"], b["y"])]})

    both = pairs.join(rows.select(F.col("__n").alias("i"), F.col("w").alias("x")), "i").join(rows.select(F.col("__n").alias("j"), F.col("w").alias("y")), "j")
    return both.select("x", "y").mapInPandas(run, "v double").agg(_or0(F.avg("v")).alias("self_bleu"))


def embedding_spread(df: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = 1000, seed: int = 0) -> DataFrame:
    """One row: mean of 1 - cosine over sampled pairs of vectors; 0 for fewer than two."""
    drawn = _drawn(df, key, sample, seed)
    if drawn is None:
        return df.sparkSession.createDataFrame([(0.0,)], "spread double")
    pairs, ids = drawn
    rows = df.join(ids, F.col(key) == F.col("__p"), "inner").select("__n", F.col(vector).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    x, y = F.col("x"), F.col("y")
    both = pairs.join(rows.select(F.col("__n").alias("i"), F.col("v").alias("x")), "i").join(rows.select(F.col("__n").alias("j"), F.col("v").alias("y")), "j")
    return both.agg(_or0(F.avg(1 - dot(x, y) / ((F.sqrt(dot(x, x)) + 1e-9) * (F.sqrt(dot(y, y)) + 1e-9)))).alias("spread"))


def chair(answers: DataFrame, presence: DataFrame, key: str = "pos", image: str = "image_path", answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(one row chair_i, chair_s, answers, mentions; per noun): nouns of answers that the image does not show. A noun that
    presence (image_path, noun, present) lacks is not shown."""
    rows = answers.filter(F.coalesce(F.col(answer), F.lit("")) != "").select(F.col(key).alias("k"), F.col(image).alias("image_path"), T.nouns(F.col(answer)).alias("nouns"))
    said = rows.select("k", "image_path", F.explode("nouns").alias("noun")).join(presence, ["image_path", "noun"], "left").select("k", "noun", (~F.coalesce("present", F.lit(False))).cast("int").alias("bad"))
    per = said.groupBy("k").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    total = rows.select("k").join(per, "k", "left").na.fill(0).agg(F.count("*").alias("answers"), F.sum("n").alias("mentions"), F.sum("bad").alias("b"), F.sum((F.col("bad") > 0).cast("int")).alias("s"))
    one = total.select(_or0(F.try_divide(F.col("b"), F.col("mentions"))).alias("chair_i"), _or0(F.try_divide(F.col("s"), F.col("answers"))).alias("chair_s"), "answers", F.coalesce("mentions", F.lit(0)).alias("mentions"))
    return one, said.groupBy("noun").agg(F.count("*").alias("total"), F.sum("bad").alias("hallucinated"))


def low_alignment(df: DataFrame, below: float = 0.2, clip: str = "clip", image: str = "image_path", answer: str = "answer") -> DataFrame:
    rows = df.filter((F.coalesce(F.col(image), F.lit("")) != "") & (F.coalesce(F.col(answer), F.lit("")) != "") & F.col(clip).isNotNull())
    return rows.agg(F.count("*").alias("n"), _or0(F.avg(clip)).alias("mean_clip"), _or0(F.avg((F.col(clip) < below).cast("double"))).alias("low_rate"))


def alignment(df: DataFrame, blind: float = 0.15) -> DataFrame:
    """One row from columns ia (image and answer), iq (image and question), ia_shuffled."""
    return df.agg(_or0(F.avg("ia")).alias("mean_ia"), _or0(F.avg("iq")).alias("mean_iq"), _or0(F.avg((F.col("ia") < blind).cast("double"))).alias("blind_rate"), (_or0(F.avg("ia")) - _or0(F.avg("ia_shuffled"))).alias("gap"))


def template_repeats(df: DataFrame, text: str) -> DataFrame:
    """Of texts of three words or more, the share whose first three are shared."""
    w = df.select(T.words(F.col(text)).alias("w")).filter("size(w) >= 3").groupBy(F.slice("w", 1, 3).alias("p")).agg(F.count("*").alias("n"))
    return w.agg(_or0(F.try_divide(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.sum("n"))).alias("repeat_rate"))


def yes_no_rate(df: DataFrame, answer: str = "answer") -> DataFrame:
    t = F.regexp_replace(F.lower(T.strip(F.col(answer))), r"[.!?]+$", "")
    return df.filter(F.coalesce(T.strip(F.col(answer)), F.lit("")) != "").agg(_or0(F.avg(t.isin("yes", "no").cast("double"))).alias("yes_no_rate"))


def sentence_shape(df: DataFrame, text: str = "answer") -> DataFrame:
    t = T.strip(F.col(text))
    return df.filter(F.coalesce(t, F.lit("")) != "").agg(_or0(F.avg((t.rlike(r"^\p{Lu}") & t.rlike(r"[.!?]$")).cast("double"))).alias("shape_rate"))


def grammar_error_rate(df: DataFrame, faulty: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], text: str = "answer") -> DataFrame:
    """One row: the share of non-blank texts in which `faulty`, a checker over batches of texts given by the caller, finds an error."""
    rows = df.filter(T.has_text(F.col(text))).withColumn("__bad", F.pandas_udf(faulty, "boolean").asNondeterministic()(F.col(text)))
    return rows.agg(_or0(F.avg(F.col("__bad").cast("double"))).alias("grammar_error_rate"))


def component_stats(df: DataFrame, bins: int = 50) -> DataFrame:
    """(component, count, mean, std, min, max, p25 ... p99, histogram) of all five components; count 0 and nulls where no score is a number."""
    points = (25, 50, 75, 90, 95, 99)
    names = df.sparkSession.createDataFrame([(c,) for c in COMPONENTS], "component string")
    wide = percentiles(df, points).groupBy("component").pivot("percent", list(points)).agg(F.first("value"))
    counts = histogram(df, bins).groupBy("component").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bin", "n")))).alias("histogram"))  # `bins` entries
    both = names.join(score_summary(df), "component", "left").join(wide, "component", "left").join(counts, "component", "left")
    return both.select("component", F.coalesce("n", F.lit(0)).alias("count"), "mean", "std", "min", "max", *[F.col(f"`{p}`").alias(f"p{p}") for p in points], "histogram")


def unique_ratio(df: DataFrame, value: str = "average_hash") -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("m")).agg(_or0(F.try_divide(F.count("*"), F.sum("m"))).alias("unique_ratio"))


def perplexity_scores(df: DataFrame, ppl: str = "ppl", temperature: float = 5.0) -> DataFrame:
    """df with ppl_score: a falling sigmoid around the mean perplexity of all rows."""
    mean = df.agg(F.avg(ppl).alias("__mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn("ppl_score", 1 / (1 + F.exp((F.col(ppl) - F.col("__mean")) / temperature))).drop("__mean")  # one row


def composite(ar: Column, clip: Column, qr: Column, ppl: Column, weights: Sequence[float] = (0.40, 0.25, 0.25, 0.10)) -> Column:
    """struct of the four components and their weighted sum, four places each; qr defaults to 0, ppl to 0.5."""
    v = (ar, clip, F.coalesce(qr, F.lit(0.0)), F.coalesce(ppl, F.lit(0.5)))
    total = sum((w * c for w, c in zip(weights, v)), F.lit(0.0))
    return F.struct(*[F.round(c, 4).alias(n) for n, c in zip(COMPONENTS, (*v, total))])
