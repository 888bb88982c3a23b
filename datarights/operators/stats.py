"""Aggregates over runs and the two paired statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datarights.operators.ordered import placed
from datarights.operators.scoring import count_if

#: Budgets a run may not exceed.
TOOL_BUDGET, LARGE_TOOL_BUDGET, SUBMIT_BUDGET = 60, 120, 5


def majority(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per case: passed by more than half of its seeds, and by all of them."""
    return runs.groupBy(*by).agg(
        (count_if(F.col("passed")) * 2 > F.count("*")).alias("majority"),
        F.bool_and("passed").alias("pass_all"))


def summarise(runs: DataFrame, by: list[str]) -> DataFrame:
    """Means, totals and the two spreads of F1 per arm and split.

    `f1_std_seeds` is the mean over cases of the spread between seeds; `f1_std_cases` the
    spread between the case means. Both are population deviations.
    """
    per_case = runs.groupBy(*by, "case").agg(
        F.avg("f1").alias("_mean"), F.stddev_pop("f1").alias("_std"), F.sum("f1").alias("_f1"),
        F.count("*").alias("_n"), count_if(F.col("passed")).alias("_pass"),
        count_if(F.col("stop") == "accepted").alias("_ok"), F.sum("precision").alias("_p"), F.sum("recall").alias("_r"),
        F.sum("false_safe").alias("_fs"), F.sum("unmatched_reaching").alias("_ur"),
        F.sum(F.when(F.col("stop") == "accepted", F.col("f1")).otherwise(0.0)).alias("_f1_ok"))
    n, ok = F.sum("_n"), F.sum("_ok")
    return per_case.groupBy(*by).agg(
        F.count("*").alias("n_cases"), n.alias("n_runs"), ok.alias("success"), (n - ok).alias("failure"),
        (F.sum("_f1") / n).alias("f1_mean"), F.avg("_std").alias("f1_std_seeds"),
        F.stddev_pop("_mean").alias("f1_std_cases"),
        F.when(ok > 0, F.sum("_f1_ok") / F.greatest(ok, F.lit(1))).otherwise(0.0).alias("f1_mean_success_only"),
        (F.sum("_p") / n).alias("precision_mean"), (F.sum("_r") / n).alias("recall_mean"),
        F.sum("_fs").alias("false_safe_total"), F.sum("_ur").alias("unmatched_reaching_total"),
        F.sum("_pass").alias("pass_runs"), count_if(F.col("_pass") * 2 > F.col("_n")).alias("pass_cases_majority"),
        count_if(F.col("_pass") == F.col("_n")).alias("pass_all_cases"))


def log_gamma(x):
    """The logarithm of the gamma function for x >= 1: Stirling's series eight places higher, and back."""
    z = x + 8.0
    back = reduce(lambda a, b: a + b, [F.log(x + float(i)) for i in range(8)])
    series = 1 / (12.0 * z) - 1 / (360.0 * z ** 3) + 1 / (1260.0 * z ** 5) - 1 / (1680.0 * z ** 7)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - back


def mcnemar(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Exact two-sided McNemar test on paired outcomes (`passed` per key on both sides): b, c, n_discordant, p_exact and its logarithm ln_p.

    The tail is summed from its largest term down. Terms fall off within some square roots of the number of
    discordant pairs, which bounds how many are added; the first comes from the gamma function, so p may be
    smaller than a double can hold while ln_p is not.
    """
    pairs = a.select(*keys, F.col("passed").alias("_a")).join(b.select(*keys, F.col("passed").alias("_b")), keys)
    counts = pairs.agg(count_if(F.col("_a") & ~F.col("_b")).alias("b"), count_if(F.col("_b") & ~F.col("_a")).alias("c"))
    counts = counts.withColumns({"n_discordant": F.col("b") + F.col("c"), "_m": F.least("b", "c").cast("double")})
    n, m = F.col("n_discordant").cast("double"), F.col("_m")
    terms = F.least(m, F.ceil(12 * F.sqrt(n) + 60)).cast("bigint")

    def add(acc, i):
        term = acc["t"] * (m - i) / (n - m + i + 1.0)
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))
    steps = F.when(terms > 0, F.sequence(F.lit(0).cast("bigint"), terms - 1)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), add, lambda acc: acc["s"])
    first = log_gamma(n + 1.0) - log_gamma(m + 1.0) - log_gamma(n - m + 1.0) - n * math.log(2)
    ln_p = F.when(F.col("n_discordant") == 0, 0.0).otherwise(F.least(F.lit(0.0), math.log(2) + first + F.log(tail)))
    return counts.withColumn("ln_p", ln_p).withColumn("p_exact", F.exp("ln_p")).drop("_m")


HASH_P = 2147483647


def draw(resample, position, n, seed: int):
    """A counter-based index in [0, n): whole numbers only, so any engine can repeat it."""
    x = (resample * 1103515245 + position * 12345 + seed) % HASH_P
    for _ in range(3):
        x = (x * 48271 + position * 69621 + resample) % HASH_P
    # two draws of 31 bits, so that every index of a long table can come up
    return (x * HASH_P + (x * 48271 + position * 69621 + resample) % HASH_P) % n


def bootstrap(pairs: DataFrame, resamples: int, seed: int = 20260830) -> DataFrame:
    """Paired bootstrap of mean(a) - mean(b); 95% interval by nearest rank.

    `pairs`: idx (0..n-1), a, b. Both arms share each resample. The draws are a
    `resamples x n` range, spread over the cluster and summed per resample before any rank.
    """
    spark = pairs.sparkSession
    n = pairs.count()
    if n == 0:
        return spark.range(1).select(F.lit(0.0).alias("delta_mean"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    draws = spark.range(resamples * n).select(
        F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("j"))
    draws = draws.select("r", draw(F.col("r"), F.col("j"), F.lit(n), seed).alias("idx"))
    picked = draws.groupBy("r", "idx").agg(F.count("*").alias("k")).join(
        pairs.select("idx", (F.col("a") - F.col("b")).alias("d")), "idx")
    diffs = picked.groupBy("r").agg((F.sum(F.col("d") * F.col("k")) / n).alias("d"))
    ranked = diffs.withColumn("rank", F.row_number().over(Window.orderBy("d")) - 1)  # `resamples` rows

    def at(q: float) -> F.Column:
        index = min(resamples - 1, max(0, int(q * resamples)))
        return F.max(F.when(F.col("rank") == index, F.col("d")))
    interval = ranked.agg(at(0.025).alias("lo"), at(0.975).alias("hi"))
    mean = pairs.agg(F.avg("a") - F.avg("b")).scalar()
    return interval.select(mean.alias("delta_mean"), "lo", "hi")


def nearest_rank(df: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    """The value at index int(q*n) of each sorted group, no interpolation.

    Equal values are counted first, so a hot group is ranked over its distinct values only.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    ranked = placed(counted, by, [value], sums={"_upto": F.col("_k")})
    totals = counted.groupBy(*by).agg(F.sum("_k").alias("_n"))
    ranked = ranked.join(totals, by)
    index = F.least(F.col("_n") - 1, F.greatest(F.lit(0), F.floor(F.lit(q) * F.col("_n"))))
    return ranked.where(F.col("_upto") > index).groupBy(*by).agg(F.min(value).alias("value"))


def indexed(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds `idx`, 0 and up in the given order, without sorting everything in one task."""
    return placed(df, [], order, number="_at").withColumn("idx", F.col("_at") - 1).drop("_at")


def cost_source(rows: DataFrame, by: list[str]) -> DataFrame:
    """The weakest of the sources: one unpriced run makes the column unpriceable."""
    rank = F.when(F.col("cost_source") == "unpriced", 0).when(F.col("cost_source") == "cli_estimate", 1).otherwise(2)
    return rows.groupBy(*by).agg(F.min_by("cost_source", rank).alias("cost_source"))


def token_usage(steps: DataFrame, by: list[str]) -> DataFrame:
    """Token totals per run; cache reads and writes stay apart."""
    kinds = ["input", "output", "cache_read", "cache_write"]
    sums = steps.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(k), F.lit(0))).cast("bigint").alias(k) for k in kinds])
    return sums.withColumn("cached", F.col("cache_read") + F.col("cache_write"))


def check_uniform(facts: DataFrame) -> DataFrame:
    """Reasons why two arms must not be compared: one row per violated rule.

    `facts`: arm, case, seed, prompt_sha, brain, model, has_trace, scored, first_request.
    """
    one = facts.agg(
        F.count_distinct("prompt_sha").alias("prompt_sha"), F.count_distinct("brain").alias("brain"),
        F.count_distinct("model").alias("model"),
        count_if(F.col("scored") & ~F.col("has_trace")).alias("missing_trace"))
    wide = one.selectExpr("stack(4, 'prompt_sha', prompt_sha, 'brain', brain, 'model', model, 'missing_trace', missing_trace) AS (rule, n)")
    wide = wide.where("(rule = 'missing_trace' AND n > 0) OR (rule <> 'missing_trace' AND n > 1)")
    first = (facts.groupBy("case", "seed").agg(F.count_distinct("first_request").alias("k"))
             .where("k > 1").agg(F.count("*").alias("n")).where("n > 0")
             .select(F.lit("first_request").alias("rule"), "n"))
    return wide.unionByName(first)


def identity_check(rows: DataFrame, cases: int, arms: int, seeds: int) -> DataFrame:
    """Every planned run is there, and each is a success or a failure."""
    out = rows.agg(F.count("*").alias("n"), count_if(F.col("stop") == "accepted").alias("success"))
    out = out.withColumn("failure", F.col("n") - F.col("success"))
    return out.withColumn("ok", F.col("n") == cases * arms * seeds)


def timing(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(F.avg("wall_s").alias("wall_s_mean"), F.stddev_pop("wall_s").alias("wall_s_std"),
                                 F.count("*").alias("n"))


def compare_results(previous: DataFrame, current: DataFrame, resamples: int, seed: int = 20260830) -> DataFrame:
    """One before/after row: paired F1 change with its interval, and what moved beside it.

    Inputs: case, f1, passed, false_safe, one row per case.
    """
    old = previous.select("case", F.col("f1").alias("b"), F.col("passed").alias("was"), F.col("false_safe").alias("fs_old"))
    both = current.select("case", F.col("f1").alias("a"), F.col("passed").alias("now"), F.col("false_safe").alias("fs_new")).join(old, "case")
    pairs = indexed(both.select("case", "a", "b"), ["case"])
    moved = {"paired": F.count("*"), "false_safe_change": F.sum("fs_new") - F.sum("fs_old"), "regressions": count_if(F.col("was") & ~F.col("now"))}
    return bootstrap(pairs, resamples, seed).withColumns({name: both.agg(value).scalar() for name, value in moved.items()})


def failed_runs(runs: DataFrame, diagnoses: DataFrame, keys: list[str]) -> DataFrame:
    """Every run not accepted beside its diagnosis; a row on one side only is a mismatch."""
    bad = runs.where("stop <> 'accepted'").select(*keys, "stop", F.lit(True).alias("in_runs"))
    told = diagnoses.select(*keys, "reason", F.lit(True).alias("in_diagnoses"))
    both = bad.join(told, keys, "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_runs", "in_diagnoses")})

