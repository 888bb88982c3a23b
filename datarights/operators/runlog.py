"""Run logs: integrity checks, pairing, planning and close-out. Checks return violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datarights.operators.ordered import in_order, line_bucket, placed
from datarights.operators.scoring import count_if

EPS = 1e-6
#: How a run may stop.
STOP_CONDITIONS = ["accepted", "gate_rejected", "budget_exhausted", "max_submits", "max_tokens", "no_submission",
                   "timeout", "crashed", "replay_miss", "render_failed", "api_error", "refusal"]
RECIPIENT_KINDS = ["unknown", "internal", "processor", "external_controller"]


def valid_prefix(lines: DataFrame, file: str, line: str, text: str, good: Column, newline: Column | None = None) -> DataFrame:
    """Per file: lines kept before the first bad one, and the bytes dropped from there on.

    `newline` tells whether a line ends with one (all do unless given); what follows the last
    newline was not written to its end and is never kept.
    """
    ended = F.lit(True) if newline is None else newline
    flagged = lines.withColumns({"_ended": ended, "_good": good & ended})
    first = flagged.groupBy(file).agg(F.min(F.when(~F.coalesce("_good", F.lit(False)), F.col(line))).alias("_bad"))
    joined = flagged.join(first, file)
    kept = F.col("_bad").isNull() | (F.col(line) < F.col("_bad"))
    size = F.octet_length(text) + F.col("_ended").cast("int")
    return joined.groupBy(file).agg(
        count_if(kept).alias("kept_lines"),
        F.sum(F.when(~kept, size).otherwise(0)).cast("bigint").alias("dropped_bytes"))


def pair_calls(calls: DataFrame, results: DataFrame, keys: list[str], pending: Column | None = None) -> DataFrame:
    """Each call with its number of results: ok, missing, repeated, or a result without a call.

    `pending` (over the call's columns) marks calls that may lack a result.
    """
    c = calls.select(*keys, (pending if pending is not None else F.lit(False)).alias("_pending"))
    c = c.groupBy(*keys).agg(F.bool_or("_pending").alias("_pending"), F.count("*").alias("calls"))
    r = results.groupBy(*keys).agg(F.count("*").alias("results"))
    both = c.join(r, keys, "full_outer")
    status = (F.when(F.col("calls").isNull(), "orphan").when(F.col("results").isNull() & F.col("_pending"), "pending")
              .when(F.col("results").isNull(), "missing").when(F.col("results") > 1, "repeated").otherwise("ok"))
    return both.select(*keys, F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("results", F.lit(0)).alias("results"),
                       status.alias("status"))


def disjoint_windows(windows: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of arms whose recording windows do not overlap. `windows`: by, arm, lo, hi.

    Arms are a handful per group, so the pair join stays the size of the arm list squared.
    """
    a = windows.select(*by, F.col("arm").alias("arm_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    b = windows.select(*by, F.col("arm").alias("arm_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    return a.join(b, by).where("arm_a < arm_b AND (hi_a < lo_b OR hi_b < lo_a)")


def complete_plan(cases: DataFrame, arms: list[str], seeds: list[int], runs: DataFrame, zero: dict[str, object]) -> DataFrame:
    """Every planned (case, arm, seed), with the run's row or the `zero` values in its place."""
    plan = (cases.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
            .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))))
    out = plan.join(runs, ["case", "arm", "seed"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in zero.items()})


def settle(facts: DataFrame, provenance: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """What a run's own record says at the end wins over what its first line guessed."""
    end = provenance.select(*keys, *[F.col(c).alias(f"_end_{c}") for c in columns])
    out = facts.join(end, keys, "left")
    return out.withColumns({c: F.coalesce(f"_end_{c}", c) for c in columns}).drop(*[f"_end_{c}" for c in columns])


def check_contiguous(df: DataFrame, run: list[str], order: list[str], value: str, bucket: Column, first: int = 1) -> DataFrame:
    """Rows whose number is not their place in the run."""
    placed = in_order(df, run, order, bucket, number="_place")
    return (placed.withColumn("expected", F.col("_place") - 1 + first)
            .where(~F.col(value).eqNullSafe(F.col("expected"))).drop("_place"))


def check_cumulative(df: DataFrame, run: list[str], order: list[str], cost: str, reported: str) -> DataFrame:
    """Adds `below_previous` and `not_sum`: the running cost falls, or is not previous + cost.

    The reported value, right or wrong, is what the next row is compared with.
    """
    seen = placed(df, run, order, previous={"_prev": reported})
    prev = F.coalesce("_prev", F.lit(0.0))
    return seen.withColumns({
        "below_previous": F.col(reported) + EPS < prev,
        "not_sum": F.abs(F.col(reported) - (prev + F.col(cost))) > EPS}).drop("_prev")


def check_unique_ids(df: DataFrame, run: list[str], ident: str, line: str) -> DataFrame:
    """Later uses of an id in a run, with the line that used it first."""
    first = df.groupBy(*run, ident).agg(F.min(line).alias("first_line"), F.count("*").alias("_uses"))
    return df.join(first.where("_uses > 1").drop("_uses"), [*run, ident]).where(F.col(line) > F.col("first_line"))


def check_order(df: DataFrame, run: list[str], line: str, kind: str, *, start="run_start", end="run_end", step="step",
                checkpoint="checkpoint") -> DataFrame:
    """Per run: exactly one start first, one end last, only steps and checkpoints between,
    and no checkpoint before the last step."""
    k = F.col(kind)
    seen = df.groupBy(*run).agg(
        F.min_by(kind, line).alias("first_kind"), F.max_by(kind, line).alias("last_kind"),
        count_if(k.isin(start, end)).alias("edges"), count_if(~k.isin(start, end, step, checkpoint)).alias("strange"),
        F.max(F.when(k == step, F.col(line))).alias("last_step"), F.min(F.when(k == checkpoint, F.col(line))).alias("first_checkpoint"))
    return seen.select(
        *run, ((F.col("first_kind") == start) & (F.col("last_kind") == end) & (F.col("edges") == 2)).alias("framed"),
        (F.col("strange") == 0).alias("known_kinds"),
        F.coalesce(F.col("first_checkpoint") > F.col("last_step"), F.lit(True)).alias("checkpoint_last"))


def check_run_end(totals: DataFrame, ends: DataFrame, run: list[str], counters: list[str], tool_budget: Column,
                  submit_budget: Column) -> DataFrame:
    """One row per counter the end line gets wrong, and per exceeded budget.

    `totals` and `ends` both carry `counters`; `ends` also `stop`.
    """
    told = ends.select(*run, "stop", *[F.col(c).alias(f"told_{c}") for c in counters])
    both = told.join(totals, run, "left").fillna(0, counters)
    tests = [F.when(~F.col(f"told_{c}").eqNullSafe(F.col(c)), F.lit(f"{c} differs")) for c in counters]
    tests.append(F.when(~F.coalesce(F.col("stop").isin(STOP_CONDITIONS), F.lit(False)), F.lit("unknown stop")))
    if "submits" in counters:
        tests.append(F.when(F.col("submits") > submit_budget, F.lit("submit budget exceeded")))
    if "tool_calls" in counters:
        calls = F.coalesce("told_tool_calls", "tool_calls")
        tests.append(F.when(calls > tool_budget, F.lit("tool budget exceeded")))
    return both.select(*run, F.explode(F.array_compact(F.array(*tests))).alias("violation"))


def run_totals(steps: DataFrame, run: list[str], order: Column) -> DataFrame:
    """Counters of a run from its steps: `calls`, `submits`, `rejected` per step plus cost so far."""
    return steps.groupBy(*run).agg(
        F.count("*").alias("steps"), F.sum("calls").cast("bigint").alias("tool_calls"),
        F.sum("submits").cast("bigint").alias("submits"), F.sum("rejected").cast("bigint").alias("verify_rounds"),
        F.max_by("cost_cum", order).alias("cost"))


def synthesise_run_end(steps: DataFrame, ends: DataFrame, run: list[str], order: Column, condition: str = "crashed") -> DataFrame:
    """An end row for every run that has none, its counters taken from its steps."""
    open_runs = run_totals(steps, run, order).join(ends.select(*run).distinct(), run, "left_anti")
    return open_runs.withColumn("stop", F.lit(condition))


def check_chain(lines: DataFrame, ledger: list[str], line_no: str, text: str, prev_sha: str, bucket: Column | None = None) -> DataFrame:
    """Ledger lines whose last field is not the hash of the line that stands before them.

    The line before is the one in the file, whatever its number; only the first line of a ledger
    may carry zeros. `bucket` must not decrease with the line number.
    """
    seen = in_order(lines, ledger, [line_no], line_bucket(line_no) if bucket is None else bucket, previous={"_before": text}, number="_place")
    expected = F.when(F.col("_place") == 1, F.lit("0" * 64)).otherwise(F.sha2(F.encode("_before", "UTF-8"), 256))
    return seen.withColumn("expected_sha", expected).where(~F.col(prev_sha).eqNullSafe(F.col("expected_sha"))).drop("_before", "_place")


def check_append_only(lines: DataFrame, witness: DataFrame, ledger: list[str], line_no: str, text: str) -> DataFrame:
    """Witnessed lines that the ledger no longer carries in place, unchanged."""
    now = lines.select(*ledger, line_no, F.col(text).alias("_now"))
    return (witness.join(now, [*ledger, line_no], "left")
            .where(~F.col(text).eqNullSafe(F.col("_now"))).drop("_now"))


def trace_end(df: DataFrame, run: list[str], line: str, kind: str, values: list[str], end="run_end",
              checkpoint="checkpoint") -> DataFrame:
    """The last end line and the last checkpoint of each run; no end line means `crashed`."""
    def last(which: str, column: str):
        return F.max_by(column, F.when(F.col(kind) == which, F.col(line)))
    return df.groupBy(*run).agg(
        *[F.when(count_if(F.col(kind) == end) > 0, last(end, v)).alias(f"end_{v}") for v in values],
        *[F.when(count_if(F.col(kind) == checkpoint) > 0, last(checkpoint, v)).alias(f"checkpoint_{v}") for v in values],
        (count_if(F.col(kind) == end) == 0).alias("crashed"))


def check_start(starts: DataFrame, model: str, override_names: list[str]) -> DataFrame:
    """The first line against where the file lies. Input: the start fields, `overridden`
    (array) and the identity from the path as path_arm, path_case, path_seed."""
    unknown = F.array_except(F.coalesce("overridden", F.array().cast("array<string>")), F.array(*[F.lit(n) for n in override_names]))
    tests = F.array(
        F.when(F.col("path_case") == "", F.lit("file name")), F.when(~F.col("case").eqNullSafe(F.col("path_case")), F.lit("case")),
        F.when(~F.col("seed").cast("string").eqNullSafe(F.col("path_seed")), F.lit("seed")),
        F.when(~F.col("arm").eqNullSafe(F.col("path_arm")), F.lit("arm")),
        F.when(~F.coalesce(F.col("mode").isin("live", "replay"), F.lit(False)), F.lit("mode")),
        F.when(~F.col("model").eqNullSafe(F.lit(model)), F.lit("model")),
        F.when(F.col("overridden").isNull(), F.lit("overridden")), F.when(F.size(unknown) > 0, F.lit("override name")))
    return starts.select("run_id", F.explode(F.array_compact(tests)).alias("violation"))


def check_gate(points: DataFrame, runs: DataFrame, stores: DataFrame) -> DataFrame:
    """Checkpoint rules. `points`: run_id, caller, risk, by, completions (map store -> kind, or null).
    `runs`: run_id, arm, stop, rating (recomputed from the record). `stores`: run_id, name."""
    counted = runs.join(points.groupBy("run_id").agg(F.count("*").alias("n")), "run_id", "left").fillna(0, ["n"])
    per_run = counted.select("run_id", F.explode(F.array_compact(F.array(
        F.when((F.col("arm") == "baseline") & (F.col("n") > 0), F.lit("baseline carries a checkpoint")),
        F.when((F.col("arm") == "advanced") & F.col("stop").isin("accepted", "gate_rejected") & (F.col("n") != 1),
               F.lit("needs one checkpoint"))))).alias("violation"))
    seen = points.join(runs, "run_id")
    per_point = seen.select("run_id", F.explode(F.array_compact(F.array(
        F.when(~F.col("caller").eqNullSafe(F.lit("harness")), F.lit("caller")),
        F.when(F.col("rating").isNotNull() & ~F.col("risk").eqNullSafe(F.col("rating")), F.lit("risk differs")),
        F.when(F.col("completions").isNotNull() & (F.col("by") == "simulated"), F.lit("completions on a simulated gate"))))).alias("violation"))
    filled = seen.where("completions IS NOT NULL AND `by` <> 'simulated'").select("run_id", F.explode("completions").alias("name", "kind"))
    outside = filled.where(~F.col("kind").isin(RECIPIENT_KINDS)).select("run_id", F.lit("kind outside the enum").alias("violation"))
    stray = filled.join(stores, ["run_id", "name"], "left_anti").select("run_id", F.lit("store not in the record").alias("violation"))
    return reduce(DataFrame.unionByName, [per_run, per_point, outside, stray])


def check_steps_shape(steps: DataFrame, keys: list[str], local: Column) -> DataFrame:
    """Usage counts are whole and not negative, the request hash is 64 hex, a stop reason is there.

    Usage columns arrive as text. `local` marks runs whose request hash may be null.
    """
    tests = [F.when(~F.coalesce(F.col(c).rlike(r"^[0-9]+$"), F.lit(False)), F.lit(f"usage.{c}"))
             for c in ("input", "cache_read", "cache_write", "output")]
    hashed = F.coalesce(F.col("request_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))
    tests.append(F.when(~hashed & ~(F.col("request_hash").isNull() & local), F.lit("request_hash")))
    tests.append(F.when(F.coalesce("stop_reason", F.lit("")) == "", F.lit("stop_reason")))
    return steps.select(*keys, F.explode(F.array_compact(F.array(*tests))).alias("violation"))
