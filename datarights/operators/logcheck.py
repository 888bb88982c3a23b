"""All checks over folders of run logs, each violation with its file, line and check number.

A log that does not parse, or does not begin and end as a run does, is told only that. Of the others all
lines are checked together: places and running costs in buckets along the log, calls and results by joins,
totals by one aggregation per log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datarights.operators import runlog as rl
from datarights.operators.ordered import in_order, line_bucket
from datarights.session import stage

#: A log line of any type; what a line does not have, or has in another type, is null.
LINE = ("type string, step bigint, tool_calls array<struct<id: string, name: string>>, tool_results array<struct<call_id: string, output: string>>, "
        "usage struct<input: string, cache_read: string, cache_write: string, output: string>, stop_reason string, request_hash string, cost_usd double, cost_cum_usd double, "
        "`case` string, seed string, arm string, mode string, model string, config struct<brain: string, overridden: array<string>, tool_budget: int, submit_budget: int>, "
        "stop_condition string, steps bigint, tool_calls_total bigint, submits bigint, verify_rounds bigint, note string, record_path string, caller string, risk string, `by` string, "
        "human_completions struct<recipient_kind: map<string, string>>")
TOOL_BUDGET, REAL_TOOL_BUDGET, SUBMIT_BUDGET = 60, 120, 5
BYTES = r"(?i)\d+\s*bytes?"


def _found(df: DataFrame, check: int | Column, what: Column | str, line: Column | str = "line") -> DataFrame:
    return df.select("file", (F.col(line) if isinstance(line, str) else line).cast("bigint").alias("line"), (F.lit(check) if isinstance(check, int) else check).alias("check"),
                     (F.lit(what) if isinstance(what, str) else what).alias("what"))


def _listed(df: DataFrame, check: int, tests: list[Column]) -> DataFrame:
    return _found(df.withColumn("_w", F.explode(F.array_compact(F.array(*tests)))), check, F.col("_w"))


def _steps_of(steps: DataFrame, ends: DataFrame) -> list[DataFrame]:
    """Checks 3 to 6 and 12, over step lines with `o`, their place and the cost reported before them."""
    last = steps.groupBy("file").agg(F.max("line").alias("_last"))
    seen = steps.join(last, "file").join(ends.select("file", F.col("o.stop_condition").alias("_stop"), F.coalesce("_brain", F.lit("api")).alias("_brain")), "file")
    calls = seen.select("file", "line", (F.col("line") == F.col("_last")) & (~F.coalesce(F.col("_stop") == "accepted", F.lit(False))), F.posexplode("o.tool_calls").alias("pos", "c")).toDF("file", "line", "_open", "pos", "c")
    calls = calls.select("file", "line", "_open", F.struct("line", "pos").alias("at"), F.coalesce("c.id", F.lit("")).alias("id"))
    results = steps.select("file", "line", F.explode("o.tool_results").alias("r")).select("file", "line", F.coalesce("r.call_id", F.lit("")).alias("id"))
    paired = rl.pair_calls(calls, results, ["file", "line", "id"], F.col("_open")).where("status NOT IN ('ok', 'pending')")
    again = rl.check_unique_ids(calls, ["file"], "id", "at")
    used = {"tool_calls": "call list", "tool_results": "result list"}
    odd = [F.when(F.exists(F.coalesce(f"o.{k}", F.array()), lambda x: x.isNull()) | (F.col(f"o.{k}").isNull() & F.try_variant_get("obj", f"$.{k}", "variant").isNotNull()
                                                                                    & ~F.is_variant_null(F.try_variant_get("obj", f"$.{k}", "variant"))), F.lit(v)) for k, v in used.items()]
    cost, told, before = F.coalesce("o.cost_usd", F.lit(0.0)), F.coalesce("o.cost_cum_usd", F.lit(0.0)), F.coalesce("_before", F.lit(0.0))
    shape = seen.select("file", "line", "o.usage.*", "o.request_hash", "o.stop_reason", "_brain")
    return [
        _found(steps.where(~F.col("o.step").eqNullSafe(F.col("place"))), 3, "step number"),
        _listed(steps, 4, odd), _found(paired, 4, F.concat(F.col("status"), F.lit(" "), F.col("id"))),
        _found(again, 5, F.concat(F.lit("id of line "), F.col("first_line.line").cast("string")), F.col("at.line")),
        _listed(steps, 6, [F.when(told + rl.EPS < before, F.lit("cost falls")), F.when(F.abs(told - (before + cost)) > rl.EPS, F.lit("cost is no sum"))]),
        _found(rl.check_steps_shape(shape, ["file", "line"], F.col("_brain") != "api"), 12, F.col("violation"))]


def _totals(steps: DataFrame) -> DataFrame:
    """Counters of each log from its step lines; a rejection is an answer to a submission that says accepted: false."""
    submitted = F.filter(F.coalesce("o.tool_calls", F.array()), lambda c: c["name"] == "submit_record")
    answers = F.filter(F.coalesce("o.tool_results", F.array()), lambda r: F.array_contains(F.transform("_sub", lambda c: c["id"]), r["call_id"])
                       & (F.get_json_object(r["output"], "$.accepted") == "false"))
    per = steps.withColumn("_sub", submitted).select("file", "line", F.size(F.filter(F.coalesce("o.tool_calls", F.array()), lambda c: c.isNotNull())).alias("calls"), F.size("_sub").alias("submits"),
                                                      F.size(answers).alias("rejected"), F.coalesce("o.cost_cum_usd", F.lit(0.0)).alias("cost_cum"))
    return rl.run_totals(per, ["file"], F.col("line"))


def _ends_of(totals: DataFrame, ends: DataFrame, logs: DataFrame) -> list[DataFrame]:
    """Checks 7, 8, 9, 14 and 16."""
    told = ends.select("file", "line", F.col("o.stop_condition").alias("stop"), F.col("o.steps").alias("steps"), F.col("o.tool_calls_total").alias("tool_calls"), F.col("o.submits").alias("submits"),
                       F.col("o.verify_rounds").alias("verify_rounds"), F.coalesce("o.cost_usd", F.lit(0.0)).alias("cost"), F.col("o.note").alias("note"), "_start")
    config, names = F.col("_start.config"), F.coalesce("_start.config.overridden", F.array().cast("array<string>"))
    own = lambda suffix, key, usual: F.coalesce(F.when(F.exists(names, lambda n: n.endswith(suffix)), config[key]), usual)
    usual = F.when(F.upper("_start.case").startswith("R"), REAL_TOOL_BUDGET).otherwise(TOOL_BUDGET)
    budgets = told.select("file", own("TOOL_BUDGET", "tool_budget", usual).alias("_tools"), own("SUBMIT_BUDGET", "submit_budget", F.lit(SUBMIT_BUDGET)).alias("_submits"))
    counted = logs.join(totals, "file", "left").fillna(0, ["steps", "tool_calls", "submits", "verify_rounds", "cost"])
    wrong = rl.check_run_end(counted.join(budgets, "file"), told, ["file"], ["steps", "tool_calls", "submits", "verify_rounds"], F.col("_tools"), F.col("_submits"))
    number = (F.when(F.col("violation") == "unknown stop", 14).when(F.col("violation").startswith("verify_rounds"), 9)
              .when(F.col("violation").startswith("submit") | F.col("violation").contains("budget"), 8).otherwise(7))
    dear = told.join(counted.select("file", F.col("cost").alias("_sum")), "file").where(F.abs(F.col("cost") - F.col("_sum")) > rl.EPS)
    n_bytes, truncated = F.size(F.regexp_extract_all("note", F.lit(f"({BYTES})"))), F.lower("note").contains("truncat") | F.col("note").rlike(BYTES)
    noted = F.when(truncated & ~F.coalesce(F.col("stop") == "timeout", F.lit(False)), "truncation without a timeout").when(truncated & (n_bytes != 1), "byte counts")
    return [_found(wrong.join(told.select("file", "line"), "file"), number, F.col("violation")), _found(dear, 7, "cost differs"), _found(told.withColumn("_w", noted).where("_w IS NOT NULL"), 16, F.col("_w"))]


def check_logs(lines: DataFrame, model: str, override_names: list[str], identity: Column, records: DataFrame | None = None, diagnoses: DataFrame | None = None) -> DataFrame:
    """file, line, check, what: every violation in a folder of logs; 0 is the line of a violation of the whole log.

    `lines`: file, line, text, obj, type, problem as `read_traces(..., "strict")` gives them. `identity`:
    a struct of arm, case and seed, from the file's path. `records`: file, rating, names (array) of the
    record that a log delivered; without one checks 11 and 17 see no record. `diagnoses`: file, first
    (the first line of the text beside a failed log); without them check 15 is left out.
    """
    lines = stage(lines.select("file", "line", "text", "type", "problem", "obj"))
    broken = _found(lines.where("problem IS NOT NULL"), 1, F.col("problem")).unionByName(
        _found(lines.where(F.col("text").contains("\r")).select("file", F.lit(0).alias("line")).distinct(), 1, "carriage return"))
    good = lines.join(broken.select("file").distinct(), "file", "left_anti")
    order = rl.check_order(good, ["file"], "line", "type")
    framed = order.where("framed").select("file", "known_kinds")
    unframed = _found(order.where("NOT coalesce(framed, false)"), 2, "start and end", F.lit(0))
    parsed = stage(good.join(framed.select("file"), "file", "left_semi").select("file", "line", "type", "obj", F.from_json("text", LINE).alias("o")))
    inner = parsed.where("type NOT IN ('run_start', 'run_end') OR type IS NULL")
    strange = _found(inner.where("coalesce(type, '') NOT IN ('step', 'checkpoint')"), 2, "line type")
    points = parsed.where("type = 'checkpoint'")
    early = points.groupBy("file").agg(F.min("line").alias("line")).join(parsed.where("type = 'step'").groupBy("file").agg(F.max("line").alias("_step")), "file").where("line < _step")

    starts = parsed.where("type = 'run_start'").select("file", "line", F.col("o").alias("s"), identity.alias("_id"))
    heads = starts.select("file", F.col("s").alias("_start"), F.col("s.config.brain").alias("_brain"))
    ends = stage(parsed.where("type = 'run_end'").select("file", "line", "o").join(heads, "file"))
    steps = stage(in_order(parsed.where("type = 'step'").withColumn("_told", F.coalesce("o.cost_cum_usd", F.lit(0.0))), ["file"], ["line"], line_bucket("line"), number="place", previous={"_before": "_told"}))
    first = starts.select(F.col("file").alias("run_id"), "s.case", "s.seed", "s.arm", "s.mode", "s.model", F.col("s.config.overridden").alias("overridden"),
                          F.col("_id.arm").alias("path_arm"), F.col("_id.case").alias("path_case"), F.col("_id.seed").cast("string").alias("path_seed"))
    told = rl.check_start(first, model, override_names).withColumnRenamed("run_id", "file").join(starts.select("file", "line"), "file")
    about = _found(told, F.when(F.col("violation").startswith("overrid"), 18).otherwise(13), F.col("violation"))

    runs = ends.select(F.col("file").alias("run_id"), F.col("_start.arm").alias("arm"), F.col("o.stop_condition").alias("stop"))
    none = runs.select("run_id", F.lit(None).cast("string").alias("rating"), F.lit(None).cast("array<string>").alias("names")).where("false")
    known = none if records is None else records.select(F.col("file").alias("run_id"), "rating", "names")
    runs = runs.join(known, "run_id", "left")
    asked = points.select(F.col("file").alias("run_id"), "o.caller", "o.risk", "o.by", F.col("o.human_completions.recipient_kind").alias("completions"))
    # A store outside the record can only be told where there is a record.
    names = runs.select("run_id", F.explode("names").alias("name")).unionByName(asked.join(runs.where("names IS NULL"), "run_id", "left_semi").select("run_id", F.explode(F.map_keys("completions")).alias("name")))
    gate = rl.check_gate(asked, runs, names).withColumnRenamed("run_id", "file").join(points.groupBy("file").agg(F.min("line").alias("line")), "file", "left")
    what = F.col("violation")
    gate = _found(gate, F.when(what == "risk differs", 11).when(what.contains("checkpoint") | (what == "caller"), 10).otherwise(17), what, F.when(what == "needs one checkpoint", 0).otherwise(F.col("line")))
    parts = [broken, unframed, strange, _found(early, 2, "checkpoint before the last step"), about, gate, *_steps_of(steps, ends), *_ends_of(_totals(steps), ends, ends.select("file"))]
    if diagnoses is not None:
        failed = ends.where(F.col("file").contains("/failures/") & ~F.coalesce(F.col("o.stop_condition") == "accepted", F.lit(False))).select("file").join(diagnoses, "file", "left")
        bad = F.when(F.col("first").isNull(), "no diagnosis").when((F.size(F.split("first", " · ")) != 4) | (F.length("first") > 160), "diagnosis line")
        parts.append(_found(failed.withColumn("_w", bad).where("_w IS NOT NULL"), 15, F.col("_w"), F.lit(0)))
    return reduce(DataFrame.unionByName, parts).distinct()
