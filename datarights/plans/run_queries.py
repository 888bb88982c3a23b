"""Run-log checks over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from datarights.operators import runlog as rl
from datarights.operators.ordered import hour_bucket, in_order, line_bucket
from datarights.operators.stats import token_usage
from datarights.plans.registry import query, read
from datarights.plans.sqltext import s_list


def event_lines(spark, sf):
    """Each user's events as a log: line number by time, text a JSON object now and then cut short."""
    events = read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value", "props")
    lines = in_order(events, ["user_id"], ["ts", "event_id"], hour_bucket("ts"), number="line")
    cut_short = F.when(F.col("event_id") % 97 == 0, F.substr("props", F.lit(1), F.lit(4))).otherwise(F.col("props"))
    return lines.withColumn("text", cut_short)


LINES_SQL = """lines AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line,
 CASE WHEN event_id % 97 = 0 THEN left(props, 4) ELSE props END AS text FROM events)"""


@query("a9_valid_prefix", f"""
WITH {LINES_SQL}, l AS (SELECT *, NOT (user_id % 3 = 0 AND line = max(line) OVER (PARTITION BY user_id)) AS ended FROM lines),
b AS (SELECT user_id, min(line) FILTER (NOT json_valid(text) OR NOT ended) AS bad FROM l GROUP BY 1)
SELECT user_id, count(*) FILTER (bad IS NULL OR line < bad) AS kept_lines,
 coalesce(sum(strlen(text) + CASE WHEN ended THEN 1 ELSE 0 END) FILTER (line >= bad), 0)::BIGINT AS dropped_bytes FROM l JOIN b USING (user_id) GROUP BY user_id""")
def a9_valid_prefix(spark, sf):
    """Every third log lacks the newline at its end."""
    logs = event_lines(spark, sf)
    last = logs.groupBy("user_id").agg(F.max("line").alias("last"))
    open_end = (F.col("user_id") % 3 == 0) & (F.col("line") == F.col("last"))
    return rl.valid_prefix(logs.join(last, "user_id"), "user_id", "line", "text", F.try_parse_json("text").isNotNull(), ~open_end)


@query("c18_pair_calls", """
WITH c AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn - 1 AS turn FROM conversations WHERE role = 'assistant'),
m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL AND c.turn = m.last THEN 'pending'
 WHEN r.turn IS NULL THEN 'missing' ELSE 'ok' END AS status FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn
 LEFT JOIN m ON m.conv_id = coalesce(c.conv_id, r.conv_id)) GROUP BY 1""")
def c18_pair_calls(spark, sf):
    conv = read(spark, sf, "conversations").select("conv_id", "turn", "role")
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("last"))
    calls = conv.where("role = 'user'").join(last, "conv_id")
    results = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    paired = rl.pair_calls(calls, results, ["conv_id", "turn"], F.col("turn") == F.col("last"))
    return paired.groupBy("status").agg(F.count("*").alias("n"))


@query("c19_disjoint_windows", """
WITH w AS (SELECT user_id, event_type AS arm, min(ts) AS lo, max(ts) AS hi FROM events WHERE value > 95 GROUP BY 1, 2)
SELECT a.user_id, a.arm AS arm_a, b.arm AS arm_b FROM w a JOIN w b ON a.user_id = b.user_id AND a.arm < b.arm WHERE a.hi < b.lo OR b.hi < a.lo""")
def c19_disjoint_windows(spark, sf):
    windows = (read(spark, sf, "events").where("value > 95").groupBy("user_id", F.col("event_type").alias("arm"))
               .agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")))
    return rl.disjoint_windows(windows, ["user_id"]).select("user_id", "arm_a", "arm_b")


@query("c20_complete_plan", """
WITH c AS (SELECT DISTINCT user_id AS "case" FROM events), plan AS (SELECT "case", arm, seed FROM c, (VALUES ('purchase'), ('signup')) a(arm), (VALUES (0), (1), (2)) s(seed)),
r AS (SELECT user_id AS "case", event_type AS arm, (dayofmonth(ts) % 3)::INT AS seed, count(*) AS steps, 'accepted' AS stop FROM events WHERE value > 90 GROUP BY ALL)
SELECT plan."case", plan.arm, plan.seed, coalesce(r.steps, 0) AS steps, coalesce(r.stop, 'crashed') AS stop
FROM plan LEFT JOIN r ON plan."case" = r."case" AND plan.arm = r.arm AND plan.seed = r.seed""")
def c20_complete_plan(spark, sf):
    events = read(spark, sf, "events")
    runs = (events.where("value > 90").groupBy(F.col("user_id").alias("case"), F.col("event_type").alias("arm"),
                                               (F.dayofmonth("ts") % 3).alias("seed"))
            .agg(F.count("*").alias("steps")).withColumn("stop", F.lit("accepted")))
    cases = events.select(F.col("user_id").alias("case")).distinct()
    return rl.complete_plan(cases, ["purchase", "signup"], [0, 1, 2], runs, {"steps": 0, "stop": "crashed"})


@query("c21_settle", """
WITH f AS (SELECT doc_id, source AS model, lang AS cost_source FROM documents), e AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'measured' END AS cost_source,
 CASE WHEN toxic = 1 THEN 'flagged' END AS model FROM labels)
SELECT coalesce(e.model, f.model) AS model, coalesce(e.cost_source, f.cost_source) AS cost_source, count(*) AS n FROM f LEFT JOIN e USING (doc_id) GROUP BY 1, 2""")
def c21_settle(spark, sf):
    facts = read(spark, sf, "documents").select("doc_id", F.col("source").alias("model"), F.col("lang").alias("cost_source"))
    end = read(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "measured").alias("cost_source"),
                                           F.when(F.col("toxic") == 1, "flagged").alias("model"))
    return rl.settle(facts, end, ["doc_id"], ["model", "cost_source"]).groupBy("model", "cost_source").agg(F.count("*").alias("n"))


@query("f13_token_usage", """
SELECT user_id, sum(floor(value)::BIGINT)::BIGINT AS input, sum(event_id % 50)::BIGINT AS output, sum(CASE WHEN event_type = 'view' THEN event_id % 9 ELSE 0 END)::BIGINT AS cache_read,
 sum(event_id % 5)::BIGINT AS cache_write, (sum(CASE WHEN event_type = 'view' THEN event_id % 9 ELSE 0 END) + sum(event_id % 5))::BIGINT AS cached FROM events GROUP BY user_id""")
def f13_token_usage(spark, sf):
    steps = read(spark, sf, "events").select(
        "user_id", F.floor("value").alias("input"), (F.col("event_id") % 50).alias("output"),
        F.when(F.col("event_type") == "view", F.col("event_id") % 9).alias("cache_read"), (F.col("event_id") % 5).alias("cache_write"))
    return token_usage(steps, ["user_id"])


@query("h1_contiguous", """
SELECT conv_id, turn, expected FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS expected
 FROM conversations WHERE role <> 'system') WHERE turn <> expected""")
def h1_contiguous(spark, sf):
    conv = read(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn")
    return rl.check_contiguous(conv, ["conv_id"], ["turn"], "turn", line_bucket("turn"), first=0)


@query("h2_cumulative", """
WITH e AS (SELECT user_id, ts, event_id, value, (event_id % 1000) * 0.5::DOUBLE AS reported FROM events),
p AS (SELECT *, coalesce(lag(reported) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0.0) AS prev FROM e)
SELECT user_id, count(*) FILTER (reported + 1e-6 < prev) AS below, count(*) FILTER (abs(reported - (prev + value)) > 1e-6) AS off FROM p GROUP BY user_id""")
def h2_cumulative(spark, sf):
    events = read(spark, sf, "events").select("user_id", "ts", "event_id", "value", ((F.col("event_id") % 1000) * F.lit(0.5)).alias("reported"))
    seen = rl.check_cumulative(events, ["user_id"], ["ts", "event_id"], "value", "reported")
    return seen.groupBy("user_id").agg(F.count_if("below_previous").alias("below"), F.count_if("not_sum").alias("off"))


@query("h3_unique_ids", """
WITH f AS (SELECT conv_id, role, min(turn) AS first_line FROM conversations GROUP BY 1, 2)
SELECT c.conv_id, c.role, c.turn, f.first_line FROM conversations c JOIN f USING (conv_id, role) WHERE c.turn > f.first_line""")
def h3_unique_ids(spark, sf):
    conv = read(spark, sf, "conversations").select("conv_id", "role", "turn")
    return rl.check_unique_ids(conv, ["conv_id"], "role", "turn")


@query("h4_order", """
WITH k AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'run_start' WHEN role = 'user' THEN 'step' WHEN role = 'system' THEN 'checkpoint' ELSE 'run_end' END AS kind FROM conversations),
a AS (SELECT conv_id, arg_min(kind, turn) AS fk, arg_max(kind, turn) AS lk, count(*) FILTER (kind IN ('run_start', 'run_end')) AS edges,
 max(turn) FILTER (kind = 'step') AS ls, min(turn) FILTER (kind = 'checkpoint') AS fc FROM k GROUP BY 1)
SELECT framed, known_kinds, checkpoint_last, count(*) AS n FROM (SELECT fk = 'run_start' AND lk = 'run_end' AND edges = 2 AS framed, true AS known_kinds,
 coalesce(fc > ls, true) AS checkpoint_last FROM a) GROUP BY ALL""")
def h4_order(spark, sf):
    kind = (F.when(F.col("turn") == 0, "run_start").when(F.col("role") == "user", "step")
            .when(F.col("role") == "system", "checkpoint").otherwise("run_end"))
    conv = read(spark, sf, "conversations").select("conv_id", "turn", kind.alias("kind"))
    seen = rl.check_order(conv, ["conv_id"], "turn", "kind")
    return seen.groupBy("framed", "known_kinds", "checkpoint_last").agg(F.count("*").alias("n"))


STEP_SQL = """steps AS (SELECT user_id, cast(ts AS DATE) AS day, ts, event_id, (event_type IN ('click', 'view', 'purchase'))::INT AS calls,
 (event_type = 'purchase')::INT AS submits, (event_type = 'error')::INT AS rejected, floor(value * 1)::BIGINT AS cost_cum FROM events WHERE event_type <> 'signup'),
ends AS (SELECT user_id, cast(ts AS DATE) AS day, arg_max(struct_pack(k := json_extract(props, '$.k')::BIGINT, v := value), struct_pack(ts, event_id)) AS e FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
tot AS (SELECT user_id, day, count(*) AS steps, sum(calls)::BIGINT AS tool_calls, sum(submits)::BIGINT AS submits, sum(rejected)::BIGINT AS verify_rounds,
 arg_max(cost_cum, struct_pack(ts, event_id)) AS cost FROM steps GROUP BY 1, 2)"""


def day_steps(spark, sf):
    """A user's day as a run: steps are its events, a signup its end line."""
    events = read(spark, sf, "events").withColumn("day", F.to_date("ts"))
    kind = F.col("event_type")
    steps = events.where("event_type <> 'signup'").select(
        "user_id", "day", "ts", "event_id", kind.isin("click", "view", "purchase").cast("int").alias("calls"),
        (kind == "purchase").cast("int").alias("submits"), (kind == "error").cast("int").alias("rejected"),
        F.floor("value").alias("cost_cum"))
    last = F.max_by(F.struct(F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.col("value").alias("v")),
                    F.struct("ts", "event_id")).alias("e")
    ends = events.where("event_type = 'signup'").groupBy("user_id", "day").agg(last)
    return steps, ends


@query("h5_run_end", f"""
WITH {STEP_SQL}, b AS (SELECT ends.user_id, ends.day, e.k % 4 AS told_steps, CASE WHEN e.v > 50 THEN 'accepted' ELSE 'gone' END AS stop,
 coalesce(tot.steps, 0) AS steps, coalesce(tot.submits, 0) AS submits, coalesce(tot.tool_calls, 0) AS tool_calls FROM ends LEFT JOIN tot USING (user_id, day)),
v AS (SELECT user_id, day, 'steps differs' AS violation FROM b WHERE told_steps IS DISTINCT FROM steps
 UNION ALL SELECT user_id, day, 'unknown stop' FROM b WHERE stop NOT IN {s_list(rl.STOP_CONDITIONS)}
 UNION ALL SELECT user_id, day, 'submit budget exceeded' FROM b WHERE submits > 1
 UNION ALL SELECT user_id, day, 'tool budget exceeded' FROM b WHERE tool_calls > 2)
SELECT violation, count(*) AS n FROM v GROUP BY 1""")
def h5_run_end(spark, sf):
    steps, ends = day_steps(spark, sf)
    totals = rl.run_totals(steps, ["user_id", "day"], F.struct("ts", "event_id"))
    told = ends.join(totals.select("user_id", "day", "submits", "tool_calls"), ["user_id", "day"], "left").select(
        "user_id", "day", F.when(F.col("e.v") > 50, "accepted").otherwise("gone").alias("stop"), (F.col("e.k") % 4).alias("steps"),
        F.coalesce("submits", F.lit(0)).alias("submits"), F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"))
    found = rl.check_run_end(totals, told, ["user_id", "day"], ["steps", "submits", "tool_calls"], F.lit(2), F.lit(1))
    return found.groupBy("violation").agg(F.count("*").alias("n"))


@query("f18_synthesise_run_end", f"""
WITH {STEP_SQL} SELECT user_id, day, steps, tool_calls, submits, verify_rounds, cost, 'crashed' AS stop FROM tot ANTI JOIN ends USING (user_id, day)""")
def f18_synthesise_run_end(spark, sf):
    steps, ends = day_steps(spark, sf)
    return rl.synthesise_run_end(steps, ends, ["user_id", "day"], F.struct("ts", "event_id"))


@query("h6_ledger_chain", """
WITH l AS (SELECT conv_id, turn, text, CASE WHEN length(text) % 7 = 0 THEN 'broken' ELSE coalesce(sha256(lag(text) OVER w), repeat('0', 64)) END AS prev_sha,
 lag(turn % 5 = 2) OVER w AS after_gap, lag(turn % 5 <> 2) OVER w AS after_line, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
cut AS (SELECT conv_id, turn, CASE WHEN after_gap THEN repeat('0', 64) ELSE prev_sha END AS prev_sha, text FROM l WHERE turn % 5 <> 2),
e AS (SELECT conv_id, turn, prev_sha, coalesce(sha256(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), repeat('0', 64)) AS want FROM cut)
SELECT conv_id, turn FROM e WHERE prev_sha <> want""")
def h6_ledger_chain(spark, sf):
    """Ledgers with some hashes broken, and lines taken out with zeros written behind them."""
    conv = read(spark, sf, "conversations").select("conv_id", "turn", "text")
    seen = in_order(conv, ["conv_id"], ["turn"], line_bucket("turn"), previous={"before": "text", "before_turn": "turn"})
    honest = F.coalesce(F.sha2("before", 256), F.lit("0" * 64))
    sha = F.when(F.col("before_turn") % 5 == 2, F.lit("0" * 64)).when(F.length("text") % 7 == 0, "broken").otherwise(honest)
    ledger = seen.where("turn % 5 <> 2").select("conv_id", "turn", "text", sha.alias("prev_sha"))
    return rl.check_chain(ledger, ["conv_id"], "turn", "text", "prev_sha").select("conv_id", "turn")


@query("h6_append_only", """
SELECT conv_id, turn FROM conversations WHERE role = 'system'""")
def h6_append_only(spark, sf):
    conv = read(spark, sf, "conversations").select("conv_id", "turn", "text", "role")
    now = conv.withColumn("text", F.when(F.col("role") == "system", F.upper(F.concat("text", F.lit(" edited")))).otherwise(F.col("text")))
    return rl.check_append_only(now.drop("role"), conv.drop("role"), ["conv_id"], "turn", "text").select("conv_id", "turn")


@query("h8_trace_end", """
SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN arg_max(event_id, ts) FILTER (event_type = 'signup') END AS end_event_id,
 CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN arg_max(event_id, ts) FILTER (event_type = 'purchase') END AS checkpoint_event_id,
 count(*) FILTER (event_type = 'signup') = 0 AS crashed FROM events GROUP BY user_id""")
def h8_trace_end(spark, sf):
    return rl.trace_end(read(spark, sf, "events"), ["user_id"], "ts", "event_type", ["event_id"], end="signup", checkpoint="purchase")


@query("h12_steps_shape", """
WITH s AS (SELECT event_id, user_id, value::VARCHAR AS i, (event_id % 7)::VARCHAR AS cr, CASE WHEN event_id % 11 = 0 THEN '-1' ELSE '3' END AS cw, json_extract_string(props, '$.k') AS o,
 CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 5 = 0 THEN md5(props) ELSE sha256(props) END AS h, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS sr FROM events),
v AS (SELECT 'usage.cache_write' AS violation FROM s WHERE cw = '-1' UNION ALL SELECT 'usage.output' FROM s WHERE NOT coalesce(regexp_full_match(o, '[0-9]+'), false)
 UNION ALL SELECT 'request_hash' FROM s WHERE NOT coalesce(regexp_full_match(h, '[0-9a-f]{64}'), false) AND NOT (h IS NULL AND user_id % 2 = 0)
 UNION ALL SELECT 'stop_reason' FROM s WHERE sr = '')
SELECT violation, count(*) AS n FROM v GROUP BY 1""")
def h12_steps_shape(spark, sf):
    e = F.col("event_id")
    steps = read(spark, sf, "events").select(
        "event_id", "user_id", F.floor("value").cast("string").alias("input"), (e % 7).cast("string").alias("cache_read"),
        F.when(e % 11 == 0, "-1").otherwise("3").alias("cache_write"), F.get_json_object("props", "$.k").alias("output"),
        F.when(e % 13 == 0, None).when(e % 5 == 0, F.md5("props")).otherwise(F.sha2("props", 256)).alias("request_hash"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("stop_reason"))
    return (rl.check_steps_shape(steps, ["event_id"], F.col("user_id") % 2 == 0)
            .groupBy("violation").agg(F.count("*").alias("n")))
