"""Batch twins of the streaming operators over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from datarights.operators.ordered import hour_bucket, in_order, line_bucket
from datarights.plans.registry import query, read
from datarights.streaming import streams as st


@query("j2_steps", """
WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'm' || turn END AS mid FROM conversations WHERE role <> 'system'),
o AS (SELECT conv_id, turn, mid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM c WHERE role = 'user')
SELECT o.conv_id::VARCHAR AS run_id, o.step::INT AS step, o.mid AS message_id, (o.turn % 3 <> 0)::INT AS calls,
 count(*) FILTER (c.role = 'assistant' AND o.turn % 3 <> 0 AND c.turn % 4 <> 1)::INT AS results FROM o
LEFT JOIN c ON c.conv_id = o.conv_id AND c.turn >= o.turn AND (o.nxt IS NULL OR c.turn < o.nxt) GROUP BY ALL""")
def j2_steps(spark, sf):
    """A user's turn opens a step, most with a call; an answer names that call, a strange one, or comes where no call was made."""
    conv = read(spark, sf, "conversations").where("role <> 'system'")
    turns = conv.select(F.col("conv_id").cast("string").alias("run_id"), F.col("turn").alias("seq"), (F.col("role") == "user").alias("u"))
    asked = in_order(turns, ["run_id"], ["seq"], line_bucket("seq"), sums={"step": F.col("u").cast("int")})
    call = F.concat(F.lit("c"), F.col("step").cast("string"))
    opens = st._events(asked.where("u"), kind=F.lit("open"), message_id=F.concat(F.lit("m"), F.col("seq").cast("string")))
    calls = st._events(asked.where("u AND seq % 3 <> 0"), kind=F.lit("call"), part=F.lit(1), call_id=call)
    results = st._events(asked.where("NOT u"), kind=F.lit("result"), call_id=F.when(F.col("seq") % 4 == 1, "strange").otherwise(call))
    return st.steps_batch(opens.unionByName(calls).unionByName(results)).select("run_id", "step", "message_id", "calls", "results")


@query("j3_budgets", """
WITH c AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS sub FROM events WHERE event_type IN ('click', 'view', 'purchase')),
a AS (SELECT *, NOT sub OR sum(sub::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5 AS fits FROM c),
b AS (SELECT *, sum(fits::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) - fits::INT >= 30 AS spent FROM a),
d AS (SELECT *, CASE WHEN spent THEN 'budget_exhausted' WHEN NOT fits THEN 'max_submits' END AS why FROM b)
SELECT user_id, count(*) FILTER (why IS NULL) AS bought, count(*) FILTER (why IS NOT NULL) AS dropped, arg_min(why, struct_pack(ts, event_id)) FILTER (why IS NOT NULL) AS stop FROM d GROUP BY 1""")
def j3_budgets(spark, sf):
    calls = read(spark, sf, "events").where("event_type IN ('click', 'view', 'purchase')").select("user_id", "ts", "event_id", "event_type")
    return st.budgets_batch(calls, ["user_id"], ["ts", "event_id"], hour_bucket("ts"), F.col("event_type") == "purchase", 30, 5)


@query("j4_erasure_timers", """
WITH m AS (SELECT user_id, event_id, ts, (SELECT min(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) >= (e.ts, e.event_id)) AS nxt FROM events e WHERE event_type = 'signup')
SELECT user_id, event_id, CASE WHEN nxt <= ts + INTERVAL 2 DAY THEN 'purged' WHEN (SELECT max(ts) FROM events WHERE event_type IN ('signup', 'purchase')) > ts + INTERVAL 2 DAY THEN 'overdue' ELSE 'pending' END AS status FROM m""")
def j4_erasure_timers(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "marker").when(F.col("event_type") == "purchase", "purge")
    events = read(spark, sf, "events").select("user_id", "event_id", "ts", kind.alias("kind")).where("kind IS NOT NULL")
    return st.erasure_timers_batch(events, 2)


@query("j5_live_totals", """
SELECT user_id AS run_id, date_trunc('hour', ts) AS start, sum(value::DECIMAL(18,2))::DOUBLE AS cost, count(*) FILTER (event_type IN ('click', 'view')) AS calls, count(*) FILTER (event_type = 'error') AS rejections FROM events GROUP BY 1, 2""")
def j5_live_totals(spark, sf):
    kind = F.col("event_type")
    events = read(spark, sf, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("value").cast("decimal(18,2)").alias("cost"),
                                              kind.isin("click", "view").alias("is_call"), (kind == "error").alias("is_rejection"))
    return st.live_totals(events).withColumn("cost", F.col("cost").cast("double"))


@query("j6_silent_runs", """
WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), w AS (SELECT INTERVAL 12 HOUR AS g),
l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
SELECT user_id, prev + g AS ended_at FROM p, w WHERE ts >= prev + g UNION ALL SELECT user_id, last + g FROM l, w WHERE (SELECT max(ts) FROM events) >= last + g""")
def j6_silent_runs(spark, sf):
    events = read(spark, sf, "events").select("user_id", "ts", "event_id")
    return st.silent_runs_batch(events, "user_id", "ts", "event_id", 12 * 3600)


@query("j7_normalised", """
WITH e AS (SELECT user_id::VARCHAR AS run_id, event_type AS t, json_extract(props, '$.k')::BIGINT AS k FROM events)
SELECT kind, is_error, count(*) AS n, sum(i)::BIGINT AS input, sum(cr)::BIGINT AS cache_read FROM (
 SELECT 'text' AS kind, false AS is_error, 0 AS i, 0 AS cr FROM e WHERE t = 'view'
 UNION ALL SELECT 'call', false, 0, 0 FROM e WHERE t IN ('click', 'error')
 UNION ALL SELECT 'result', t = 'error', 0, 0 FROM e WHERE t IN ('click', 'error')
 UNION ALL SELECT 'usage', false, k - least(3, k), least(3, k) FROM e WHERE t = 'purchase') GROUP BY 1, 2""")
def j7_normalised(spark, sf):
    e, kind, k = read(spark, sf, "events"), F.col("event_type"), F.get_json_object("props", "$.k")
    item = F.when(kind == "view", F.to_json(F.struct(F.lit("agent_message").alias("type"), F.lit("seen").alias("text")))).otherwise(F.to_json(F.struct(
        F.lit("command_execution").alias("type"), F.col("event_id").cast("string").alias("id"), F.lit("completed").alias("status"),
        F.when(kind == "error", 1).otherwise(0).alias("exit_code"), F.lit("out").alias("aggregated_output"))))
    text = (F.when(kind == "purchase", F.concat(F.lit('{"type": "turn.completed", "usage": {"cached_input_tokens": 3, "input_tokens": '), k, F.lit("}}")))
            .when(kind.isin("view", "click", "error"), F.concat(F.lit('{"type": "item.completed", "item": '), item, F.lit("}"))).otherwise(F.lit('{"type": "thread.started"}')))
    raw = e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.try_parse_json(text).alias("obj"))
    return st.normalise_events(raw, "items").groupBy("kind", "is_error").agg(F.count("*").alias("n"), F.sum("input").alias("input"), F.sum("cache_read").alias("cache_read"))
