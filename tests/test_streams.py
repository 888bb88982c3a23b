"""Streams against their batch twins, fed by files dropped in order."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from conftest import rows
from datarights.operators.ordered import line_bucket
from datarights.streaming import streams as st

T0 = dt.datetime(2024, 1, 1)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def drop(folder, batches):
    folder.mkdir(exist_ok=True)
    for i, batch in enumerate(batches):
        file = folder / f"{i:03}.json"
        file.write_text("\n".join(json.dumps(r) for r in batch))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # a file source reads by time of change


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_tail_of_run_logs(spark, tmp_path):
    d = tmp_path / "advanced"
    d.mkdir()
    (d / "S1-s0.jsonl").write_text('{"type": "run_start"}\nbroken\n{"type": "step"}\n')
    got = drain(st.stream_traces(spark, str(tmp_path)).select("arm", "case", "seed", "type"), "tail")
    assert rows(got) == [("advanced", "S1", 0, "run_start"), ("advanced", "S1", 0, "step")]


MESSAGES = [
    {"type": "system", "model": "m"},
    {"type": "assistant", "message": {"id": "m1", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "c1", "name": "mcp__box__grep", "input": {}}], "usage": {"input_tokens": 5, "output_tokens": 2}}},
    {"type": "assistant", "message": {"id": "m1", "content": [{"type": "tool_use", "id": "c2", "name": "submit_record"}], "usage": {"input_tokens": 7, "output_tokens": 3, "cache_creation": {"ephemeral_1h_input_tokens": 4}}}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": "ok"}, {"type": "tool_result", "tool_use_id": "c2", "content": "{\"accepted\": false}"}]}},
    {"type": "assistant", "message": {"id": "m2", "content": [{"type": "text", "text": "done"}], "usage": {}}},
    {"type": "result", "is_error": False},
]
ITEMS = [
    {"type": "thread.started"},
    {"type": "item.completed", "item": {"type": "reasoning", "id": "i0", "text": "think"}},
    {"type": "item.completed", "item": {"type": "command_execution", "id": "i1", "status": "completed", "exit_code": 1, "aggregated_output": "no"}},
    {"type": "item.completed", "item": {"type": "agent_message", "id": "i2", "text": "so"}},
    {"type": "item.completed", "item": {"type": "mcp_tool_call", "id": "i3", "tool": "submit_record", "status": "completed", "result": {"content": [{"type": "text", "text": "{\"accepted\": true}"}]}}},
    {"type": "item.completed", "item": {"type": "file_change", "id": "i4"}},
    {"type": "turn.completed", "usage": {"input_tokens": 100, "cached_input_tokens": 30, "cache_write_input_tokens": 5, "output_tokens": 9}},
]


def raw(spark, run, events):
    df = spark.createDataFrame([(run, i, json.dumps(e)) for i, e in enumerate(events)], "run_id string, seq bigint, text string")
    return df.select("run_id", "seq", F.try_parse_json("text").alias("obj"))


def test_dialects_and_steps(spark, tmp_path):
    a, b = st.normalise_events(raw(spark, "a", MESSAGES), "messages"), st.normalise_events(raw(spark, "b", ITEMS), "items")
    assert rows(a.where("kind IN ('call', 'result')"), "kind", "call_id", "name", "is_error") == [("call", "c1", "grep", False), ("call", "c2", "submit_record", False), ("result", "c1", None, False), ("result", "c2", None, True)]
    assert rows(a.where("kind = 'open'"), "seq", "input", "output", "cache_1h") == [(1, 5, 2, 0), (2, 7, 3, 4), (4, 0, 0, 0)]
    assert rows(b.where("kind = 'result'"), "call_id", "is_error") == [("i1", True), ("i3", False), ("i4", True)]
    assert rows(b.where("kind = 'usage'"), "input", "cache_read", "cache_write", "output") == [(65, 30, 5, 9)]
    events = a.unionByName(b)
    batch = rows(st.steps_batch(events, 2), "run_id", "step", "message_id", "calls", "results", "errors", "input", "output")
    assert batch == [("a", 1, "m1", 2, 2, 1, 7, 3), ("a", 2, "m2", 0, 0, 0, 0, 0), ("b", 1, None, 1, 1, 1, 0, 0), ("b", 2, None, 1, 1, 0, 0, 0), ("b", 3, None, 1, 1, 1, 65, 9)]
    every = [json.loads(r) for r in events.orderBy("seq", "part").toJSON().collect()]
    drop(tmp_path / "steps", [[e for e in every if e["seq"] <= 2], [e for e in every if e["seq"] == 3], [e for e in every if e["seq"] > 3]])
    got = drain(st.sessionise_steps(stream(spark, tmp_path / "steps", events.schema)), "steps")
    # the stream knows a step once the next one opens or the run ends; run b's last stays open
    assert rows(got, "run_id", "step", "message_id", "calls", "results", "errors", "input", "output") == [s for s in batch if s[:2] != ("b", 3)]


def test_budgets(spark, tmp_path):
    names = ["grep", st.SUBMIT, st.SUBMIT, "grep", st.SUBMIT, "grep", "grep", "grep"]
    calls = [{"run_id": "r", "seq": i, "name": n} for i, n in enumerate(names)] + [{"run_id": "q", "seq": 0, "name": "grep"}]
    drop(tmp_path / "calls", [calls[:3], calls[3:]])
    schema = "run_id string, seq bigint, name string"
    got = drain(st.enforce_budgets(stream(spark, tmp_path / "calls", schema), tools=5, submits=2), "budget")
    assert rows(got.where("NOT bought"), "seq", "stop") == [(4, "max_submits"), (6, "max_submits"), (7, "max_submits")]
    df = spark.createDataFrame([(c["run_id"], c["seq"], c["name"]) for c in calls], schema)
    twin = st.budgets_batch(df, ["run_id"], ["seq"], line_bucket("seq", 3), F.col("name") == st.SUBMIT, 5, 2)
    assert rows(twin) == [("q", 1, 0, None), ("r", 5, 3, "max_submits")]


def test_erasure_timers(spark, tmp_path):
    def e(i, user, day, kind):
        return {"event_id": i, "user_id": user, "ts": (T0 + dt.timedelta(days=day)).isoformat() + "Z", "kind": kind}
    events = [e(1, 1, 0, "marker"), e(2, 2, 0, "marker"), e(3, 3, 0, "marker"), e(4, 1, 3, "purge"), e(5, 3, 1, "marker"), e(6, 3, 6.5, "purge"), e(7, 2, 9, "purge"), e(8, 9, 30, "marker")]
    drop(tmp_path / "promise", [events[:5], events[5:7], events[7:], [e(9, 9, 31, "purge")]])
    schema = "event_id bigint, user_id bigint, ts timestamp, kind string"
    got = drain(st.erasure_timers(stream(spark, tmp_path / "promise", schema), 7), "promise")
    batch = st.erasure_timers_batch(spark.read.schema(schema).json(str(tmp_path / "promise")), 7)
    want = [(1, 1, "purged"), (2, 2, "overdue"), (3, 3, "purged"), (3, 5, "purged"), (9, 8, "purged")]
    assert rows(batch, "user_id", "event_id", "status") == want
    assert rows(got, "user_id", "event_id", "status") == want


def test_late_and_equal_times(spark, tmp_path):
    """A marker that arrives after its purge, and times that are equal but for the event id."""
    def e(i, user, us, kind):
        return {"event_id": i, "user_id": user, "ts": (T0 + dt.timedelta(microseconds=us)).isoformat(timespec="microseconds") + "Z", "kind": kind}
    day = 86_400_000_000
    events = [[e(11, 1, day // 4, "purge"), e(20, 2, 500, "purge"), e(30, 3, 900, "marker")],
              [e(10, 1, 10, "marker"), e(21, 2, 500, "marker"), e(19, 2, 500, "marker"), e(31, 3, 901, "purge"), e(32, 3, 902, "marker")],
              [e(90, 9, 30 * day, "marker")], [e(91, 9, 31 * day, "purge")]]
    drop(tmp_path / "late", events)
    schema = "event_id bigint, user_id bigint, ts timestamp, kind string"
    got = drain(st.erasure_timers(stream(spark, tmp_path / "late", schema), 7), "late")
    batch = st.erasure_timers_batch(spark.read.schema(schema).json(str(tmp_path / "late")), 7)
    want = [(1, 10, "purged"), (2, 19, "purged"), (2, 21, "overdue"), (3, 30, "purged"), (3, 32, "overdue"), (9, 90, "purged")]
    assert rows(batch, "user_id", "event_id", "status") == want
    assert rows(got, "user_id", "event_id", "status") == want


def test_results_of_other_steps(spark, tmp_path):
    """A result counts only while the step that made its call is open."""
    events = [
        {"type": "assistant", "message": {"id": "m1", "content": [{"type": "tool_use", "id": "c1", "name": "grep"}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "stray", "content": "x"}]}},
        {"type": "assistant", "message": {"id": "m2", "content": [{"type": "tool_use", "id": "c2", "name": "grep"}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": "late"}, {"type": "tool_result", "tool_use_id": "c2", "content": "ok"}]}},
        {"type": "result", "is_error": False}]
    table = st.normalise_events(raw(spark, "a", events), "messages")
    want = [("a", 1, 1, 0), ("a", 2, 1, 1)]
    assert rows(st.steps_batch(table, 2), "run_id", "step", "calls", "results") == want
    every = [json.loads(r) for r in table.orderBy("seq", "part").toJSON().collect()]
    drop(tmp_path / "stray", [every[:2], every[2:]])
    assert rows(drain(st.sessionise_steps(stream(spark, tmp_path / "stray", table.schema)), "stray"), "run_id", "step", "calls", "results") == want


def test_totals_and_silence(spark, tmp_path):
    def e(run, minute, cost="1.00"):
        return {"run_id": run, "ts": (T0 + dt.timedelta(minutes=minute)).isoformat() + "Z", "cost": cost, "is_call": True, "is_rejection": minute % 2 == 1}
    events = [e("a", 0), e("a", 5), e("b", 1), e("a", 40), e("a", 61)]
    drop(tmp_path / "live", [events[:3], events[3:], [e("z", 60 * 24 * 3)], [e("z", 60 * 24 * 3 + 1)]])
    schema = "run_id string, ts timestamp, cost decimal(10,2), is_call boolean, is_rejection boolean"
    table = spark.read.schema(schema).json(str(tmp_path / "live"))
    live = drain(st.live_totals(stream(spark, tmp_path / "live", schema)), "live")
    batch = st.live_totals(table)
    assert rows(live.where("run_id <> 'z'")) == rows(batch.where("run_id <> 'z'")) and live.count() >= 3
    ends = spark.createDataFrame([("a", "4.00", 4, 2), ("b", "2.00", 1, 1)], "run_id string, c string, calls bigint, rejections bigint").select("run_id", F.col("c").cast("decimal(10,2)").alias("cost"), "calls", "rejections")
    assert rows(st.reconcile_totals(batch, ends), "run_id") == [("b",)]
    quiet = drain(st.close_silent_runs(stream(spark, tmp_path / "live", schema)), "quiet")
    twin = st.silent_runs_batch(table.withColumn("tie", F.lit(0)), "run_id", "ts", "tie", st.SILENCE_S)
    assert rows(quiet.where("run_id <> 'z'"), "run_id", "ended_at") == rows(twin.where("run_id <> 'z'"), "run_id", "ended_at")
    assert twin.where("run_id = 'a'").count() == 3
