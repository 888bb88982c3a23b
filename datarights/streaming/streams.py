"""Run logs and account events as streams, and the same results as batch jobs.

Streams read rolled files (a file source does not see appends to a file it has read), keep
one small state per run or account, and let event time close what nobody closes. How late an event may
be is the caller's to say; later ones are dropped by Spark and counted in the query's progress. Each stateful
operator has a batch twin that gives the stream's final table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from datarights.operators.ordered import hour_bucket, in_order, line_bucket, placed
from datarights.operators.stats import LARGE_TOOL_BUDGET, SUBMIT_BUDGET, TOOL_BUDGET
from datarights.sources.traces import identity_of

LATE = "1 day"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds a run may be silent before it is closed, small and large repositories.
SILENCE_S, LARGE_SILENCE_S = 900, 1800
SUBMIT = "submit_record"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


# --- sources ------------------------------------------------------------------------------------------------

def stream_traces(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of run logs as they arrive: file, arm, case, seed, obj (VARIANT), type. Bad lines are dropped.

    Writers roll whole files; half a line therefore never arrives.
    """
    raw = spark.readStream.option("recursiveFileLookup", True).text(directory)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("obj")).where("obj IS NOT NULL")
    ident = identity_of(F.col("file"))
    return rows.select("file", ident["arm"].alias("arm"), ident["case"].alias("case"), ident["seed"].try_cast("int").alias("seed"), "obj",
                       F.try_variant_get("obj", "$.type", "string").alias("type"))


# --- two event dialects, one schema -------------------------------------------------------------------------

BLOCKS = ("array<struct<type:string,text:string,thinking:string,id:string,name:string,tool_use_id:string,content:string,is_error:boolean>>")
EVENT_COLUMNS = ["run_id", "seq", "part", "kind", "message_id", "call_id", "name", "text", "is_error", "input", "cache_read", "cache_write", "output", "cache_1h"]


def _path(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("obj", path, kind)


def _count_at(path: str) -> Column:
    n = _path(path, "bigint")
    return F.when(n > 0, n).otherwise(F.lit(0)).cast("bigint")


def _plain_tool(name: Column) -> Column:
    return F.regexp_replace(name, "^mcp__[A-Za-z0-9]+__", "")


def _not_taken(output: Column) -> Column:
    """Whether the answer itself says that the record was not taken."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(output), "$.accepted", "boolean") == F.lit(False), F.lit(False))


def _events(df: DataFrame, **cells) -> DataFrame:
    text = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    base = {"message_id": text, "call_id": text, "name": text, "text": text, "is_error": F.lit(False), "input": zero, "cache_read": zero, "cache_write": zero,
            "output": zero, "cache_1h": zero, "part": F.lit(0)}
    base = {**base, **{c: F.col(c) for c in EVENT_COLUMNS if c in df.columns}, **cells}
    return df.select(*[base[c].alias(c) for c in EVENT_COLUMNS])


def normalise_events(raw: DataFrame, dialect: str) -> DataFrame:
    """`raw` (run_id, seq, obj VARIANT) in one of two dialects -> one event table.

    kinds: open (a message fragment), reasoning, text, call, result, usage, end. Stateless, so the
    same code serves batch and stream.
    """
    kind = _path("$.type")
    if dialect == "messages":
        said = raw.where(kind == "assistant").select("run_id", "seq", F.coalesce(_path("$.message.id"), _path("$.uuid"), F.lit("")).alias("message_id"),
                                                     F.from_json(F.to_json(F.try_variant_get("obj", "$.message.content", "variant")), BLOCKS).alias("blocks"), "obj")
        usage = F.struct(_count_at("$.message.usage.input_tokens").alias("i"), _count_at("$.message.usage.cache_read_input_tokens").alias("cr"),
                         _count_at("$.message.usage.cache_creation_input_tokens").alias("cw"), _count_at("$.message.usage.output_tokens").alias("o"),
                         _count_at("$.message.usage.cache_creation.ephemeral_1h_input_tokens").alias("h"))
        opened = said.withColumn("u", usage)
        first = _events(opened, kind=F.lit("open"), input=F.col("u.i"), cache_read=F.col("u.cr"), cache_write=F.col("u.cw"), output=F.col("u.o"), cache_1h=F.col("u.h"))
        block = said.select("run_id", "seq", "message_id", F.posexplode("blocks").alias("pos", "b"))
        parts = block.where("b.type IN ('text', 'thinking', 'tool_use')")
        inner = _events(parts, kind=F.when(F.col("b.type") == "tool_use", "call").when(F.col("b.type") == "thinking", "reasoning").otherwise("text"), part=F.col("pos") + 1,
                        call_id=F.col("b.id"), name=_plain_tool(F.col("b.name")), text=F.coalesce("b.text", "b.thinking"))
        back = raw.where(kind == "user").select("run_id", "seq", F.posexplode(F.from_json(F.to_json(F.try_variant_get("obj", "$.message.content", "variant")), BLOCKS)).alias("pos", "b")).where("b.type = 'tool_result'")
        results = _events(back, kind=F.lit("result"), part=F.col("pos") + 1, call_id=F.col("b.tool_use_id"), text=F.col("b.content"),
                          is_error=F.coalesce("b.is_error", F.lit(False)) | _not_taken(F.col("b.content")))
        ends = _events(raw.where(kind == "result"), kind=F.lit("end"), is_error=F.coalesce(_path("$.is_error", "boolean"), F.lit(False)))
        return first.unionByName(inner).unionByName(results).unionByName(ends)
    if dialect != "items":
        raise ValueError(f"unknown dialect {dialect!r}")
    item = raw.where(kind == "item.completed").withColumn("t", _path("$.item.type"))
    talk = _events(item.where("t IN ('reasoning', 'agent_message')"), kind=F.when(F.col("t") == "reasoning", "reasoning").otherwise("text"), text=_path("$.item.text"))
    tool = item.where("t IN ('command_execution', 'mcp_tool_call', 'file_change')")
    output = F.when(F.col("t") == "command_execution", _path("$.item.aggregated_output")).otherwise(_path("$.item.result.content[0].text"))
    done = F.coalesce(_path("$.item.status") == "completed", F.lit(False))
    failed = (F.when(F.col("t") == "file_change", F.lit(True)).when(F.col("t") == "command_execution", ~done | ~F.coalesce(_path("$.item.exit_code", "int") == 0, F.lit(False)))
              .otherwise(~done | _path("$.item.error.message").isNotNull() | _not_taken(output)))
    name = F.when(F.col("t") == "command_execution", "shell").when(F.col("t") == "file_change", "file_change").otherwise(_plain_tool(_path("$.item.tool")))
    tool = tool.withColumn("call_id", _path("$.item.id"))
    calls = _events(tool, kind=F.lit("call"), call_id=F.col("call_id"), name=name)
    results = _events(tool, kind=F.lit("result"), part=F.lit(1), call_id=F.col("call_id"), text=output, is_error=failed)
    total, cached, written = _count_at("$.usage.input_tokens"), _count_at("$.usage.cached_input_tokens"), _count_at("$.usage.cache_write_input_tokens")
    used = raw.where(kind == "turn.completed").withColumn("u", F.struct(total.alias("t"), F.least(cached, total).alias("c"), _count_at("$.usage.output_tokens").alias("o")))
    used = used.withColumn("w", F.least(written, F.greatest(F.lit(0), F.col("u.t") - F.col("u.c"))))
    usage = _events(used, kind=F.lit("usage"), input=F.col("u.t") - F.col("u.c") - F.col("w"), cache_read=F.col("u.c"), cache_write=F.col("w").cast("bigint"), output=F.col("u.o"))
    ends = _events(raw.where(kind == "turn.failed"), kind=F.lit("end"), is_error=F.lit(True))
    return talk.unionByName(calls).unionByName(results).unionByName(usage).unionByName(ends)


# --- steps ----------------------------------------------------------------------------------------------------

STEP_SCHEMA = "run_id string, step int, message_id string, calls int, results int, errors int, input bigint, output bigint, closed boolean"


class _Stepper(StatefulProcessor):
    """Folds one run's events into steps; the open step and its calls are the only state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "step int, message_id string, calls int, results int, errors int, input bigint, output bigint, has_call boolean, ids array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        state = list(self.open.get()) if self.open.exists() else None
        for e in sorted(rows, key=lambda r: (r.seq, r.part)):
            if e.kind == "end":
                if state is not None:
                    yield _step_row(key[0], state, True)
                state = [state[0] if state else 0, None, 0, 0, 0, 0, 0, None, []]
                continue
            fresh = (e.kind == "open" and (state is None or state[1] != e.message_id)) or (
                e.message_id is None and e.kind in ("text", "reasoning", "call") and (state is None or state[7] is not False))
            if fresh:
                if state is not None and state[7] is not None:
                    yield _step_row(key[0], state, False)
                state = [(state[0] if state else 0) + 1, e.message_id, 0, 0, 0, 0, 0, False, []]
            if state is None or state[7] is None:
                continue
            if e.kind == "call":
                state[2], state[7], state[8] = state[2] + 1, True, [*state[8], e.call_id]
            elif e.kind == "result":
                mine = e.call_id in state[8]
                state[3], state[4] = state[3] + mine, state[4] + (mine and e.is_error)
            elif e.input or e.output:
                state[5], state[6] = (state[5] + e.input, state[6] + e.output) if e.kind == "usage" else (e.input, e.output)
        if state is not None:
            self.open.update(tuple(state))

    def close(self) -> None:
        pass


def _step_row(run_id: str, s: list, closed: bool) -> Row:
    return Row(run_id=run_id, step=s[0], message_id=s[1], calls=s[2], results=s[3], errors=s[4], input=s[5], output=s[6], closed=closed)


def sessionise_steps(events: DataFrame) -> DataFrame:
    """Streaming steps: a new message id closes the step before it, an end event the last one.

    A result counts for the step whose call it answers, and only while that step is open.

    In the dialect without message ids a call closes the step: what follows opens the next, and
    the run's usage lands on the step open when it arrives.
    """
    return events.groupBy("run_id").transformWithState(_Stepper(), STEP_SCHEMA, "Append", "None")


def steps_batch(events: DataFrame, size: int = 4096) -> DataFrame:
    """The batch twin: step numbers from a running count of the events that open a step."""
    order, bucket = ["seq", "part"], line_bucket("seq", size)
    items = events.where("kind = 'open' OR (message_id IS NULL AND kind IN ('text', 'reasoning', 'call'))")
    marked = in_order(items, ["run_id"], order, bucket, previous={"prev_id": "message_id", "prev_kind": "kind"}, number="pos")
    opens = F.when(F.col("kind") == "open", (F.col("pos") == 1) | ~F.col("message_id").eqNullSafe(F.col("prev_id"))).otherwise((F.col("pos") == 1) | (F.col("prev_kind") == "call"))
    flags = marked.select("run_id", "seq", "part", opens.cast("int").alias("opens"))
    every = events.join(flags, ["run_id", "seq", "part"], "left")
    placed = in_order(every, ["run_id"], order, bucket, sums={"step": F.coalesce("opens", F.lit(0))}).where("step > 0 AND kind <> 'end'")
    called = placed.where("kind = 'call'").select("run_id", "step", "call_id", F.struct("seq", "part").alias("_called"))
    called = called.groupBy("run_id", "step", "call_id").agg(F.min("_called").alias("_called"))
    placed = placed.join(called, ["run_id", "step", "call_id"], "left")
    answer = (F.col("kind") == "result") & F.coalesce(F.col("_called") < F.struct("seq", "part"), F.lit(False))
    is_open = F.col("kind") == "open"
    shown = is_open & ((F.col("input") > 0) | (F.col("output") > 0))
    used = F.col("kind") == "usage"
    at = F.struct("seq", "part")
    steps = placed.groupBy("run_id", F.col("step").cast("int").alias("step")).agg(
        F.min_by(F.when(is_open, F.col("message_id")), at).alias("message_id"), F.count_if(F.col("kind") == "call").cast("int").alias("calls"),
        F.count_if(answer).cast("int").alias("results"), F.count_if(answer & F.col("is_error")).cast("int").alias("errors"),
        *[(F.coalesce(F.max_by(F.when(shown, F.col(c)), F.when(shown, at)), F.lit(0)) + F.coalesce(F.sum(F.when(used, F.col(c))), F.lit(0))).cast("bigint").alias(c) for c in ("input", "output")])
    return steps


# --- budgets -----------------------------------------------------------------------------------------------------

class _Budget(StatefulProcessor):
    """Counts what a run bought; calls past a budget are marked and the first stop sticks."""

    def __init__(self, tools: int, submits: int) -> None:
        self.limits = (tools, submits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "tools int, submits int, stop string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        tools, submits, stop = self.seen.get() if self.seen.exists() else (0, 0, None)
        for call in sorted(rows, key=lambda r: r.seq):
            over = "budget_exhausted" if tools >= self.limits[0] else "max_submits" if call.name == SUBMIT and submits >= self.limits[1] else None
            if over is None:
                tools, submits = tools + 1, submits + (call.name == SUBMIT)
            stop = stop or over
            yield Row(run_id=key[0], seq=call.seq, name=call.name, bought=over is None, stop=stop)
        self.seen.update((tools, submits, stop))

    def close(self) -> None:
        pass


def enforce_budgets(calls: DataFrame, tools: int = TOOL_BUDGET, submits: int = SUBMIT_BUDGET) -> DataFrame:
    """`calls` (run_id, seq, name) as a stream -> the same with `bought` and the run's first `stop`."""
    return calls.groupBy("run_id").transformWithState(_Budget(tools, submits), "run_id string, seq bigint, name string, bought boolean, stop string", "Append", "None")


def budgets_batch(calls: DataFrame, run: list[str], order: list[str], bucket: Column, is_submit: Column, tools: int, submits: int) -> DataFrame:
    """The batch twin: per run what was bought, dropped, and the first reason to stop.

    A submission past its budget is dropped and buys nothing; the others use up the tool budget.
    """
    c = calls.withColumn("_submit", is_submit.cast("int"))
    c = in_order(c, run, order, bucket, sums={"_s": F.col("_submit")})
    fits = (F.col("_submit") == 0) | (F.col("_s") <= submits)
    c = in_order(c.withColumn("_fits", fits), run, order, bucket, sums={"_t": F.col("_fits").cast("int")})
    spent = F.col("_t") - F.col("_fits").cast("int") >= tools
    why = F.when(spent, "budget_exhausted").when(~F.col("_fits"), "max_submits")
    return c.withColumn("_why", why).groupBy(*run).agg(
        F.count_if(F.col("_why").isNull()).alias("bought"), F.count_if(F.col("_why").isNotNull()).alias("dropped"),
        F.min_by("_why", F.when(F.col("_why").isNotNull(), F.struct(*order))).alias("stop"))


# --- erasure promises ---------------------------------------------------------------------------------------------

class _Promise(StatefulProcessor):
    """One account's soft deletes waiting for a purge, each with an event-time timer.

    Times are whole microseconds, and equal times go by event id. Purges are kept for as long as a
    marker from before them may still arrive.
    """

    def __init__(self, days: int) -> None:
        self.wait = days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "event_id bigint", "us bigint")
        self.purges = handle.getMapState("purges", "event_id bigint", "us bigint")

    def _keeps(self, marker: tuple[int, int], purge: tuple[int, int]) -> bool:
        return marker <= purge and purge[0] <= marker[0] + self.wait

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for e in sorted(rows, key=lambda r: (r.us, r.event_id)):
            here = (e.us, e.event_id)
            if e.kind == "marker":
                if any(self._keeps(here, (us[0], ident[0])) for ident, us in self.purges.iterator()):
                    yield Row(user_id=key[0], event_id=e.event_id, status="purged")
                else:
                    self.waiting.updateValue((e.event_id,), (e.us,))
                    self.handle.registerTimer((e.us + self.wait) // 1000 + 1)
                continue
            self.purges.updateValue((e.event_id,), (e.us,))
            self.handle.registerTimer(e.us // 1000 + 1)
            for ident, us in list(self.waiting.iterator()):
                if self._keeps((us[0], ident[0]), here):
                    self.waiting.removeKey(ident)
                    yield Row(user_id=key[0], event_id=ident[0], status="purged")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for ident, us in list(self.purges.iterator()):
            if us[0] < now:
                self.purges.removeKey(ident)
        for ident, us in list(self.waiting.iterator()):
            if us[0] + self.wait < now:
                self.waiting.removeKey(ident)
                yield Row(user_id=key[0], event_id=ident[0], status="overdue")

    def close(self) -> None:
        pass


def erasure_timers(events: DataFrame, days: int, late: str = LATE) -> DataFrame:
    """`events` (user_id, event_id, ts, kind marker/purge) as a stream -> purged or overdue markers."""
    timed = events.where("kind IN ('marker', 'purge')").withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("user_id").transformWithState(_Promise(days), "user_id bigint, event_id bigint, status string", "Append", "eventTime")


def erasure_timers_batch(events: DataFrame, days: int, bucket: Column | None = None) -> DataFrame:
    """The batch twin: each marker beside the account's next purge.

    purged within the days, overdue once they have passed, else pending (by the newest event).
    """
    e = in_order(events, ["user_id"], ["ts", "event_id"], hour_bucket("ts") if bucket is None else bucket, upcoming={"next_purge": F.when(F.col("kind") == "purge", F.col("ts"))})
    newest = events.agg(F.max("ts")).scalar()
    due = F.col("ts") + F.make_dt_interval(F.lit(days))
    marked = e.where("kind = 'marker'")
    status = F.when(F.col("next_purge") <= due, "purged").when(newest > due, "overdue").otherwise("pending")
    return marked.select("user_id", "event_id", status.alias("status"))


# --- totals and silence ---------------------------------------------------------------------------------------------

def live_totals(events: DataFrame, window: str = "1 hour", late: str = LATE) -> DataFrame:
    """Cost, calls and rejections per run and window; windows close with the watermark.

    `events`: run_id, ts, cost (decimal), is_call, is_rejection. Works on streams and tables alike.
    """
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy("run_id", F.window("ts", window)).agg(
        F.sum("cost").alias("cost"), F.count_if("is_call").alias("calls"), F.count_if("is_rejection").alias("rejections")).select(
        "run_id", F.col("window.start").alias("start"), "cost", "calls", "rejections")


def reconcile_totals(totals: DataFrame, ends: DataFrame) -> DataFrame:
    """Runs whose end line does not agree with the sum of what streamed."""
    run = totals.groupBy("run_id").agg(F.sum("cost").alias("cost"), F.sum("calls").alias("calls"), F.sum("rejections").alias("rejections"))
    told = ends.select("run_id", *[F.col(c).alias(f"told_{c}") for c in ("cost", "calls", "rejections")])
    differs = ~F.col("cost").eqNullSafe(F.col("told_cost")) | ~F.col("calls").eqNullSafe(F.col("told_calls")) | ~F.col("rejections").eqNullSafe(F.col("told_rejections"))
    return told.join(run, "run_id", "left").where(differs)


def close_silent_runs(events: DataFrame, seconds: int = SILENCE_S, late: str = LATE) -> DataFrame:
    """A synthetic end for every stretch of a run that went silent for `seconds` (streaming)."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    quiet = timed.groupBy("run_id", F.session_window("ts", f"{seconds} seconds")).agg(F.count("*").alias("events"))
    return quiet.select("run_id", F.col("session_window.end").alias("ended_at"), "events", F.lit("timeout").alias("stop"))


def silent_runs_batch(events: DataFrame, run: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """The batch twin, closed stretches only: one row per gap of at least `seconds`.

    The last stretch of a run is closed once the newest event of all is that far ahead.
    """
    seen = placed(events, [run], [ts, tie], previous={"_prev": ts})
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))
    gaps = seen.where(F.col("_prev").isNotNull() & (F.col(ts) >= F.col("_prev") + wait)).select(run, (F.col("_prev") + wait).alias("ended_at"))
    newest = events.agg(F.max(ts)).scalar()
    last = events.groupBy(run).agg(F.max(ts).alias("_last")).where(newest >= F.col("_last") + wait)
    return gaps.unionByName(last.select(run, (F.col("_last") + wait).alias("ended_at")))


BUDGETS = {"small": (TOOL_BUDGET, SUBMIT_BUDGET), "large": (LARGE_TOOL_BUDGET, SUBMIT_BUDGET)}
