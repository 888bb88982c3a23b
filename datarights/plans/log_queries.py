"""Logs written from `events`, one run per user and kind of event, and every check over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.operators.logcheck import check_logs
from datarights.operators.ordered import in_order
from datarights.plans.registry import query, read
from datarights.session import scratch_path
from datarights.sources.traces import numbered_lines, read_traces

PATH = r"arm=([^/]+)/case=([^/]+)/seed=([^/]+)/"
KEYS = ["arm", "case", "seed"]
HEADER = r"^==> (.+) <==$"


def log_lines(spark, sf: str) -> DataFrame:
    """arm, case, seed, place, text: a start line, a step per event and an end line, with faults at chosen ids."""
    e = read(spark, sf, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_type") == "purchase", "advanced").otherwise("baseline").alias("arm"),
                                         F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("case"), F.crc32(F.col("event_type").cast("binary")).cast("string").alias("seed"))
    i = F.col("event_id")
    e = in_order(e, ["user_id", "event_type"], ["event_id"], F.floor(i / 4096).cast("bigint"), number="p")
    dup, slip = i % 29 == 0, i % 23 == 0
    call = F.when(dup, F.lit("again")).otherwise(F.concat(F.lit("c"), i.cast("string")))
    name = F.when(i % 7 == 0, "submit_record").otherwise("read")
    said = r'", "output": "{\"accepted\": false}"}]'
    answer = F.when(i % 13 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"call_id": "'), call, F.lit(said)))
    step = F.concat(F.lit('{"type": "step", "step": '), F.when(i % 31 == 0, F.col("p") + 5).otherwise(F.col("p")).cast("string"), F.lit(', "tool_calls": [{"id": "'), call, F.lit('", "name": "'), name,
                    F.lit('"}], "tool_results": '), answer, F.lit(', "usage": {"input": 1, "cache_read": 0, "cache_write": 0, "output": '), F.when(i % 37 == 0, "-1").otherwise("2"),
                    F.lit('}, "stop_reason": "end", "request_hash": "'), F.repeat(F.lit("ab"), 32), F.lit('", "cost_usd": 1.0, "cost_cum_usd": '),
                    (F.col("p") + F.when(slip, 0.5).otherwise(0.0)).cast("string"), F.lit("}"))
    text = F.when(i % 97 == 0, '{"type": "ste').otherwise(step)
    steps = e.select(*KEYS, (F.col("p") + 1).alias("place"), text.alias("text"))
    sums = e.groupBy("user_id", "event_type", *KEYS).agg(F.count("*").alias("n"), F.sum((i % 7 == 0).cast("int")).alias("s"), F.sum(((i % 7 == 0) & (i % 13 != 0)).cast("int")).alias("r"),
                                                      F.max_by(slip, "p").alias("_slip"))
    u = F.col("user_id")
    first = F.concat(F.lit('{"type": "run_start", "case": "'), F.when(u % 5 == 0, "S").otherwise(F.col("case")), F.lit('", "seed": '), "seed", F.lit(', "arm": "'), "arm",
                     F.lit('", "mode": "live", "model": "large", "config": {"overridden": ["'), F.when(u % 7 == 0, "OTHER").otherwise("TOOL_BUDGET"), F.lit('"], "tool_budget": 1000000}}'))
    cost = F.col("n") + F.when(F.col("_slip"), 0.5).otherwise(0.0)
    last = F.concat(F.lit('{"type": "'), F.when(u % 11 == 3, "end").otherwise("run_end"), F.lit('", "stop_condition": "'), F.when(u % 4 == 0, "stopped").otherwise("max_submits"), F.lit('", "steps": '), F.col("n").cast("string"),
                    F.lit(', "tool_calls_total": '), (F.col("n") + (u % 3 == 0).cast("int")).cast("string"), F.lit(', "submits": '), F.col("s").cast("string"), F.lit(', "verify_rounds": '),
                    F.col("r").cast("string"), F.lit(', "cost_usd": '), cost.cast("string"), F.lit("}"))
    edges = sums.select(*KEYS, F.inline(F.array(F.struct(F.lit(1).cast("bigint").alias("place"), first.alias("text")), F.struct((F.col("n") + 2).alias("place"), last.alias("text")))))
    return steps.unionByName(edges)


def written(spark, sf: str) -> str:
    """The logs in files, many a file, each after a header that names it; a run's lines are sorted and stand in one file.

    A folder and a file for every run would cost a listing, a rename and an open each, which is most of the work."""
    path, lines = scratch_path(spark, "logs"), log_lines(spark, sf)
    name = F.concat(F.lit("==> arm="), "arm", F.lit("/case="), "case", F.lit("/seed="), "seed", F.lit("/run.jsonl <=="))
    heads = lines.where("place = 1").select(*KEYS, F.lit(0).cast("bigint").alias("place"), name.alias("text"))
    lines.unionByName(heads).repartition(*KEYS).sortWithinPartitions(*KEYS, "place").select("text").write.text(path, lineSep="\n")
    return path


def _run(file) -> list:
    return [F.regexp_extract(file, PATH, k + 1).alias(c) for k, c in enumerate(KEYS)]


FAULTS_SQL = """e AS (SELECT user_id AS u, event_type AS t, event_id AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS p FROM events),
g AS (SELECT u, t, count(*) AS n, bool_or(i % 97 = 0) AS broken, count(*) FILTER (i % 7 = 0) AS s, max(p) AS last FROM e GROUP BY 1, 2),
ok AS (SELECT * FROM g WHERE NOT broken AND u % 11 <> 3), oe AS (SELECT e.*, ok.n FROM e JOIN ok USING (u, t)),
before AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY u, t ORDER BY i) % 23 = 0, false) AS slipped, min(p) FILTER (i % 29 = 0) OVER (PARTITION BY u, t) AS d FROM oe),
x AS (SELECT u, t, p + 1 AS line, 1 AS "check" FROM e WHERE i % 97 = 0 UNION ALL SELECT u, t, 0, 2 FROM g WHERE NOT broken AND u % 11 = 3
 UNION ALL SELECT u, t, p + 1, 3 FROM oe WHERE i % 31 = 0 UNION ALL SELECT u, t, p + 1, 4 FROM oe WHERE i % 13 = 0 AND p < n
 UNION ALL SELECT u, t, p + 1, 5 FROM before WHERE i % 29 = 0 AND p > d UNION ALL SELECT u, t, p + 1, 6 FROM before WHERE (i % 23 = 0) <> slipped UNION ALL SELECT u, t, p + 1, 12 FROM oe WHERE i % 37 = 0
 UNION ALL SELECT u, t, n + 2, 7 FROM ok WHERE u % 3 = 0 UNION ALL SELECT u, t, n + 2, 8 FROM ok WHERE s > 5 UNION ALL SELECT u, t, n + 2, 14 FROM ok WHERE u % 4 = 0
 UNION ALL SELECT u, t, n + 2, 8 FROM ok WHERE u % 7 = 0 AND n + (u % 3 = 0)::INT > 60
 UNION ALL SELECT u, t, 1, 13 FROM ok WHERE u % 5 = 0 UNION ALL SELECT u, t, 1, 18 FROM ok WHERE u % 7 = 0)"""


@query("h0_check_logs", f"""WITH {FAULTS_SQL} SELECT 'S' || u AS "case", (CASE WHEN t = 'purchase' THEN 'advanced' ELSE 'baseline' END) AS arm, line::BIGINT AS line, "check"::INT AS "check", count(*)::BIGINT AS n
FROM x GROUP BY ALL""")
def h0_check_logs(spark, sf):
    """Runs with a broken line are told that alone, and so are runs without an end."""
    lines = read_traces(spark, written(spark, sf), "strict", HEADER)
    found = check_logs(lines, "large", ["TOOL_BUDGET", "SUBMIT_BUDGET"], F.struct(*_run("file")))
    return found.select(*_run("file"), "line", "check").groupBy("case", "arm", "line", "check").agg(F.count("*").alias("n"))


@query("a8_numbered_lines", """WITH e AS (SELECT user_id, event_type, count(*) AS n, bool_or(event_id % 97 = 0) AS broken FROM events GROUP BY 1, 2)
SELECT 'S' || user_id AS "case", count(*) AS logs, sum(n + 2)::BIGINT AS lines, sum((n + 2) * (n + 3) / 2)::BIGINT AS numbers FROM e GROUP BY user_id""")
def a8_numbered_lines(spark, sf):
    """Lines are numbered 1 to their count in every log."""
    lines = numbered_lines(spark, written(spark, sf), header=HEADER).groupBy("file").agg(F.count("*").alias("n"), F.sum("line").alias("s"), F.max("line").alias("m"), F.countDistinct("line").alias("d")).where("n = m AND n = d")
    return lines.select(*_run("file"), "n", "s").groupBy("case").agg(F.count("*").alias("logs"), F.sum("n").alias("lines"), F.sum("s").alias("numbers"))
