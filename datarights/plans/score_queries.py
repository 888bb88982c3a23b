"""Scoring and statistics: document labels as truth, two text rules as the arms compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from datarights.operators import scoring as sc
from datarights.operators import stats as st
from datarights.plans.registry import query, read

ARMS = ["long", "plain"]

BASE_SQL = """
truth AS (SELECT source AS "case", doc_id % 3 AS seed, doc_id, CASE WHEN toxic = 1 THEN 'pseudonymised' WHEN quality = 1 THEN 'erased' ELSE 'not_erased' END AS verdict
  FROM labels JOIN documents USING (doc_id)),
pred AS (
  SELECT 'long' AS arm, source AS "case", doc_id % 3 AS seed, doc_id, CASE WHEN n_chars >= 1200 THEN 'erased' WHEN n_chars >= 600 THEN 'unverified' ELSE 'not_erased' END AS verdict
  FROM documents WHERE n_chars >= 150
  UNION ALL SELECT 'plain', source, doc_id % 3, doc_id, CASE WHEN contains(text, '@') THEN 'unverified' WHEN lang = 'en' THEN 'erased' ELSE 'not_erased' END
  FROM documents WHERE n_chars >= 300),
arms AS (SELECT unnest(['long', 'plain']) AS arm),
m AS (SELECT coalesce(p.arm, t.arm) AS arm, coalesce(p."case", t."case") AS "case", coalesce(p.seed, t.seed) AS seed, coalesce(p.doc_id, t.doc_id) AS doc_id,
  p.verdict AS pv, t.verdict AS tv, p.verdict = 'erased' AS pr, t.verdict = 'erased' AS tr, p.arm IS NOT NULL AS ip, t.arm IS NOT NULL AS it
  FROM pred p FULL JOIN (SELECT * FROM truth, arms) t ON p.arm = t.arm AND p."case" = t."case" AND p.seed = t.seed AND p.doc_id = t.doc_id),
c AS (SELECT arm, "case", seed, count(*) FILTER (ip AND it AND pr = tr) AS tp, count(*) FILTER (ip AND NOT (ip AND it AND pr IS NOT DISTINCT FROM tr)) AS fp,
  count(*) FILTER (it AND NOT (ip AND it AND pr IS NOT DISTINCT FROM tr)) AS fn, count(*) FILTER (ip AND it AND pr AND NOT tr) AS false_safe,
  count(*) FILTER (ip AND NOT it AND pr) AS unmatched_reaching, count(*) FILTER (ip AND pv = 'unverified') AS unverified FROM m GROUP BY 1, 2, 3),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp)::DOUBLE ELSE 0 END AS p0, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn)::DOUBLE ELSE 0 END AS r0 FROM c),
s AS (SELECT * EXCLUDE (p0, r0), p0 AS "precision", r0 AS recall, CASE WHEN p0 + r0 > 0 THEN 2.0::DOUBLE * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f1 FROM pr),
runs AS (SELECT *, f1 >= 0.3 AS passed, CASE WHEN "precision" >= 0.2 THEN 'accepted' ELSE 'budget_exhausted' END AS stop FROM s)
"""


def truth(spark, sf):
    labels = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    verdict = (F.when(F.col("toxic") == 1, "pseudonymised").when(F.col("quality") == 1, "erased").otherwise("not_erased"))
    return labels.select(F.col("source").alias("case"), (F.col("doc_id") % 3).alias("seed"), "doc_id", verdict.alias("verdict"))


def predictions(spark, sf):
    docs = read(spark, sf, "documents")
    long = F.when(F.col("n_chars") >= 1200, "erased").when(F.col("n_chars") >= 600, "unverified").otherwise("not_erased")
    plain = (F.when(F.col("text").contains("@"), "unverified").when(F.col("lang") == "en", "erased").otherwise("not_erased"))
    # One pass over the documents: each arm's verdict is a column, the arms are unfolded after.
    both = docs.select("doc_id", "source", F.when(F.col("n_chars") >= 150, long).alias("long"),
                       F.when(F.col("n_chars") >= 300, plain).alias("plain"))
    return both.select("doc_id", F.col("source").alias("case"), (F.col("doc_id") % 3).alias("seed"),
                       F.expr("stack(2, 'long', long, 'plain', plain) AS (arm, verdict)")).where("verdict IS NOT NULL")


def matched(spark, sf):
    reaches = (F.col("verdict") == "erased").alias("reaches")
    t = truth(spark, sf).withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ARMS])))
    keys = ["arm", "case", "seed", "doc_id"]
    return sc.match_tuples(predictions(spark, sf).select("*", reaches), t.select("*", reaches), keys)


def runs(spark, sf):
    scored = sc.score(matched(spark, sf), ["arm", "case", "seed"])
    return scored.withColumns({
        "passed": F.col("f1") >= 0.3,
        "stop": F.when(F.col("precision") >= 0.2, "accepted").otherwise("budget_exhausted")})


@query("c11_match_tuples", f"WITH {BASE_SQL} SELECT arm, \"case\", ip AS in_pred, it AS in_truth, count(*) AS n FROM m GROUP BY ALL")
def c11_match_tuples(spark, sf):
    return matched(spark, sf).groupBy("arm", "case", "in_pred", "in_truth").agg(F.count("*").alias("n"))


@query("d1_set_check", f"""WITH {BASE_SQL}, p AS (SELECT DISTINCT arm, "case", verdict FROM pred), t AS (SELECT DISTINCT arm, "case", verdict FROM truth, arms)
SELECT arm, count(*) FILTER (i AND j) AS matched, count(*) FILTER (NOT i) AS missing, count(*) FILTER (NOT j) AS spurious FROM
(SELECT coalesce(p.arm, t.arm) AS arm, p.arm IS NOT NULL AS i, t.arm IS NOT NULL AS j FROM p FULL JOIN t ON p.arm = t.arm AND p."case" = t."case" AND p.verdict = t.verdict) GROUP BY 1""")
def d1_set_check(spark, sf):
    t = truth(spark, sf).withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ARMS])))
    return sc.set_check(predictions(spark, sf), t, ["arm", "case", "verdict"], ["arm"])


@query("d4_regressions", f"""WITH {BASE_SQL} SELECT a."case", a.seed FROM runs a JOIN runs b ON a."case" = b."case" AND a.seed = b.seed
WHERE a.arm = 'long' AND a.passed AND b.arm = 'plain' AND NOT b.passed""")
def d4_regressions(spark, sf):
    scored = runs(spark, sf)
    return sc.regressions(scored.where("arm = 'long'"), scored.where("arm = 'plain'"), ["case", "seed"])


@query("f3_score", f"WITH {BASE_SQL} SELECT arm, \"case\", seed, tp, fp, fn, \"precision\", recall, f1 FROM s")
def f3_score(spark, sf):
    return sc.score(matched(spark, sf), ["arm", "case", "seed"]).select("arm", "case", "seed", "tp", "fp", "fn", "precision", "recall", "f1")


@query("f3_without_record", f"""WITH {BASE_SQL} SELECT arm, "case", seed, CASE WHEN stop = 'accepted' THEN fn ELSE 0 END AS fn, CASE WHEN stop = 'accepted' THEN f1 ELSE 0.0 END AS f1 FROM runs""")
def f3_without_record(spark, sf):
    return sc.without_record(runs(spark, sf), F.col("stop") == "accepted").select("arm", "case", "seed", "fn", "f1")


@query("f4_false_safe", f"WITH {BASE_SQL} SELECT arm, \"case\", seed, false_safe, unmatched_reaching FROM s")
def f4_false_safe(spark, sf):
    return sc.score(matched(spark, sf), ["arm", "case", "seed"]).select("arm", "case", "seed", "false_safe", "unmatched_reaching")


STATES_SQL = """st AS (SELECT source AS "case", doc_id % 3 AS seed, doc_id, a AS attempt, false AS delivered, n_chars >= 600 + 300 * a AS reaches FROM documents, (SELECT unnest([0, 1]) AS a) WHERE n_chars >= 150
 UNION ALL SELECT "case", seed, doc_id, 2, true, verdict = 'erased' FROM pred WHERE arm = 'long'),
tt AS (SELECT "case", seed, doc_id, verdict = 'erased' AS reaches FROM truth)"""


def states(spark, sf):
    """Two drafts of a run, the first the boldest, and the record it delivers."""
    keys = ["case", "seed", "doc_id"]
    docs = read(spark, sf, "documents").where("n_chars >= 150").select(F.col("source").alias("case"), (F.col("doc_id") % 3).alias("seed"), "doc_id", "n_chars", F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt"))
    drafts = docs.select(*keys, "attempt", F.lit(False).alias("delivered"), (F.col("n_chars") >= 600 + 300 * F.col("attempt")).alias("reaches"))
    handed = predictions(spark, sf).where("arm = 'long'").select(*keys, F.lit(2).alias("attempt"), F.lit(True).alias("delivered"), (F.col("verdict") == "erased").alias("reaches"))
    return drafts.unionByName(handed)


@query("f4_drafts", f"""WITH {BASE_SQL.strip()}, {STATES_SQL}, u AS (SELECT "case", seed, doc_id, min(attempt) AS first_attempt, bool_or(NOT delivered) AS d, bool_or(delivered) AS r, any_value(tt.reaches) IS NOT NULL AS matched
 FROM st LEFT JOIN tt USING ("case", seed, doc_id) WHERE st.reaches AND NOT coalesce(tt.reaches, false) GROUP BY 1, 2, 3)
SELECT "case", seed, matched, count(*) FILTER (d) AS in_drafts, count(*) FILTER (r) AS delivered, count(*) FILTER (d AND NOT r) AS hidden, min(first_attempt) AS first_attempt FROM u GROUP BY 1, 2, 3""")
def f4_drafts(spark, sf):
    """Unsafe claims that only a rejected draft held, beside those delivered."""
    t = truth(spark, sf).select("case", "seed", "doc_id", (F.col("verdict") == "erased").alias("reaches"))
    unsafe = sc.unsafe_ever(states(spark, sf), t, ["case", "seed"], ["doc_id"])
    return unsafe.groupBy("case", "seed", "matched").agg(
        sc.count_if(F.col("in_draft")).alias("in_drafts"), sc.count_if(F.col("in_delivered")).alias("delivered"),
        sc.count_if(F.col("in_draft") & ~F.col("in_delivered")).alias("hidden"), F.min("first_attempt").alias("first_attempt"))


@query("f4_draft_scores", f"""WITH {BASE_SQL.strip()}, {STATES_SQL}, a AS (SELECT DISTINCT "case", seed, attempt, delivered FROM st), x AS (SELECT * FROM a JOIN tt USING ("case", seed)),
m2 AS (SELECT coalesce(p."case", x."case") AS "case", coalesce(p.seed, x.seed) AS seed, coalesce(p.attempt, x.attempt) AS attempt, p.reaches AS pr, x.reaches AS tr FROM st p FULL JOIN x ON p."case" = x."case" AND p.seed = x.seed AND p.attempt = x.attempt AND p.doc_id = x.doc_id)
SELECT "case", seed, attempt, attempt = 2 AS delivered, count(*) FILTER (pr = tr) AS tp, count(*) FILTER (pr IS NOT NULL AND pr IS DISTINCT FROM tr) AS fp, count(*) FILTER (tr IS NOT NULL AND pr IS DISTINCT FROM tr) AS fn, count(*) FILTER (pr AND NOT tr) AS false_safe
FROM m2 GROUP BY 1, 2, 3""")
def f4_draft_scores(spark, sf):
    t = truth(spark, sf).select("case", "seed", "doc_id", "verdict", (F.col("verdict") == "erased").alias("reaches"))
    scored = sc.score_states(states(spark, sf).withColumn("verdict", F.lit(None).cast("string")), t, ["case", "seed"], ["doc_id"])
    return scored.select("case", "seed", "attempt", "delivered", "tp", "fp", "fn", "false_safe")


@query("f5_confusion", f"WITH {BASE_SQL} SELECT arm, tv AS true_verdict, pv AS pred_verdict, count(*) AS n FROM m WHERE ip AND it GROUP BY ALL")
def f5_confusion(spark, sf):
    return sc.confusion(matched(spark, sf), ["arm"])


@query("f6_pass_flag", f"""WITH {BASE_SQL} SELECT arm, ok, count(*) AS n FROM (SELECT arm, stop = 'accepted' AND f1 = 1.0 AND false_safe = 0 AND unmatched_reaching = 0 AS ok FROM runs) GROUP BY ALL""")
def f6_pass_flag(spark, sf):
    ok = sc.pass_flag(F.col("stop"), F.col("f1"), F.col("false_safe"), F.col("unmatched_reaching"))
    return runs(spark, sf).groupBy("arm", ok.alias("ok")).agg(F.count("*").alias("n"))


SUMMARY = ["f1_mean", "f1_std_seeds", "f1_std_cases", "f1_mean_success_only", "precision_mean", "recall_mean"]


@query("f7_summary", f"""WITH {BASE_SQL}, k AS (SELECT arm, "case", avg(f1) AS a, stddev_pop(f1) AS sd, sum(f1) AS f, count(*) AS n, count(*) FILTER (passed) AS p, count(*) FILTER (stop = 'accepted') AS ok,
 sum("precision") AS pp, sum(recall) AS rr, sum(false_safe) AS fs, sum(unmatched_reaching) AS ur, sum(f1) FILTER (stop = 'accepted') AS fok FROM runs GROUP BY 1, 2)
SELECT arm, count(*) AS n_cases, sum(n)::BIGINT AS n_runs, sum(ok)::BIGINT AS success, (sum(n) - sum(ok))::BIGINT AS failure, round(sum(f) / sum(n), 6) AS f1_mean, round(avg(sd), 6) AS f1_std_seeds,
 round(stddev_pop(a), 6) AS f1_std_cases, round(CASE WHEN sum(ok) > 0 THEN coalesce(sum(fok), 0) / sum(ok) ELSE 0 END, 6) AS f1_mean_success_only, round(sum(pp) / sum(n), 6) AS precision_mean,
 round(sum(rr) / sum(n), 6) AS recall_mean, sum(fs)::BIGINT AS false_safe_total, sum(ur)::BIGINT AS unmatched_reaching_total, sum(p)::BIGINT AS pass_runs,
 count(*) FILTER (p * 2 > n) AS pass_cases_majority, count(*) FILTER (p = n) AS pass_all_cases FROM k GROUP BY arm""")
def f7_summary(spark, sf):
    out = st.summarise(runs(spark, sf), ["arm"])
    return out.withColumns({c: F.round(c, 6) for c in SUMMARY})


@query("f8_spreads", f"""WITH {BASE_SQL}, k AS (SELECT arm, stop, "case", avg(f1) AS a, stddev_pop(f1) AS sd FROM runs GROUP BY 1, 2, 3)
SELECT arm, stop, count(*) AS n_cases, round(avg(sd), 6) AS f1_std_seeds, round(stddev_pop(a), 6) AS f1_std_cases FROM k GROUP BY arm, stop""")
def f8_spreads(spark, sf):
    """Both spreads of runs that end alike."""
    out = st.summarise(runs(spark, sf), ["arm", "stop"])
    return out.select("arm", "stop", "n_cases", *[F.round(c, 6).alias(c) for c in ("f1_std_seeds", "f1_std_cases")])


@query("f9_majority", f"""WITH {BASE_SQL} SELECT arm, "case", count(*) FILTER (passed) * 2 > count(*) AS majority, bool_and(passed) AS pass_all FROM runs GROUP BY 1, 2""")
def f9_majority(spark, sf):
    return st.majority(runs(spark, sf), ["arm", "case"])


@query("f10_mcnemar", f"""WITH {BASE_SQL}, d AS (SELECT count(*) FILTER (a.passed AND NOT b.passed) AS b, count(*) FILTER (b.passed AND NOT a.passed) AS c
 FROM runs a JOIN runs b ON a."case" = b."case" AND a.seed = b.seed WHERE a.arm = 'long' AND b.arm = 'plain')
SELECT b, c, b + c AS n_discordant, round(ln(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2.0 * list_sum(list_transform(range(0, least(b, c) + 1),
 lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))) END), 9) AS ln_p FROM d""")
def f10_mcnemar(spark, sf):
    scored = runs(spark, sf)
    out = st.mcnemar(scored.where("arm = 'long'"), scored.where("arm = 'plain'"), ["case", "seed"])
    # p is k / 2^n, which rounds to a tie sooner or later; its logarithm does not
    return out.select("b", "c", "n_discordant", F.round("ln_p", 9).alias("ln_p"))


RESAMPLES = 10_000
P = st.HASH_P
DRAW_SQL = f"""n AS (SELECT count(*) AS n FROM pairs), rj AS (SELECT r, j, ((r * 1103515245 + j * 12345 + 20260830) % {P}) AS x0 FROM range({RESAMPLES}) a(r), (SELECT unnest(range(0, (SELECT n FROM n))) AS j)),
x1 AS (SELECT r, j, (x0 * 48271 + j * 69621 + r) % {P} AS x FROM rj), x2 AS (SELECT r, j, (x * 48271 + j * 69621 + r) % {P} AS x FROM x1),
x3 AS (SELECT r, j, (x * 48271 + j * 69621 + r) % {P} AS x FROM x2), ds AS (SELECT r, avg(d) AS d FROM (SELECT r, (x * {P} + (x * 48271 + j * 69621 + r) % {P}) % (SELECT n FROM n) AS idx FROM x3) JOIN pairs USING (idx) GROUP BY r),
rk AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k FROM ds)"""
CASE_SQL = """cm AS (SELECT arm, "case", avg(f1) AS f1, sum(false_safe) AS fs, count(*) FILTER (passed) * 2 > count(*) AS ok FROM runs GROUP BY 1, 2),
pairs AS (SELECT row_number() OVER (ORDER BY "case") - 1 AS idx, a.f1 - b.f1 AS d, a.fs AS fa, b.fs AS fb, a.ok AS oa, b.ok AS ob FROM cm a JOIN cm b USING ("case") WHERE a.arm = 'plain' AND b.arm = 'long')"""


def per_case(spark, sf):
    return runs(spark, sf).groupBy("arm", "case").agg(
        F.avg("f1").alias("f1"), F.sum("false_safe").alias("false_safe"),
        (F.count_if("passed") * 2 > F.count("*")).alias("passed"))


@query("f11_bootstrap", f"""WITH {BASE_SQL}, {CASE_SQL}, {DRAW_SQL}
SELECT round((SELECT avg(d) FROM pairs), 6) AS delta_mean, round(max(d) FILTER (k = {int(0.025 * RESAMPLES)}), 6) AS lo, round(max(d) FILTER (k = {int(0.975 * RESAMPLES)}), 6) AS hi FROM rk""")
def f11_bootstrap(spark, sf):
    means = per_case(spark, sf).groupBy("case").pivot("arm", ARMS).agg(F.first("f1"))
    pairs = means.select("case", F.col("plain").alias("a"), F.col("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    out = st.bootstrap(st.indexed(pairs, ["case"]), RESAMPLES)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("f21_before_after", f"""WITH {BASE_SQL}, {CASE_SQL}, {DRAW_SQL}
SELECT round((SELECT avg(d) FROM pairs), 6) AS delta_mean, round(max(d) FILTER (k = {int(0.025 * RESAMPLES)}), 6) AS lo, round(max(d) FILTER (k = {int(0.975 * RESAMPLES)}), 6) AS hi,
 (SELECT count(*) FROM pairs) AS paired, (SELECT (sum(fa) - sum(fb))::BIGINT FROM pairs) AS false_safe_change, (SELECT count(*) FILTER (ob AND NOT oa) FROM pairs) AS regressions FROM rk""")
def f21_before_after(spark, sf):
    cases = per_case(spark, sf)
    out = st.compare_results(cases.where("arm = 'long'"), cases.where("arm = 'plain'"), RESAMPLES)
    return out.withColumns({c: F.round(c, 6) for c in ("delta_mean", "lo", "hi")})


SOURCES_SQL = """f AS (SELECT user_id, CASE WHEN value > 99 THEN 'unpriced' WHEN event_type = 'error' THEN 'cli_estimate' ELSE 'measured' END AS cost_source FROM events)"""


@query("f12_cost_source", f"""WITH {SOURCES_SQL} SELECT user_id, CASE WHEN bool_or(cost_source = 'unpriced') THEN 'unpriced' WHEN bool_or(cost_source = 'cli_estimate') THEN 'cli_estimate' ELSE 'measured' END AS cost_source FROM f GROUP BY 1""")
def f12_cost_source(spark, sf):
    source = F.when(F.col("value") > 99, "unpriced").when(F.col("event_type") == "error", "cli_estimate").otherwise("measured")
    return st.cost_source(read(spark, sf, "events").select("user_id", source.alias("cost_source")), ["user_id"])


@query("f14_uniform", """
WITH f AS (SELECT event_type AS arm, user_id AS "case", event_id % 3 AS seed, 'p' || (event_id % 1) AS sha, 'b' || (user_id % 2) AS brain, event_type AS model, value > 1 AS tr, props AS req FROM events),
q AS (SELECT 'prompt_sha' AS rule, count(DISTINCT sha) AS n FROM f UNION ALL SELECT 'brain', count(DISTINCT brain) FROM f UNION ALL SELECT 'model', count(DISTINCT model) FROM f)
SELECT rule, n FROM q WHERE n > 1 UNION ALL SELECT 'missing_trace', n FROM (SELECT count(*) FILTER (NOT tr) AS n FROM f) WHERE n > 0
UNION ALL SELECT 'first_request', n FROM (SELECT count(*) AS n FROM (SELECT "case", seed FROM f GROUP BY 1, 2 HAVING count(DISTINCT req) > 1)) WHERE n > 0""")
def f14_uniform(spark, sf):
    e = read(spark, sf, "events")
    facts = e.select(F.col("event_type").alias("arm"), F.col("user_id").alias("case"), (F.col("event_id") % 3).alias("seed"),
                     F.concat(F.lit("p"), (F.col("event_id") % 1).cast("string")).alias("prompt_sha"),
                     F.concat(F.lit("b"), (F.col("user_id") % 2).cast("string")).alias("brain"), F.col("event_type").alias("model"),
                     (F.col("value") > 1).alias("has_trace"), F.lit(True).alias("scored"), F.col("props").alias("first_request"))
    return st.check_uniform(facts)


@query("f15_identity", f"""WITH {BASE_SQL} SELECT count(*) AS n, count(*) FILTER (stop = 'accepted') AS success, count(*) FILTER (stop <> 'accepted') AS failure,
 count(*) = (SELECT count(DISTINCT source) FROM documents) * 2 * 3 AS ok FROM runs""")
def f15_identity(spark, sf):
    cases = read(spark, sf, "documents").select("source").distinct().count()
    return st.identity_check(runs(spark, sf), cases, len(ARMS), 3)


@query("f16_timing", """SELECT event_type AS arm, user_id AS "case", round(avg(value), 9) AS wall_s_mean, round(stddev_pop(value), 9) AS wall_s_std, count(*) AS n FROM events GROUP BY 1, 2""")
def f16_timing(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("arm"), F.col("user_id").alias("case"), F.col("value").alias("wall_s"))
    return st.timing(e, ["arm", "case"]).withColumns({c: F.round(c, 9) for c in ("wall_s_mean", "wall_s_std")})


@query("f17_failed_runs", f"""WITH {BASE_SQL}, d AS (SELECT source AS "case", doc_id % 3 AS seed, 'long' AS arm, count(*) || ' toxic' AS reason FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 GROUP BY 1, 2)
SELECT in_runs, in_diagnoses, count(*) AS n FROM (SELECT r.arm IS NOT NULL AS in_runs, d.arm IS NOT NULL AS in_diagnoses FROM (SELECT * FROM runs WHERE stop <> 'accepted') r
 FULL JOIN d ON r.arm = d.arm AND r."case" = d."case" AND r.seed = d.seed) GROUP BY ALL""")
def f17_failed_runs(spark, sf):
    toxic = truth(spark, sf).where("verdict = 'pseudonymised'")
    told = toxic.groupBy("case", "seed").agg(F.concat(F.count("*").cast("string"), F.lit(" toxic")).alias("reason")).withColumn("arm", F.lit("long"))
    both = st.failed_runs(runs(spark, sf), told, ["arm", "case", "seed"])
    return both.groupBy("in_runs", "in_diagnoses").agg(F.count("*").alias("n"))


@query("i4_nearest_rank", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) AS value FROM r WHERE k = least(n - 1, greatest(0, floor(0.975::DOUBLE * n)::BIGINT)) GROUP BY 1""")
def i4_nearest_rank(spark, sf):
    return st.nearest_rank(read(spark, sf, "events"), "value", 0.975, ["event_type"])
