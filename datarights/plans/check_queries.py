"""The whole check over the derived estate, and its answers asked again after files have changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from datarights.operators.check import LISTS, check_claims, parse_records
from datarights.operators.reverify import ANSWER, recheck, reverify_submissions
from datarights.plans import estate as es
from datarights.plans.code_queries import BASE, CLAIMS_SQL, ENTRY_SQL, STORES_SQL, VERDICT_SQL
from datarights.plans.registry import query, read

#: A record about repository `n`: what it claims is `code_queries.CLAIMS`, with the lines it cites.
RECORD = """{"entry_points": [{"name": "delete_user", "kind": "route", "file": "app/views.py", "line": 8}],
 "retention": [{"store": "Users", "days": 30, "file": "infra/main.tf", "line": 99}], "stores": [
 {"name": "admin_users", "kind": "relational", "erasure": {"verdict": "erased"}, "fields": [{"name": "email", "file": "app/models.py", "line": 5}]},
 {"name": "Users", "kind": "relational", "erasure": {"verdict": "erased", "evidence": [{"file": "app/config.py", "line": 1, "symbol": "BUCKET"}]}, "fields": [{"name": "email", "file": "app/models.py", "line": 5}]},
 {"name": "shop_parcel@", "kind": "relational", "erasure": {"verdict": "not_erased"}, "fields": [{"name": "notes", "file": "app/models.py", "line": 11}]},
 {"name": "sessions", "kind": "cache", "erasure": {"verdict": "erased"}, "fields": [{"name": "email", "file": "app/services.py", "line": 17}]},
 {"name": "backup job", "kind": "backup", "erasure": {"verdict": "erased"}, "fields": [{"name": "email", "file": "app/backup_job.py", "line": 1}]},
 {"name": "warehouse", "kind": "relational", "erasure": {"verdict": "not_erased"}, "fields": [{"name": "email", "file": "app/tests/models.py", "line": 5}]}]}"""


def submissions(spark, sf):
    """Two records for every repository: `a` as above, and for even suppliers `b`, which says nothing."""
    s = read(spark, sf, "supplier").select(F.concat(F.lit("repo"), F.col("s_suppkey").cast("string")).alias("repo_id"), "s_suppkey", F.col("s_nationkey").cast("string").alias("n"))
    said = F.array(F.struct(F.lit("a").alias("r"), F.replace(F.lit(RECORD), F.lit("@"), F.col("n")).alias("record")),
                   F.struct(F.when(F.col("s_suppkey") % 2 == 0, "b").alias("r"), F.lit("{}").alias("record")))
    each = s.select("repo_id", "s_suppkey", F.inline(said)).where("r IS NOT NULL")
    return each.select(F.concat_ws("/", "repo_id", "r").alias("record_id"), "repo_id", "record", "s_suppkey")


#: Every item of the feedback of both records as (list, what, why).
FEEDBACK_SQL = f"""{STORES_SQL}, {VERDICT_SQL}, {ENTRY_SQL}, {CLAIMS_SQL},
jc AS (SELECT mt.repo_id, mt.k, mt.c, mt.kind, mt.v, mt.store_id, v.verdict AS f, CASE WHEN mt.c = 'shop_parcel' THEN mt.c || mt.n ELSE mt.c END AS name FROM mt LEFT JOIN v ON mt.repo_id = v.repo_id AND mt.store_id = v.store_id),
jr AS (SELECT *, CASE WHEN kind = 'backup' THEN 'wrong_kind' WHEN store_id IS NULL AND v = 'erased' THEN 'uncorroborated' WHEN store_id IS NULL THEN 'uncorroborated_safe'
 WHEN v = 'erased' AND f = 'unverified' THEN 'unresolved' WHEN v = 'erased' AND f NOT IN ('erased', 'erased_after_timer', 'anonymised') THEN 'false_safe' WHEN v = 'erased' AND f = 'erased_after_timer' THEN 'timer_first'
 WHEN v <> 'erased' AND f IN ('erased', 'erased_after_timer', 'anonymised') THEN 'more_careful' WHEN v <> 'erased' AND f = 'unverified' THEN 'cannot_tell' WHEN c = 'Users' AND f = 'erased' THEN 'off_path' ELSE 'agrees' END AS rule FROM jc),
b AS (SELECT repo_id FROM s WHERE regexp_extract(repo_id, '[0-9]+')::INT % 2 = 0),
item AS (SELECT repo_id || '/a' AS record_id, 'rejected_claims' AS list, name AS what, rule AS why FROM jr WHERE rule IN ('wrong_kind', 'uncorroborated', 'unresolved', 'false_safe', 'timer_first', 'off_path')
 UNION ALL SELECT repo_id || '/a', 'unverified', name, rule FROM jr WHERE rule IN ('uncorroborated_safe', 'cannot_tell')
 UNION ALL SELECT repo_id || '/a', 'conservative_divergences', name, f FROM jr WHERE rule = 'more_careful'
 UNION ALL SELECT repo_id || '/a', 'missing_stores', id, kind FROM st WHERE id IN ('stripe', 'audit')
 UNION ALL SELECT repo_id || '/b', 'missing_stores', id, kind FROM st WHERE guard <> '' AND repo_id IN (FROM b)
 UNION ALL SELECT repo_id || '/a', 'missing_entry_points', name, kind FROM en WHERE name <> 'delete_user'
 UNION ALL SELECT repo_id || '/b', 'missing_entry_points', name, kind FROM en WHERE repo_id IN (FROM b)
 UNION ALL SELECT repo_id || '/a', 'bad_citations', 'app/tests/models.py', 'not_scanned' FROM s UNION ALL SELECT repo_id || '/a', 'bad_citations', 'infra/main.tf', 'past_end' FROM s
 UNION ALL SELECT repo_id || '/a', 'bad_citations', 'app/views.py', 'symbol_absent' FROM s WHERE k NOT IN (0, 1, 2, 3, 4, 11))"""


def _items(feedback):
    """One row per item of every list, and one of list `accepted` per record."""
    what = {"missing_stores": ("store", "kind"), "missing_entry_points": ("name", "kind"), "bad_citations": ("file", "problem"), "schema_errors": ("pointer", "problem"), "conservative_divergences": ("store", "found")}
    parts = [F.array(F.struct(F.lit("accepted").alias("list"), F.col("accepted").cast("string").alias("what"), F.lit("").alias("why")))]
    for name in LISTS:
        a, b = what.get(name, ("store", "reason"))
        parts.append(F.expr(f"transform({name}, x -> named_struct('list', '{name}', 'what', x.{a}, 'why', x.{b}))"))
    return feedback.select("record_id", F.explode(F.concat(*parts)).alias("i")).select("record_id", "i.list", "i.what", "i.why")


@query("e28_check_claims", f"""WITH {BASE}, {FEEDBACK_SQL}
SELECT record_id, list, what, why FROM item UNION ALL SELECT DISTINCT record_id, 'accepted', 'false', '' FROM item""")
def e28_check_claims(spark, sf):
    return _items(check_claims(es.source_files(spark, sf), parse_records(submissions(spark, sf)), integrity=False))


@query("e30_reverify_submissions", f"""WITH {BASE}, r AS (SELECT repo_id, regexp_extract(repo_id, '[0-9]+')::INT AS i FROM s),
q AS (SELECT repo_id, repo_id || '/a' AS record_id, i FROM r UNION ALL SELECT repo_id, repo_id || '/b', i FROM r WHERE i % 2 = 0)
SELECT record_id, 'bad_citations' AS what FROM q WHERE i % 4 = 3 AND record_id LIKE '%/a' AND i % 7 <> 0 UNION ALL SELECT record_id, 'accepted' FROM q WHERE i % 5 = 0 AND i % 7 <> 0
UNION ALL SELECT record_id, 'no record' FROM q WHERE i % 7 = 0 UNION ALL SELECT repo_id, 'worked again' FROM r WHERE i % 4 = 3 AND i % 7 <> 0""")
def e30_reverify_submissions(spark, sf):
    """Answers are recorded, one in five wrongly; then a cited line moves in every fourth repository and every seventh loses its record."""
    asked, files = submissions(spark, sf), es.source_files(spark, sf)
    answers, ledger, _ = recheck(files, asked.drop("s_suppkey"), integrity=False)
    flipped = F.when(F.col("s_suppkey") % 5 == 0, F.when(F.col("accepted") == "true", "false").otherwise("true")).otherwise(F.col("accepted"))
    recorded = asked.join(answers.drop("repo_id"), "record_id").withColumn("accepted", flipped)
    recorded = recorded.withColumn("record", F.when(F.col("s_suppkey") % 7 != 0, F.col("record")).otherwise(F.lit("[1]"))).select("record_id", "repo_id", "record", *ANSWER)
    moved = (F.col("path") == "app/config.py") & (F.regexp_extract("repo_id", "[0-9]+", 0).cast("int") % 4 == 3)
    today = files.withColumn("text", F.when(moved, F.concat(F.lit("\n\n"), "text")).otherwise(F.col("text")))
    found, _, worked = reverify_submissions(today, recorded, ledger, integrity=False)
    return found.select("record_id", "what").unionByName(worked.select(F.col("repo_id").alias("record_id"), F.lit("worked again").alias("what")))
