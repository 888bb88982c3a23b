"""The fact job, resolution, inventory, graph and verdicts over the derived code estate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.operators import claims as cl
from datarights.operators.entrypoints import reconcile
from datarights.operators.graph import reach_two_pass
from datarights.operators.verdicts import classify_write, explain, parse_days
from datarights.plans import estate as es
from datarights.plans.registry import query, read
from datarights.session import stage
from datarights.sources.rules import rules

BASE = f"s AS (SELECT 'repo' || s_suppkey AS repo_id, (s_suppkey % {es.SHAPES})::INT AS k, s_nationkey AS n FROM supplier)"


#: How many facts of a kind a repository of each shape gives; a backup job that keeps days has an assignment more.
FACTS = {"module": "5 + (k = 10)::INT + 2 * (k = 6)::INT", "symbol": "6 + (k IN (6, 10))::INT", "class": "2", "class_assign": "4", "field": "4",
         "call": "[17, 17, 17, 19, 19, 17, 20, 17, 18, 17, 18, 19, 17][k + 1]", "import": "18 + 3 * (k = 6)::INT + (k = 10)::INT",
         "assign": "[10, 10, 10, 10, 10, 11, 13, 12, 11, 10, 10, 10, 10][k + 1] + (n % 2 = 0)::INT", "name_ref": "5 + (k IN (3, 4, 10))::INT + 2 * (k = 11)::INT",
         "span": "[29, 29, 29, 30, 30, 30, 36, 31, 30, 29, 31, 31, 29][k + 1] + (n % 2 = 0)::INT", "error": "(k = 9)::INT"}


@query("e1_facts", f"""WITH {BASE}, f AS (SELECT k, unnest([{', '.join(f"{{'fact': '{c}', 'v': {v}}}" for c, v in FACTS.items())}], recursive := true) FROM s)
SELECT k, fact, sum(v)::BIGINT AS n FROM f GROUP BY k, fact HAVING sum(v) > 0""")
def e1_facts(spark, sf):
    found = es.facts(spark, sf)
    k = (F.regexp_extract("repo_id", "([0-9]+)$", 1).cast("bigint") % es.SHAPES).cast("int")
    parts = [df.select(k.alias("k"), F.lit(name).alias("fact")) for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("k", "fact").agg(F.count("*").alias("n"))


@query("a2_estate_skips", f"""WITH {BASE} SELECT repo_id, 'dir:tests' AS reason, 1::BIGINT AS n FROM s""")
def a2_estate_skips(spark, sf):
    from datarights.sources.corpus import skip_tally
    return skip_tally(es.scanned(spark, sf))


@query("c2_calls", f"""WITH {BASE}, c AS (
 SELECT repo_id, 'avatar_key' AS name, 'resolved' AS outcome, 'CG-2' AS rule, 2 AS n FROM s
 UNION ALL SELECT repo_id, 'getLogger', 'unresolved', 'CG-7', 1 FROM s
 UNION ALL SELECT repo_id, 'delete', 'unresolved', 'CG-11', 1 + CASE WHEN k IN (0, 1, 2, 6, 9, 10, 11, 12) THEN 1 WHEN k IN (3, 4) THEN 2 ELSE 0 END FROM s
 UNION ALL SELECT repo_id, 'save', 'unresolved', 'CG-11', 1 FROM s WHERE k IN (5, 6, 7, 8)
 UNION ALL SELECT repo_id, 'drop_rows', 'ambiguous', 'CG-11', 1 FROM s WHERE k = 10
 UNION ALL SELECT repo_id, unnest(['drop_session', 'drop_files']), 'resolved', 'CG-1', 1 FROM s WHERE k = 11
 UNION ALL SELECT repo_id, unnest(['CharField', 'EmailField', 'ForeignKey', 'TextField', 'Redis', 'client', 'create']), 'unresolved', 'CG-7', 1 FROM s
 UNION ALL SELECT repo_id, unnest(['delete_object', 'put_object', 'info', 'set']), 'unresolved', 'CG-11', 1 FROM s
 UNION ALL SELECT repo_id, 'User', 'resolved', 'CG-1', 1 + (k = 6)::INT FROM s UNION ALL SELECT repo_id, 'filter', 'unresolved', 'CG-11', 1 FROM s WHERE k IN (3, 4)
 UNION ALL SELECT repo_id, 'sha256', 'unresolved', 'CG-7', 1 FROM s WHERE k = 8 UNION ALL SELECT repo_id, 'timedelta', 'unresolved', 'CG-5', 1 FROM s WHERE k = 6)
SELECT repo_id, name, outcome, rule, n::BIGINT AS n FROM c""")
def c2_calls(spark, sf):
    return es.code(spark, sf).calls.groupBy("repo_id", "name", "outcome", "rule").agg(F.count("*").alias("n"))


@query("c4_bindings", f"""WITH {BASE} SELECT repo_id, 'app.views.' || CASE WHEN k IN (5, 6) THEN 'deactivate_account' WHEN k = 7 THEN 'anonymize_user' WHEN k = 8 THEN 'forget_me' WHEN k = 9 THEN 'cleanup_rows' ELSE 'delete_user' END AS symbol,
 'user' AS var, 'app.models.User' AS model FROM s WHERE k <> 10 UNION ALL SELECT repo_id, 'app.helpers.drop_rows', 'user', 'app.models.User' FROM s WHERE k = 10
 UNION ALL SELECT repo_id, 'app.tasks.purge_users', 'stale', 'app.models.User' FROM s WHERE k = 6""")
def c4_bindings(spark, sf):
    return es.code(spark, sf).bindings


@query("c6_relations", f"""WITH {BASE} SELECT repo_id, 'user' AS parent, 'parcel' || n AS child, 'fk' AS kind, CASE WHEN k = 1 THEN 'SET_NULL' WHEN k IN (2, 3, 4) THEN 'PROTECT' ELSE 'CASCADE' END AS token FROM s""")
def c6_relations(spark, sf):
    return es.estate(spark, sf).relations.select("repo_id", "parent", "child", "kind", "token")


STORES_SQL = """st AS (SELECT repo_id, k, n, unnest([{'id': 'user', 'kind': 'relational', 'guard': 'strong', 'linked': true}, {'id': 'parcel' || n, 'kind': 'relational', 'guard': 'qualified', 'linked': true},
 {'id': 'session', 'kind': 'cache', 'guard': 'strong', 'linked': true}, {'id': 'avatars-' || n, 'kind': 'object_storage', 'guard': '', 'linked': true}, {'id': 'stripe', 'kind': 'third_party', 'guard': 'strong', 'linked': true},
 {'id': 'audit', 'kind': 'log', 'guard': 'strong', 'linked': true}, {'id': 'backup_job', 'kind': 'backup', 'guard': 'strong', 'linked': true}], recursive := true) FROM s)"""


@query("e2_stores", f"WITH {BASE}, {STORES_SQL} SELECT repo_id, id AS store_id, kind, guard, linked, id = 'user' AS subject_root FROM st")
def e2_stores(spark, sf):
    return es.estate(spark, sf).stores.select("repo_id", "store_id", "kind", "guard", "linked", "subject_root")


@query("e10_fields", f"""WITH {BASE}, f AS (SELECT repo_id, n, unnest([{{'s': 'user', 'f': 'email'}}, {{'s': 'user', 'f': 'phone'}}, {{'s': 'parcel' || n, 'f': 'notes'}}, {{'s': 'session', 'f': 'email'}}, {{'s': 'avatars-' || n, 'f': 'avatar_key'}},
 {{'s': 'stripe', 'f': 'email'}}, {{'s': 'audit', 'f': 'email'}}, {{'s': 'backup_job', 'f': 'email'}}, {{'s': 'backup_job', 'f': 'phone'}}], recursive := true) FROM s) SELECT repo_id, s AS store_id, f AS field FROM f""")
def e10_fields(spark, sf):
    return es.estate(spark, sf).fields.select("repo_id", "store_id", "field")


ENTRY_SQL = """en AS (SELECT repo_id, k, CASE WHEN k IN (5, 6) THEN 'deactivate_account' WHEN k = 7 THEN 'anonymize_user' WHEN k = 8 THEN 'forget_me' WHEN k = 10 THEN 'close_account' ELSE 'delete_user' END AS name,
 CASE WHEN k IN (5, 6, 7, 8, 10) THEN 'unknown' ELSE 'route' END AS kind FROM s WHERE k <> 9 UNION ALL SELECT repo_id, k, 'purge_users', 'task' FROM s WHERE k = 6)"""


@query("e12_entry_points", f"WITH {BASE}, {ENTRY_SQL} SELECT repo_id, name, kind FROM en")
def e12_entry_points(spark, sf):
    return es.estate(spark, sf).entries.select("repo_id", "name", "kind")


@query("g7_edges", f"""WITH {BASE}, e AS (
 SELECT repo_id, 'call' AS kind, 'CG-2' AS rule, 2 AS n FROM s UNION ALL SELECT repo_id, 'call', 'CG-1', 2 FROM s WHERE k = 11
 UNION ALL SELECT repo_id, 'call', 'CG-11', 1 FROM s WHERE k = 10 UNION ALL SELECT repo_id, 'call', 'CG-1', 1 + (k = 6)::INT FROM s
 UNION ALL SELECT repo_id, 'entry', 'SE0', 1 + (k = 6)::INT FROM s WHERE k <> 9
 UNION ALL SELECT repo_id, 'SE1', 'R1', 1 FROM s WHERE k NOT IN (1, 2, 3, 4)
 UNION ALL SELECT repo_id, 'SE12', 'R20', 1 FROM s UNION ALL SELECT repo_id, 'SE12', 'R13', 1 FROM s
 UNION ALL SELECT repo_id, 'SE12', 'R14', 1 FROM s WHERE k IN (0, 1, 2, 3, 4, 6, 9, 10, 11, 12)
 UNION ALL SELECT repo_id, 'SE12', 'R15', 1 FROM s WHERE k IN (3, 4))
SELECT kind, rule, sum(n)::BIGINT AS n FROM e GROUP BY 1, 2""")
def g7_edges(spark, sf):
    return es.estate(spark, sf).edges.groupBy("kind", "rule").agg(F.count("*").alias("n"))


VERDICT_SQL = """v AS (SELECT repo_id, id AS store_id, k, n, CASE
 WHEN kind = 'backup' THEN CASE WHEN n % 2 = 0 THEN 'governed_by_retention' ELSE 'no_schedule_evidenced' END
 WHEN kind = 'third_party' THEN 'external_manual' WHEN k = 9 THEN 'no_entry_point'
 WHEN id = 'user' THEN CASE WHEN k IN (2, 4, 10, 12) THEN 'unverified' WHEN k = 5 THEN 'not_erased' WHEN k = 6 THEN 'erased_after_timer' WHEN k = 7 THEN 'anonymised' WHEN k = 8 THEN 'pseudonymised' ELSE 'erased' END
 WHEN kind = 'relational' THEN CASE WHEN k IN (4, 10, 12) THEN 'unverified' WHEN k IN (0, 3, 6, 11) THEN 'erased' ELSE 'not_erased' END
 WHEN kind = 'cache' THEN CASE WHEN k = 11 THEN 'erased' ELSE 'not_erased' END
 WHEN kind = 'object_storage' THEN CASE WHEN k = 11 AND n % 2 = 0 THEN 'erased' ELSE 'not_erased' END ELSE 'not_erased' END AS verdict,
 CASE WHEN kind = 'backup' AND n % 2 = 0 THEN n + 30 WHEN id = 'user' AND k = 6 THEN n + 10 END AS days FROM st)"""


@query("e18_verdicts", f"WITH {BASE}, {STORES_SQL}, {VERDICT_SQL} SELECT repo_id, store_id, verdict, days::INT AS days FROM v")
def e18_verdicts(spark, sf):
    return es.decided(spark, sf)["stores"].select("repo_id", "store_id", "verdict", "days")


@query("e23_field_overrides", f"WITH {BASE} SELECT repo_id, 'user' AS store_id, 'phone' AS field, 'not_erased' AS verdict FROM s WHERE k = 8")
def e23_field_overrides(spark, sf):
    return es.decided(spark, sf)["fields"]


@query("e27_explain", f"""WITH {BASE}, {STORES_SQL}, {VERDICT_SQL}
SELECT repo_id, store_id, CASE WHEN store_id IN ('session', 'avatars-' || n) AND k <> 11 THEN 'R26 defined but has no callers' WHEN store_id = 'avatars-' || n AND n % 2 = 1 THEN 'R13' WHEN store_id IN ('session', 'avatars-' || n) THEN 'row 4'
 WHEN store_id = 'stripe' THEN 'R22 not erased at the recipient' WHEN store_id = 'backup_job' THEN 'row 1' WHEN store_id = 'audit' AND k <> 9 THEN 'row 9'
 WHEN store_id = 'user' AND k = 9 THEN 'R26 defined but has no callers' WHEN k = 9 THEN 'row 3' WHEN k = 10 THEN 'R26 ambiguous' WHEN k = 12 THEN 'R27' WHEN k = 4 OR (k = 2 AND store_id = 'user') THEN 'protected child'
 WHEN store_id = 'user' AND k = 5 THEN 'R25 only sets a flag' WHEN store_id = 'parcel' || n AND k = 1 THEN 'R2 the row survives' WHEN store_id = 'user' AND k IN (6, 7, 8) THEN ['row 6', 'row 5', 'row 7'][k - 5]
 WHEN k IN (0, 3, 11) OR (k = 1 AND store_id = 'user') OR k = 6 THEN 'row 4' ELSE 'row 9' END AS detail FROM v""")
def e27_explain(spark, sf):
    return explain(es.estate(spark, sf), es.decided(spark, sf)).select("repo_id", "store_id", "detail")


@query("g5_paths", f"""WITH {BASE} SELECT repo_id, 'store:parcel' || n AS target, 3 AS steps FROM s WHERE k IN (0, 6, 11, 12) UNION ALL SELECT repo_id, 'store:parcel' || n, 2 FROM s WHERE k IN (3, 4)
UNION ALL SELECT repo_id, 'store:user', 2 FROM s WHERE k IN (0, 1, 2, 3, 4, 6, 11, 12) UNION ALL SELECT repo_id, 'store:session', 3 FROM s WHERE k = 11 UNION ALL SELECT repo_id, 'store:avatars-' || n, 3 FROM s WHERE k = 11""")
def g5_paths(spark, sf):
    steps = es.decided(spark, sf)["steps"]
    return steps.groupBy("repo_id", "target").agg(F.max("step").alias("steps"))


@query("g2_two_pass", f"""WITH {BASE} SELECT repo_id, count(*) AS only_ambiguous FROM (SELECT repo_id, unnest(['app.helpers.drop_rows', 'app.models.User', 'store:user', 'store:parcel']) FROM s WHERE k = 10) GROUP BY 1""")
def g2_two_pass(spark, sf):
    e = es.estate(spark, sf)
    starts = e.entries.select("repo_id", F.col("node").alias("entry"), "node", F.lit("none").alias("mode"))
    both = reach_two_pass(e.edges, starts, e.hubs)
    return both.where("only_ambiguous").groupBy("repo_id").agg(F.count("*").alias("only_ambiguous"))


@query("b12_write_classes", f"""WITH {BASE} SELECT repo_id, 'is_active' AS "column", 'marker' AS "write" FROM s WHERE k IN (5, 6) UNION ALL SELECT repo_id, unnest(['email', 'phone']), 'constant' FROM s WHERE k = 7 UNION ALL SELECT repo_id, 'email', 'pseudonymous' FROM s WHERE k = 8""")
def b12_write_classes(spark, sf):
    c = es.code(spark, sf)
    writes = c.assigns.where("scope IS NOT NULL AND contains(target, '.')").select("repo_id", F.substring_index("target", ".", -1).alias("column"), "value_kind", "value", "keys")
    constants = c.assigns.where("scope IS NULL AND value_kind IN ('literal', 'none')").select("repo_id", F.col("target").alias("name"))
    return classify_write(writes, constants, rules()).select("repo_id", "column", "write")


@query("b17_parse_days", f"WITH {BASE} SELECT repo_id, 'app.tasks.purge_users' AS symbol, (n + 10)::INT AS days FROM s WHERE k = 6 UNION ALL SELECT repo_id, 'app.backup_job.dump_all', (n + 30)::INT FROM s WHERE n % 2 = 0")
def b17_parse_days(spark, sf):
    c = es.code(spark, sf)
    return parse_days(c, c.symbols.select("repo_id", F.col("name").alias("symbol"), "module"), rules()).select("repo_id", "symbol", "days")


@query("e14_estate_versioning", f"WITH {BASE} SELECT repo_id, 'infra/main.tf' AS path, unnest([1, 3]) AS line FROM s WHERE n % 2 = 1")
def e14_estate_versioning(spark, sf):
    return es.declarations(spark, sf).select("repo_id", "path", "line")


@query("c13_reconcile", f"""WITH {BASE}, {ENTRY_SQL}, d AS (SELECT repo_id, 'delete_user' AS name, 'app/views.py' AS file, 8 AS line FROM s UNION ALL SELECT repo_id, 'remember', 'app/services.py', 16 FROM s UNION ALL SELECT repo_id, 'ghost', 'app/views.py', 1 FROM s),
j AS (SELECT d.*, en.name IS NOT NULL AS hit FROM d LEFT JOIN en ON d.repo_id = en.repo_id AND d.name = en.name)
SELECT repo_id, name, CASE WHEN hit THEN 'confirmed' WHEN name = 'remember' THEN 'declared_unregistered' ELSE 'unresolved' END AS status FROM j
UNION ALL SELECT repo_id, name, 'missing' FROM en WHERE name <> 'delete_user'""")
def c13_reconcile(spark, sf):
    e = es.estate(spark, sf)
    said = F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("file"), F.lit(c).alias("line")) for a, b, c in
                               (("delete_user", "app/views.py", 8), ("remember", "app/services.py", 16), ("ghost", "app/views.py", 1))]))
    declared = read(spark, sf, "supplier").select(F.concat(F.lit("repo"), F.col("s_suppkey").cast("string")).alias("repo_id"), said.alias("d")).select("repo_id", F.col("repo_id").alias("record_id"), "d.*")
    return reconcile(stage(declared), e.entries, e.code.symbols, rules()).select("repo_id", "name", "status")


CLAIMS_SQL = """cm AS (SELECT repo_id, k, n, unnest([{'p': 0, 'c': 'admin_users', 'kind': 'relational', 'v': 'erased'}, {'p': 1, 'c': 'Users', 'kind': 'relational', 'v': 'erased'}, {'p': 2, 'c': 'shop_parcel' || n, 'kind': 'relational', 'v': 'not_erased'},
 {'p': 3, 'c': 'sessions', 'kind': 'cache', 'v': 'erased'}, {'p': 4, 'c': 'backup job', 'kind': 'backup', 'v': 'erased'}, {'p': 5, 'c': 'warehouse', 'kind': 'relational', 'v': 'not_erased'}], recursive := true) FROM s),
mt AS (SELECT *, CASE p WHEN 1 THEN 'user' WHEN 2 THEN 'parcel' || n WHEN 3 THEN 'session' WHEN 4 THEN 'backup_job' END AS store_id FROM cm)"""
CLAIMS = [(0, "admin_users", "relational", "erased"), (1, "Users", "relational", "erased"), (2, "shop_parcel", "relational", "not_erased"),
          (3, "sessions", "cache", "erased"), (4, "backup job", "backup", "erased"), (5, "warehouse", "relational", "not_erased")]


def estate_claims(spark, sf):
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("claim_pos"), F.lit(b).alias("name"), F.lit(c).alias("kind"), F.lit(d).alias("claimed")) for a, b, c, d in CLAIMS])).alias("c")
    base = read(spark, sf, "supplier").select(F.concat(F.lit("repo"), F.col("s_suppkey").cast("string")).alias("repo_id"), "s_nationkey", each)
    name = F.when(F.col("c.claim_pos") == 2, F.concat("c.name", F.col("s_nationkey").cast("string"))).otherwise(F.col("c.name"))
    return base.select("repo_id", "c.claim_pos", name.alias("name"), "c.kind", "c.claimed", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))


@query("c10_match_claims", f"WITH {BASE}, {CLAIMS_SQL} SELECT repo_id, p AS claim_pos, store_id FROM mt WHERE store_id IS NOT NULL")
def c10_match_claims(spark, sf):
    return cl.match_claims(estate_claims(spark, sf), es.estate(spark, sf).stores, ["repo_id"]).select("repo_id", "claim_pos", "store_id")


@query("e26_compare_claims", f"""WITH {BASE}, {STORES_SQL}, {VERDICT_SQL}, {CLAIMS_SQL}, j AS (SELECT mt.*, v.verdict AS f FROM mt LEFT JOIN v ON mt.repo_id = v.repo_id AND mt.store_id = v.store_id)
SELECT repo_id, p AS claim_pos, CASE WHEN kind = 'backup' THEN 'wrong_kind' WHEN store_id IS NULL AND v = 'erased' THEN 'uncorroborated' WHEN store_id IS NULL THEN 'uncorroborated_safe'
 WHEN v = 'erased' AND f = 'unverified' THEN 'unresolved' WHEN v = 'erased' AND f NOT IN ('erased', 'erased_after_timer', 'anonymised') THEN 'false_safe' WHEN v = 'erased' AND f = 'erased_after_timer' THEN 'timer_first'
 WHEN v <> 'erased' AND f IN ('erased', 'erased_after_timer', 'anonymised') THEN 'more_careful' WHEN v <> 'erased' AND f = 'unverified' THEN 'cannot_tell' ELSE 'agrees' END AS rule FROM j""")
def e26_compare_claims(spark, sf):
    claims = estate_claims(spark, sf)
    pairs = cl.match_claims(claims, es.estate(spark, sf).stores, ["repo_id"]).select("repo_id", "claim_pos", "store_id")
    asked = claims.join(pairs, ["repo_id", "claim_pos"], "left").withColumns({"field": F.lit(None).cast("string"), "cited": F.array().cast("array<string>")})
    v = es.decided(spark, sf)["stores"].select("repo_id", "store_id", F.col("verdict").alias("found"), F.col("kind").alias("found_kind"),
                                               F.array(F.concat_ws(":", "evidence_file", F.col("evidence_line").cast("string"))).alias("allowed"))
    return cl.compare_claims(asked, v, ["repo_id", "store_id"]).select("repo_id", "claim_pos", "rule")


@query("c12_estate_missing", f"""WITH {BASE}, {STORES_SQL}, {CLAIMS_SQL} SELECT st.repo_id, st.id AS store_id FROM st LEFT JOIN mt ON st.repo_id = mt.repo_id AND st.id = mt.store_id
WHERE mt.store_id IS NULL AND (st.guard = 'strong' OR st.guard = 'qualified')""")
def c12_estate_missing(spark, sf):
    stores = es.estate(spark, sf).stores
    pairs = cl.match_claims(estate_claims(spark, sf), stores, ["repo_id"])
    return cl.missing_stores(stores, pairs, ["repo_id", "store_id"]).select("repo_id", "store_id")
