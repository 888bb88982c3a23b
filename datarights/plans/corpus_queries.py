"""Documents as a corpus of files, page addresses as paths, order tables as stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from datarights.functions import text as t
from datarights.operators import claims as cl
from datarights.operators.report import KIND_ORDER, ordered
from datarights.plans.registry import query, read
from datarights.plans.sqltext import s_array, s_base, s_list, s_norm_of
from datarights.plans.text_queries import GUARD_SQL, R
from datarights.sources import corpus as co
from datarights.sources.catalog import scan_catalog

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
ALL_TABLES = [*TABLES, "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
FILE_TAILS = ["/test_x.py", "/tests/a.py", "/settings/base.py", "/docs/settings.py", "/mod.py", "/app_test.py", "/static/tests/b.py"]
PATH_SQL = f"""p AS (SELECT page_id, length(html) AS n_bytes, regexp_extract(url, '^https?://([^/]+)/', 1) AS repo_id,
 regexp_extract(url, '^https?://[^/]+/(.*)$', 1) || ({s_array(FILE_TAILS)})[(page_id % 7) + 1] AS path FROM pages),
d AS (SELECT *, string_split(path, '/') AS parts FROM p),
x AS (SELECT *, list_filter(range(1, len(parts)), lambda i: list_contains({s_array(R.words('excluded_dirs'))}, parts[i])) AS ex, parts[-1] AS name FROM d),
k AS (SELECT *, CASE WHEN len(ex) > 0 THEN 'dir:' || parts[ex[1]] WHEN name = 'settings.py' OR regexp_matches(path, '(^|/)settings/.*\\.py$') OR regexp_matches(path, '(^|/)management/commands/.*\\.py$') THEN NULL
 WHEN regexp_matches(name, '^test_.*\\.py$') THEN 'file:test_*.py' WHEN regexp_matches(name, '^.*_test\\.py$') THEN 'file:*_test.py' WHEN name IN ('conftest.py', 'setup.py', 'noxfile.py') THEN 'file:' || name END AS reason,
 CASE WHEN len(ex) > 0 THEN array_to_string(parts[1:ex[1]], '/') END AS pruned FROM x)"""


def page_paths(spark, sf):
    tail = F.element_at(F.array(*[F.lit(w) for w in FILE_TAILS]), (F.col("page_id") % 7).cast("int") + 1)
    return read(spark, sf, "pages").select(
        "page_id", F.length("html").alias("n_bytes"), F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("repo_id"),
        F.concat(F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1), tail).alias("path"))


@query("a2_skip_tally", f"WITH {PATH_SQL} SELECT repo_id, reason, count(DISTINCT coalesce(pruned, path)) AS n FROM k WHERE reason IS NOT NULL GROUP BY 1, 2")
def a2_skip_tally(spark, sf):
    return co.skip_tally(co.classify_paths(page_paths(spark, sf)))


@query("a4_config_files", f"""WITH {PATH_SQL}, c AS (SELECT repo_id, replace(path, '.py', '.yaml') AS path, n_bytes, pruned FROM k)
SELECT repo_id, count(*) AS n FROM c WHERE pruned IS NULL GROUP BY 1""")
def a4_config_files(spark, sf):
    files = page_paths(spark, sf).withColumn("path", F.replace("path", F.lit(".py"), F.lit(".yaml")))
    return co.scan_config(files).groupBy("repo_id").agg(F.count("*").alias("n"))


DOC_LINES_SQL = """dl AS (SELECT source AS repo_id, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
lines AS (SELECT d.* FROM dl d JOIN (SELECT doc_id, len(string_split(text, chr(10))) AS k, text LIKE '%' || chr(10) OR text = '' AS e FROM documents) z USING (doc_id) WHERE NOT (z.e AND d.line = z.k))"""


def doc_lines(spark, sf, cited=None):
    """Lines of the documents; with `cited` (doc_id) only of those, before any text becomes lines."""
    docs = read(spark, sf, "documents").select(F.col("source").alias("repo_id"), "doc_id", "text")
    if cited is not None:
        docs = docs.join(cited.select("doc_id").distinct(), "doc_id", "left_semi")
    return co.lines(docs, ["repo_id", "doc_id"])


@query("a5_lines", f"WITH {DOC_LINES_SQL} SELECT repo_id, count(*) AS n, max(line)::INT AS longest, sum(length(text))::BIGINT AS chars FROM lines GROUP BY 1")
def a5_lines(spark, sf):
    return doc_lines(spark, sf).groupBy("repo_id").agg(F.count("*").alias("n"), F.max("line").alias("longest"),
                                                       F.sum(F.length("text")).alias("chars"))


@query("a6_tree", f"""WITH {PATH_SQL}, e AS (SELECT repo_id, n_bytes, len(parts) AS np, unnest(range(1, least(len(parts), 3) + 1)) AS depth, parts FROM k WHERE pruned IS NULL)
SELECT repo_id, array_to_string(parts[1:depth], '/') AS entry, depth::INT AS depth, bool_or(np > depth) AS is_dir, count(*) AS files, sum(n_bytes)::BIGINT AS bytes FROM e GROUP BY 1, 2, 3""")
def a6_tree(spark, sf):
    return co.tree(page_paths(spark, sf), 3)


@query("a7_slice_lines", f"""WITH {DOC_LINES_SQL}, r AS (SELECT doc_id, (doc_id % 5)::INT AS lo, (doc_id % 5 + quality * 6)::INT AS hi FROM labels)
SELECT doc_id, line::INT AS line, text FROM lines JOIN r USING (doc_id) WHERE line >= greatest(lo, 1) AND (hi < lo OR hi <= 0 OR line <= hi)""")
def a7_slice_lines(spark, sf):
    requests = read(spark, sf, "labels").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("lo"),
                                                (F.col("doc_id") % 5 + F.col("quality") * 6).cast("int").alias("hi"))
    table = doc_lines(spark, sf).select("doc_id", "line", "text")
    return co.slice_lines(table, requests, ["doc_id"]).select("doc_id", "line", "text")


@query("a13_fingerprint", """WITH h AS (SELECT source, sha256(doc_id::VARCHAR || chr(0) || sha256(text)) AS h FROM documents),
p AS (SELECT source, left(h, 3) AS s, sha256(string_agg(h, '' ORDER BY h)) AS p, count(*) AS n FROM h GROUP BY 1, 2)
SELECT source, sha256(string_agg(p, '' ORDER BY s, p)) AS digest, sum(n)::BIGINT AS files FROM p GROUP BY 1""")
def a13_fingerprint(spark, sf):
    return co.fingerprint(read(spark, sf, "documents"), ["source"], "doc_id", "text")


@query("a15_catalog", f"SELECT table_name AS store, column_name AS field, (ordinal_position - 1)::INT AS position FROM information_schema.columns WHERE table_name IN {s_list(ALL_TABLES)}")
def a15_catalog(spark, sf):
    return scan_catalog(spark, {n: read(spark, sf, n) for n in ALL_TABLES}).select("store", "field", "position")


PATTERN = "[0-9]{3}-[0-9]{4}|@"


@query("i1_grep", f"""WITH {DOC_LINES_SQL}, h AS (SELECT repo_id, lpad(doc_id::VARCHAR, 12, '0') AS path, line, text FROM lines WHERE regexp_matches(text, '{PATTERN}'))
SELECT repo_id, path, line::INT AS line, text FROM h""")
def i1_grep(spark, sf):
    table = doc_lines(spark, sf).withColumn("path", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return co.grep(table, PATTERN, "repo_id", "path")


@query("e14_versioning", f"""WITH {DOC_LINES_SQL}, h AS (SELECT doc_id, line, CASE WHEN contains(text, '@') THEN '@' WHEN contains(text, 'icense') THEN 'icense' END AS literal FROM lines),
b AS (SELECT h.doc_id, h.line, h.literal, string_agg(l.text, chr(10) ORDER BY l.line) AS block FROM h JOIN lines l ON l.doc_id = h.doc_id AND l.line BETWEEN h.line AND h.line + 5 WHERE h.literal IS NOT NULL GROUP BY 1, 2, 3)
SELECT doc_id, line::INT AS line, literal FROM b WHERE regexp_matches(block, '(?i)[a-z.]+\\s+[0-9]')""")
def e14_versioning(spark, sf):
    return co.versioning(read(spark, sf, "documents"), ["doc_id"], ["@", "icense"], r"(?i)[a-z.]+\s+[0-9]", 5)


SPANS_SQL = "spans AS (SELECT doc_id, line AS start, (line + length(text) % 4)::INT AS \"end\" FROM lines WHERE line % 2 = 1)"
CITES_SQL = """cites AS (SELECT doc_id AS cite_id, CASE WHEN toxic = 1 THEN -1 ELSE doc_id END AS doc_id, (doc_id % 9 + quality)::INT AS line,
 CASE doc_id % 4 WHEN 0 THEN 'The' WHEN 1 THEN 'of.the' WHEN 2 THEN '!!' ELSE 'les' END AS symbol FROM labels)"""


def doc_spans(spark, sf, cited=None):
    return doc_lines(spark, sf, cited).where("line % 2 = 1").select("doc_id", F.col("line").alias("start"), (F.col("line") + F.length("text") % 4).alias("end"))


def label_cites(spark, sf):
    k = F.col("doc_id") % 4
    return read(spark, sf, "labels").select(
        F.col("doc_id").alias("cite_id"), F.when(F.col("toxic") == 1, -1).otherwise(F.col("doc_id")).alias("doc_id"),
        (F.col("doc_id") % 9 + F.col("quality")).cast("int").alias("line"),
        F.when(k == 0, "The").when(k == 1, "of.the").when(k == 2, "!!").otherwise("les").alias("symbol"))


@query("c14_enclosing_span", f"""WITH {DOC_LINES_SQL}, {SPANS_SQL}, {CITES_SQL},
j AS (SELECT cite_id, arg_min(struct_pack(s := start, e := "end"), struct_pack(l := "end" - start, s := start)) AS b FROM cites JOIN spans USING (doc_id) WHERE line BETWEEN start AND "end" GROUP BY 1)
SELECT cite_id, c.line, b.s::INT AS start, b.e::INT AS "end" FROM cites c LEFT JOIN j USING (cite_id)""")
def c14_enclosing_span(spark, sf):
    cites = label_cites(spark, sf)
    return cl.enclosing_span(cites, doc_spans(spark, sf, cites), ["doc_id"]).select("cite_id", "line", "start", "end")


_TOKS = f"list_transform(list_transform(regexp_extract_all(block, '[A-Za-z0-9_]+'), lambda w: {s_base('w')}), lambda x: {s_norm_of('x')})"


@query("c15_check_citations", f"""WITH {DOC_LINES_SQL}, {SPANS_SQL}, {CITES_SQL}, nl AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1),
j AS (SELECT cite_id, arg_min(struct_pack(s := start, e := "end"), struct_pack(l := "end" - start, s := start)) AS b FROM cites JOIN spans USING (doc_id) WHERE line BETWEEN start AND "end" GROUP BY 1),
c AS (SELECT cites.*, nl.n, coalesce(j.b.s, line) AS s, coalesce(j.b.e, line) AS e FROM cites LEFT JOIN nl USING (doc_id) LEFT JOIN j USING (cite_id)),
bl AS (SELECT c.cite_id, string_agg(l.text, chr(10)) AS block FROM c JOIN lines l ON l.doc_id = c.doc_id AND l.line BETWEEN c.s AND c.e GROUP BY 1),
tk AS (SELECT cite_id, {_TOKS} AS toks FROM bl)
SELECT c.cite_id, CASE WHEN c.n IS NULL THEN 'no_file' WHEN c.line < 1 OR c.line > c.n THEN 'past_end' WHEN symbol = '!!' THEN 'no_symbol'
 WHEN (symbol = 'The' AND list_contains(toks, 'the')) OR (symbol = 'les' AND list_contains(toks, 'les')) OR (symbol = 'of.the' AND list_contains(toks, 'of') AND list_contains(toks, 'the')) THEN NULL
 ELSE 'symbol_absent' END AS problem FROM c LEFT JOIN tk USING (cite_id)""")
def c15_check_citations(spark, sf):
    cited = label_cites(spark, sf).select("doc_id")
    table = doc_lines(spark, sf, cited).select(F.col("doc_id").cast("string").alias("file"), "line", "text")
    files = table.groupBy("file").agg(F.count("*").alias("n_lines")).withColumn("scanned", F.lit(True))
    cites = label_cites(spark, sf).withColumn("file", F.col("doc_id").cast("string")).withColumns(
        {"has_symbol": F.lit(True), "scanned_only": F.lit(True)}).drop("doc_id")
    spans = doc_spans(spark, sf, cited).withColumn("file", F.col("doc_id").cast("string")).drop("doc_id")
    return cl.check_citations(cites, files, table, spans, []).select("cite_id", "problem")


@query("f19_evidence_index", f"""WITH {DOC_LINES_SQL}, t AS (SELECT doc_id, line, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS symbol, repo_id AS section FROM lines WHERE contains(text, '@'))
SELECT doc_id, line::INT AS line, array_to_string(list_sort(list_distinct(list(symbol))), ' ') AS symbols, array_to_string(list_sort(list_distinct(list(section))), ' ') AS sections FROM t GROUP BY 1, 2""")
def f19_evidence_index(spark, sf):
    hits = doc_lines(spark, sf).where(F.col("text").contains("@")).select(
        "doc_id", "line", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("symbol"), F.col("repo_id").alias("section"))
    out = cl.evidence_index(hits, ["doc_id"])
    return out.withColumns({c: F.array_join(c, " ") for c in ("symbols", "sections")})


# --- order tables as stores: every column a field, nations' suppliers as owners ---------------------------------

FIELDS_OF_SQL = f"""fl AS (SELECT table_name AS store, column_name AS field FROM information_schema.columns WHERE table_name IN {s_list(TABLES)}),
fb AS (SELECT store, field, {s_base("regexp_replace(field, '^[a-z]_', '')")} AS b0 FROM fl), fs AS (SELECT store, field, {s_norm_of('b0')} AS stem FROM fb), fg AS (SELECT store, field, {GUARD_SQL} AS guard FROM fs)"""


def guarded_fields(spark, sf):
    """One row per catalog column, joined to how many rows carry it."""
    fields = scan_catalog(spark, {n: read(spark, sf, n) for n in TABLES})
    plain = F.regexp_replace("field", "^[a-z]_", "")
    return fields.withColumn("guard", t.guard_level(plain, R.words("strong_fields"), R.words("qualified_fields")))


STORE_LINKS = [("customer", "orders"), ("orders", "lineitem"), ("nation", "customer"), ("nation", "supplier"), ("region", "nation"), ("customer", "events")]
LINK_SQL = ", ".join(f"('{a}', '{b}')" for a, b in STORE_LINKS)


def catalog_stores(spark, sf):
    from datarights.operators.inventory import store_guard, subject_links

    fields = guarded_fields(spark, sf)
    stores = fields.select(F.lit("shop").alias("repo_id"), F.col("store").alias("store_id"), "kind").distinct().withColumn(
        "subject_root", t.in_words(F.col("store_id"), R.words("subject_root_names")))
    relations = spark.createDataFrame(STORE_LINKS, "parent string, child string").withColumns(
        {"repo_id": F.lit("shop"), "kind": F.lit("fk"), "file": F.lit("catalog"), "line": F.lit(1)})
    linked = subject_links(stores, relations)
    return store_guard(linked, fields.select(F.lit("shop").alias("repo_id"), F.col("store").alias("store_id"), "field", "guard"), R.words("subject_words"))


@query("e11_subject_links", f"""WITH {FIELDS_OF_SQL}, r(parent, child) AS (VALUES {LINK_SQL}),
s AS (SELECT store AS store_id, store IN ('customer') AS root, bool_or(guard = 'strong') AS strong, bool_or(guard = 'qualified') AS qual FROM fg GROUP BY 1)
SELECT store_id, root OR store_id IN (SELECT child FROM r WHERE parent = 'customer') OR store_id IN (SELECT parent FROM r WHERE child = 'customer') AS linked,
 CASE WHEN strong THEN 'strong' WHEN qual AND (store_id = 'customer' OR store_id IN (SELECT child FROM r WHERE parent = 'customer') OR store_id IN (SELECT parent FROM r WHERE child = 'customer')) THEN 'qualified' ELSE '' END AS guard FROM s""")
def e11_subject_links(spark, sf):
    return catalog_stores(spark, sf).select("store_id", "linked", "guard")


@query("c12_missing_stores", f"""WITH {FIELDS_OF_SQL}, r(parent, child) AS (VALUES {LINK_SQL}), s AS (SELECT store, bool_or(guard = 'strong') AS strong, bool_or(guard = 'qualified') AS qual FROM fg GROUP BY 1),
c AS (SELECT DISTINCT CASE WHEN event_type = 'click' THEN 'customer' ELSE 'events' END AS store FROM events WHERE value > 200)
SELECT store AS store_id FROM s WHERE store NOT IN (SELECT store FROM c) AND (strong OR (qual AND (store = 'customer' OR store IN (SELECT child FROM r WHERE parent = 'customer') OR store IN (SELECT parent FROM r WHERE child = 'customer'))))""")
def c12_missing_stores(spark, sf):
    claimed = read(spark, sf, "events").where("value > 200").select(
        F.when(F.col("event_type") == "click", "customer").otherwise("events").alias("store_id")).distinct()
    return cl.missing_stores(catalog_stores(spark, sf), claimed, ["store_id"]).select("store_id")


@query("i3_evidence_phrase", f"""WITH {FIELDS_OF_SQL} SELECT store, array_to_string((CASE WHEN count(*) FILTER (guard <> '') > 0 THEN list_sort(list(field) FILTER (guard <> '')) ELSE list_sort(list(field)) END)[1:3], ', ') AS phrase FROM fg GROUP BY 1""")
def i3_evidence_phrase(spark, sf):
    return cl.evidence_phrase(guarded_fields(spark, sf), ["store"])


@query("c24_apply_edits", f"""WITH e AS (SELECT user_id AS s_suppkey, arg_max(v, event_id) FILTER (v <> 'vendor') AS v FROM (SELECT *, CASE event_type WHEN 'click' THEN 'processor' WHEN 'view' THEN 'internal' WHEN 'error' THEN 'vendor' ELSE 'external_controller' END AS v FROM events) GROUP BY 1)
SELECT s.s_suppkey, coalesce(e.v, CASE WHEN s_nationkey % 2 = 0 THEN 'unknown' END) AS recipient_kind FROM supplier s LEFT JOIN e USING (s_suppkey)""")
def c24_apply_edits(spark, sf):
    kind = F.col("event_type")
    edits = read(spark, sf, "events").select(
        F.col("user_id").alias("s_suppkey"), F.col("event_id").alias("ord"),
        F.when(kind == "click", "processor").when(kind == "view", "internal").when(kind == "error", "vendor").otherwise("external_controller").alias("value"))
    stores = read(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, "third_party").otherwise("log").alias("kind"), F.lit(None).cast("string").alias("recipient_kind"))
    return cl.apply_edits(stores, edits, ["s_suppkey"])[0].select("s_suppkey", "recipient_kind")


@query("d3_disagreement", """SELECT user_id, CASE WHEN count(DISTINCT event_type) > 1 THEN 'DISAGREE' ELSE min(event_type) END AS mode FROM events WHERE value > 60 GROUP BY user_id""")
def d3_disagreement(spark, sf):
    from datarights.operators.inventory import one_or_disagree
    return one_or_disagree(read(spark, sf, "events").where("value > 60").select("user_id", F.col("event_type").alias("mode")), ["user_id"])


RISK_SQL = """rf AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'erased_after_timer' WHEN '2-HIGH' THEN 'not_erased' WHEN '5-LOW' THEN 'no_entry_point' ELSE 'erased' END AS verdict,
 CASE WHEN o_totalprice > 400000 THEN 'contact' ELSE 'technical' END AS category FROM orders),
rr AS (SELECT o_custkey, CASE WHEN bool_or(verdict IN ('not_erased', 'no_entry_point') AND category = 'contact') THEN 'high' WHEN bool_and(verdict IN ('erased', 'erased_after_timer')) AND bool_or(verdict = 'erased_after_timer') THEN 'medium' ELSE 'low' END AS rating FROM rf GROUP BY 1)"""


def order_risk(spark, sf):
    p = F.col("o_orderpriority")
    verdict = F.when(p == "1-URGENT", "erased_after_timer").when(p == "2-HIGH", "not_erased").when(p == "5-LOW", "no_entry_point").otherwise("erased")
    return read(spark, sf, "orders").select("o_custkey", verdict.alias("verdict"), F.when(F.col("o_totalprice") > 400000, "contact").otherwise("technical").alias("category"))


@query("e24_risk_rating", f"WITH {RISK_SQL} SELECT o_custkey, rating FROM rr")
def e24_risk_rating(spark, sf):
    return cl.risk_rating(order_risk(spark, sf), ["o_custkey"])


@query("e25_rating_cross_check", f"""WITH {RISK_SQL}, v AS (SELECT o_custkey, CASE WHEN bool_or(verdict IN ('not_erased', 'no_entry_point') AND (category = 'contact' OR o_custkey % 5 = 0)) THEN 'high'
 WHEN bool_or(verdict IN ('erased', 'erased_after_timer')) AND NOT bool_or(verdict NOT IN ('erased', 'erased_after_timer')) AND bool_or(verdict = 'erased_after_timer') THEN 'medium' ELSE 'low' END AS computed FROM rf GROUP BY 1)
SELECT o_custkey, rating, computed FROM rr JOIN v USING (o_custkey) WHERE rating <> computed""")
def e25_rating_cross_check(spark, sf):
    facts = order_risk(spark, sf)
    seen = facts.select("o_custkey", "verdict", F.when(F.col("category") == "contact", "strong").otherwise("").alias("guard"),
                        (F.col("o_custkey") % 5 == 0).alias("linked"), F.lit(3).alias("n_columns"))
    return cl.rating_cross_check(cl.risk_rating(facts, ["o_custkey"]), cl.verifier_rating(seen, ["o_custkey"]), ["o_custkey"])


@query("e28_acceptance", """
WITH f AS (SELECT user_id, event_type FROM events WHERE value > 120)
SELECT DISTINCT user_id, NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = e.user_id AND event_type IN ('error', 'purchase')) AS accepted FROM events e""")
def e28_acceptance(spark, sf):
    """Users are the records; many have no finding at all."""
    events = read(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "bad_citation").when(F.col("event_type") == "purchase", "rejected_claim").otherwise("divergence")
    return cl.acceptance(events.select("user_id"), events.where("value > 120").select("user_id", kind.alias("kind")), ["user_id"])


@query("i2_fixed_order", """SELECT o_orderpriority, store_kind, (CASE store_kind WHEN 'relational' THEN 0 WHEN 'object_storage' THEN 1 WHEN 'cache' THEN 2 WHEN 'log' THEN 5 ELSE 7 END)::INT AS ord, n
FROM (SELECT o_orderpriority, ['third_party', 'log', 'cache', 'object_storage', 'relational'][(left(o_orderpriority, 1)::INT)] AS store_kind, count(*) AS n FROM orders GROUP BY 1, 2)""")
def i2_fixed_order(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("third_party", "log", "cache", "object_storage", "relational")])
    rows = read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn(
        "store_kind", F.element_at(kinds, F.substring("o_orderpriority", 1, 1).cast("int")))
    return ordered(rows, "store_kind", KIND_ORDER, ["o_orderpriority"])
