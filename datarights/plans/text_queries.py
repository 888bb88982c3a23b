"""Queries over names, fields, routes and prices derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from datarights.functions import text as t
from datarights.functions.pricing import price_usage, resolve_model
from datarights.plans.registry import query, read
from datarights.plans.sqltext import s_array, s_base, s_list, s_norm_of
from datarights.session import rule_table
from datarights.sources.rules import rules

R = rules()
WORDS = "[A-Za-z0-9_]+"
NORM_WORDS_SQL = f"""
w AS (SELECT unnest(regexp_extract_all(text, '{WORDS}')) AS word FROM documents),
b AS (SELECT word, {s_base('word')} AS stem0 FROM w),
n AS (SELECT word, {s_norm_of('stem0')} AS stem FROM b)
"""


def document_words(spark, sf):
    return read(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("word"))


@query("b1_norm", f"WITH {NORM_WORDS_SQL} SELECT stem, count(*) AS n FROM n GROUP BY stem")
def b1_norm(spark, sf):
    # Count words first: normalisation then runs once per distinct word.
    words = document_words(spark, sf).groupBy("word").agg(F.count("*").alias("k"))
    return words.select(t.norm("word").alias("stem"), "k").groupBy("stem").agg(F.sum("k").alias("n"))


PREFIXES = ["small", "red", "big", "blue"]


@query("b2_prefix_norm", f"""
WITH b AS (SELECT p_partkey, p_size, {s_base('p_name')} AS s FROM part),
st AS (SELECT p_partkey, p_size, s,
  CASE {' '.join(f"WHEN s LIKE '{p}\\_%' ESCAPE '\\' AND length(s) > {len(p) + 1} THEN substr(s, {len(p) + 2})" for p in PREFIXES)}
  ELSE s END AS cut FROM b),
kn AS (SELECT DISTINCT {s_norm_of('cut')} AS k FROM st WHERE p_size > 25),
pick AS (SELECT p_partkey, CASE WHEN cut <> s AND {s_norm_of('cut')} IN (SELECT k FROM kn) THEN cut ELSE s END AS c FROM st)
SELECT p_partkey, {s_norm_of('c')} AS stem FROM pick""")
def b2_prefix_norm(spark, sf):
    part = read(spark, sf, "part")
    known = part.where("p_size > 25").select("p_name")
    return t.norm_with_prefixes(part.select("p_partkey", "p_name"), "p_name", PREFIXES,
                                known, "p_name").select("p_partkey", "stem")


@query("b3_norm_simple", f"""
WITH {NORM_WORDS_SQL}, x AS (SELECT word, stem,
  CASE WHEN b0 LIKE '%s' AND length(b0) > 3 THEN left(b0, length(b0) - 1) ELSE b0 END AS simple
  FROM (SELECT word, stem, {s_base('word')} AS b0 FROM n))
SELECT stem, simple, count(*) AS n FROM x WHERE stem <> simple GROUP BY stem, simple""")
def b3_norm_simple(spark, sf):
    words = document_words(spark, sf).groupBy("word").agg(F.count("*").alias("k"))
    both = words.select(t.norm("word").alias("stem"), t.norm_simple("word").alias("simple"), "k")
    return both.where("stem <> simple").groupBy("stem", "simple").agg(F.sum("k").alias("n"))


@query("b4_split_camel", """
SELECT c_custkey, regexp_replace(lower(c_mktsegment) || replace(c_name, '#', 'Key'),
  '([a-z0-9])([A-Z])', '\\1_\\2', 'g') AS words FROM customer""")
def b4_split_camel(spark, sf):
    name = F.concat(F.lower("c_mktsegment"), F.replace(F.col("c_name"), F.lit("#"), F.lit("Key")))
    return read(spark, sf, "customer").select("c_custkey", t.split_camel(name).alias("words"))


# Field names a warehouse could carry, one per customer row, made of that row's values.
FIELD_TAILS = ["email", "Phones", "name", "Notes", "id", "IP Address", "deleted_at", "status"]
FIELDS_SQL = f"""
f AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN tail ELSE lower(c_mktsegment) || '_' || tail END AS field
  FROM (SELECT *, ({s_array(FIELD_TAILS)})[(c_custkey % {len(FIELD_TAILS)}) + 1] AS tail FROM customer)),
fb AS (SELECT c_custkey, field, {s_base('field')} AS b0 FROM f),
fn AS (SELECT c_custkey, field, {s_norm_of('b0')} AS stem FROM fb)
"""


def customer_fields(spark, sf):
    tail = F.element_at(F.array(*[F.lit(w) for w in FIELD_TAILS]),
                        (F.col("c_custkey") % len(FIELD_TAILS)).cast("int") + 1)
    field = F.when(F.col("c_nationkey") % 2 == 0, tail).otherwise(
        F.concat(F.lower("c_mktsegment"), F.lit("_"), tail))
    return read(spark, sf, "customer").select("c_custkey", field.alias("field"))


STRONG_SQL = s_list(sorted({t.py_norm(w) for w in R.words("strong_fields")}))
QUALIFIED_SQL = s_list(sorted({t.py_norm(w) for w in R.words("qualified_fields")}))
GUARD_SQL = (f"CASE WHEN stem IN {STRONG_SQL} THEN 'strong' WHEN stem IN {QUALIFIED_SQL} THEN 'qualified' "
             f"WHEN contains(stem, '_') AND regexp_extract(stem, '([^_]*)$', 1) IN {STRONG_SQL} "
             f"THEN 'strong' ELSE '' END")


@query("b5_guard_level", f"""
WITH {FIELDS_SQL} SELECT field, guard, count(*) AS n
FROM (SELECT field, {GUARD_SQL} AS guard FROM fn) GROUP BY field, guard""")
def b5_guard_level(spark, sf):
    guard = t.guard_level("field", R.words("strong_fields"), R.words("qualified_fields"))
    return (customer_fields(spark, sf).groupBy("field").agg(F.count("*").alias("n"))
            .select("field", guard.alias("guard"), "n"))


CATEGORY_CASE = " ".join(
    f"WHEN stem IN {s_list(sorted({t.py_norm(n) for n in names}))} THEN '{cat}'"
    for cat, names in R.rows("categories"))


@query("b6_category", f"""
WITH {FIELDS_SQL} SELECT category, count(*) AS n FROM
(SELECT CASE {CATEGORY_CASE} ELSE 'unclassified' END AS category FROM fn) GROUP BY category""")
def b6_category(spark, sf):
    rows = [(t.py_norm(n), cat) for cat, names in R.rows("categories") for n in names]
    taxonomy = rule_table(spark, sorted(dict(reversed(rows)).items()), "stem string, category string")
    fields = customer_fields(spark, sf).groupBy("field").agg(F.count("*").alias("k"))
    named = fields.withColumn("stem", t.norm("field")).join(taxonomy, "stem", "left")
    return (named.groupBy(F.coalesce("category", F.lit("unclassified")).alias("category"))
            .agg(F.sum("k").alias("n")))


SUBJECTS = R.words("subject_words")


@query("b7_subject_word", f"""
WITH names AS (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier
  UNION ALL SELECT event_type FROM events UNION ALL SELECT 'user' || p_brand FROM part),
b AS (SELECT name, {s_base("regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')")} AS b0 FROM names)
SELECT subject, root, count(*) AS n FROM (SELECT
 ({' OR '.join(f"contains(stem, '{w}')" for w in SUBJECTS)}) AS subject,
 stem0 IN {s_list(sorted({t.py_norm(w) for w in R.words('subject_root_names')}))} AS root
 FROM (SELECT {s_norm_of('b0')} AS stem, {s_norm_of('b1')} AS stem0 FROM (SELECT *, {s_base('name')} AS b1 FROM b)))
GROUP BY subject, root""")
def b7_subject_word(spark, sf):
    names = (read(spark, sf, "customer").select(F.col("c_name").alias("name"))
             .unionByName(read(spark, sf, "supplier").select(F.col("s_name").alias("name")))
             .unionByName(read(spark, sf, "events").select(F.col("event_type").alias("name")))
             .unionByName(read(spark, sf, "part").select(F.concat(F.lit("user"), "p_brand").alias("name"))))
    counted = names.groupBy("name").agg(F.count("*").alias("k"))
    return (counted.select(t.subject_word("name", SUBJECTS).alias("subject"),
                           t.in_words(F.col("name"), R.words("subject_root_names")).alias("root"), "k")
            .groupBy("subject", "root").agg(F.sum("k").alias("n")))


VERBS = ["purge", "Erase", "deleteUser", "wipe", "remove", "closeAccount", "forgetMe"]
_VOCAB = R.words("vocabulary")
_ACTION = R.words("action_only")


def _longest_sql(words: list[str]) -> str:
    ranked = [w for _, w in sorted(enumerate(words), key=lambda p: (-len(p[1]), p[0]))]
    return "CASE " + " ".join(f"WHEN contains(stem, '{w}') THEN '{w}'" for w in ranked) + " END"


@query("b8_vocabulary", f"""
WITH v AS (SELECT ({s_array(VERBS)})[(user_id % {len(VERBS)}) + 1] || CASE WHEN event_id % 3 = 0 THEN '_user_' ELSE '_' END || event_type AS name FROM events),
b AS (SELECT name, {s_base("regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')")} AS b0 FROM v),
s AS (SELECT name, {s_norm_of('b0')} AS stem FROM b),
h AS (SELECT name, stem, {_longest_sql(_VOCAB)} AS best, {_longest_sql([w for w in _VOCAB if w not in _ACTION])} AS other,
  ({' OR '.join(f"contains(stem, '{w}')" for w in SUBJECTS)}) AS subject FROM s)
SELECT hit, count(*) AS n FROM (SELECT CASE WHEN best IN {s_list(_ACTION)} AND NOT subject THEN other ELSE best END AS hit FROM h)
GROUP BY hit""")
def b8_vocabulary(spark, sf):
    verb = F.element_at(F.array(*[F.lit(w) for w in VERBS]), (F.col("user_id") % len(VERBS)).cast("int") + 1)
    name = F.concat(verb, F.when(F.col("event_id") % 3 == 0, "_user_").otherwise("_"), "event_type")
    names = read(spark, sf, "events").select(name.alias("name")).groupBy("name").agg(F.count("*").alias("k"))
    return (names.select(t.vocabulary_hit("name", _VOCAB, _ACTION, SUBJECTS).alias("hit"), "k")
            .groupBy("hit").agg(F.sum("k").alias("n")))


ROUTE_TAILS = ["", "/users/{id}", "/account/delete/", "/posts/{post_id}", "/me"]


@query("b9_subject_path", f"""
WITH r AS (SELECT page_id, url || ({s_array(ROUTE_TAILS)})[(page_id % 5) + 1] AS route FROM pages),
s AS (SELECT page_id, route, list_filter(regexp_split_to_array(route, '[/\\\\]+'),
  lambda x: regexp_matches(x, '[a-zA-Z]') AND NOT regexp_matches(x, '^[{{<:%$]')) AS segs FROM r),
b AS (SELECT page_id, route, list_transform(segs, lambda x: {s_base("regexp_replace(x, '[^\\pL\\pN_-]', ' ', 'g')")}) AS stems0 FROM s),
n AS (SELECT page_id, route, list_filter(list_transform(stems0, lambda x: {s_norm_of('x')}),
  lambda x: x NOT IN {s_list(sorted({t.py_norm(w) for w in R.words('excluded_verbs')}))}) AS res FROM b)
SELECT page_id, coalesce(res[-1] IN {s_list(sorted({t.py_norm(w) for w in R.words('subject_segments')}))}, false) AS names_subject FROM n""")
def b9_subject_path(spark, sf):
    tail = F.element_at(F.array(*[F.lit(w) for w in ROUTE_TAILS]), (F.col("page_id") % 5).cast("int") + 1)
    return read(spark, sf, "pages").select("page_id", t.subject_path_segment(
        F.concat("url", tail), R.words("subject_segments"), R.words("excluded_verbs")).alias("names_subject"))


CASCADES = ["all, delete-orphan", "save-update", "delete", "delete-orphan", "save-update, delete"]


@query("b10_cascade_token", f"""
SELECT o_orderpriority, is_delete, count(*) AS n FROM (SELECT o_orderpriority,
 list_has_any(list_transform(string_split(({s_array(CASCADES)})[(o_orderkey % 5) + 1], ','), lambda x: trim(x)), ['delete', 'all']) AS is_delete
 FROM orders) GROUP BY ALL""")
def b10_cascade_token(spark, sf):
    cascade = F.element_at(F.array(*[F.lit(w) for w in CASCADES]), (F.col("o_orderkey") % 5).cast("int") + 1)
    return (read(spark, sf, "orders")
            .select("o_orderpriority", t.cascade_is_delete(cascade, R.words("cascade_tokens")).alias("is_delete"))
            .groupBy("o_orderpriority", "is_delete").agg(F.count("*").alias("n")))


@query("b11_soft_delete_field", f"""
WITH {FIELDS_SQL} SELECT field, stem IN {s_list(sorted({t.py_norm(w) for w in R.words('marker_fields')}))} AS marker, count(*) AS n
FROM fn GROUP BY ALL""")
def b11_soft_delete_field(spark, sf):
    return (customer_fields(spark, sf).groupBy("field").agg(F.count("*").alias("n"))
            .select("field", t.in_words(F.col("field"), R.words("marker_fields")).alias("marker"), "n"))


@query("b14_namespace", """
WITH k AS (SELECT url AS key FROM pages UNION ALL SELECT o_orderpriority FROM orders
  UNION ALL SELECT p_brand || '|' || p_name FROM part UNION ALL SELECT p_type FROM part)
SELECT ns, count(*) AS n FROM (SELECT CASE WHEN contains(key, ':') THEN split_part(key, ':', 1)
  WHEN contains(key, '/') THEN split_part(key, '/', 1) WHEN contains(key, '|') THEN split_part(key, '|', 1)
  WHEN contains(key, '-') THEN split_part(key, '-', 1) ELSE key END AS ns FROM k) GROUP BY ns""")
def b14_namespace(spark, sf):
    part = read(spark, sf, "part")
    keys = (read(spark, sf, "pages").select(F.col("url").alias("key"))
            .unionByName(read(spark, sf, "orders").select(F.col("o_orderpriority").alias("key")))
            .unionByName(part.select(F.concat("p_brand", F.lit("|"), "p_name").alias("key")))
            .unionByName(part.select(F.col("p_type").alias("key"))))
    return keys.select(t.namespace("key").alias("ns")).groupBy("ns").agg(F.count("*").alias("n"))


@query("b15_raw_delete_target", """
WITH s AS (SELECT CASE event_id % 4 WHEN 0 THEN 'DELETE FROM ' || event_type || '_log WHERE user_id = ' || user_id
  WHEN 1 THEN 'delete  from "' || event_type || '" ' WHEN 2 THEN 'SELECT * FROM ' || event_type ELSE props END AS q FROM events)
SELECT nullif(regexp_extract(q, '(?i)delete\\s+from\\s+["''`]?([A-Za-z_]\\w*)', 1), '') AS target, count(*) AS n FROM s GROUP BY 1""")
def b15_raw_delete_target(spark, sf):
    k = F.col("event_id") % 4
    text = (F.when(k == 0, F.concat(F.lit("DELETE FROM "), "event_type", F.lit("_log WHERE user_id = "), F.col("user_id").cast("string")))
            .when(k == 1, F.concat(F.lit('delete  from "'), "event_type", F.lit('" ')))
            .when(k == 2, F.concat(F.lit("SELECT * FROM "), "event_type")).otherwise(F.col("props")))
    return (read(spark, sf, "events").select(t.raw_delete_target(text).alias("target"))
            .groupBy("target").agg(F.count("*").alias("n")))


@query("b16_cron_literal", """
WITH c AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 60) || ' ' || (o_custkey % 24) || ' * * 1-5'
  WHEN 1 THEN '*/' || (o_custkey % 9 + 1) || '  * 1,15 * *' ELSE (o_orderkey % 60) || ' * * *' END AS s FROM orders)
SELECT regexp_matches(s, '^([-*/,0-9]+\\s+){4}[-*/,0-9]+$') AS cron, count(*) AS n FROM c GROUP BY 1""")
def b16_cron_literal(spark, sf):
    k = F.col("o_orderkey") % 3
    minute = (F.col("o_orderkey") % 60).cast("string")
    text = (F.when(k == 0, F.concat(minute, F.lit(" "), (F.col("o_custkey") % 24).cast("string"), F.lit(" * * 1-5")))
            .when(k == 1, F.concat(F.lit("*/"), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit("  * 1,15 * *")))
            .otherwise(F.concat(minute, F.lit(" * * *"))))
    return read(spark, sf, "orders").select(t.is_cron(text).alias("cron")).groupBy("cron").agg(F.count("*").alias("n"))


_TOK = f"list_transform(regexp_extract_all(line, '{WORDS}'), lambda x: {s_base('x')})"


@query("b18_line_contains", f"""
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT source, list_transform({_TOK}, lambda x: {s_norm_of('x')}) AS toks FROM l)
SELECT source, sum(CASE WHEN list_contains(toks, 'license') THEN 1 ELSE 0 END)::BIGINT AS n_license,
 sum(CASE WHEN list_contains(toks, 'of') AND list_contains(toks, 'the') THEN 1 ELSE 0 END)::BIGINT AS n_dotted, count(*) AS n_lines
FROM k GROUP BY source""")
def b18_line_contains(spark, sf):
    lines = read(spark, sf, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))

    def hits(symbol: str):
        return F.sum(t.line_contains(F.col("line"), F.lit(symbol)).cast("bigint"))
    return lines.groupBy("source").agg(hits("Licenses").alias("n_license"), hits("of.the").alias("n_dotted"),
                                       F.count("*").alias("n_lines"))


# Made-up model names and prices: a price list is an input of the operator.
PRICES = [("large-5", "5.0", "25.0"), ("medium-5", "2.0", "10.0"), ("small-4", "1.0", "5.0")]
ALIASES = [("large", "large-5"), ("medium", "medium-5"), ("large-4-8", "large-5")]
MODEL_NAMES = ["Large-5[1m]", "medium", "small-4-20250101", "large-4-8-20240101", "tiny", "small-4"]
MODEL_SQL = f"""
m AS (SELECT event_id, user_id, value, regexp_replace(lower(trim(({s_array(MODEL_NAMES)})[(event_id % 6) + 1])), '\\[[0-9]+[km]\\]$', '') AS plain FROM events),
u AS (SELECT *, regexp_replace(plain, '-20[0-9]{{6}}$', '') AS undated FROM m),
p(model, price_in, price_out) AS (VALUES {', '.join(f"('{a}', {b}::DECIMAL(12,4), {c}::DECIMAL(12,4))" for a, b, c in PRICES)}),
a(alias, model) AS (VALUES {', '.join(f"('{x}', '{y}')" for x, y in ALIASES)}),
r AS (SELECT u.*, coalesce(p1.model, a1.model, p2.model, a2.model) AS model FROM u
  LEFT JOIN p p1 ON u.plain = p1.model LEFT JOIN a a1 ON u.plain = a1.alias
  LEFT JOIN p p2 ON u.undated = p2.model LEFT JOIN a a2 ON u.undated = a2.alias)
"""


def model_events(spark, sf):
    name = F.element_at(F.array(*[F.lit(w) for w in MODEL_NAMES]), (F.col("event_id") % 6).cast("int") + 1)
    prices = spark.createDataFrame(PRICES, "model string, price_in string, price_out string").select(
        "model", F.col("price_in").cast("decimal(12,4)").alias("price_in"),
        F.col("price_out").cast("decimal(12,4)").alias("price_out"))
    aliases = spark.createDataFrame(ALIASES, "alias string, model string")
    events = read(spark, sf, "events").select("event_id", "user_id", "value", name.alias("name"))
    return resolve_model(events, "name", prices, aliases), prices


@query("b20_resolve_model", f"WITH {MODEL_SQL} SELECT plain, model, count(*) AS n FROM r GROUP BY plain, model")
def b20_resolve_model(spark, sf):
    named, _ = model_events(spark, sf)
    return named.groupBy(t.plain_model_name("name").alias("plain"), "model").agg(F.count("*").alias("n"))


@query("b21_price_usage", f"""
WITH {MODEL_SQL}, t AS (SELECT *, floor(value)::BIGINT AS i, (event_id % 50)::BIGINT AS o, (user_id % 40)::BIGINT AS cr,
  (event_id % 30)::BIGINT AS cw, least(event_id % 7, event_id % 30)::BIGINT AS cw1 FROM r),
c AS (SELECT t.model, i, (i * price_in + o * price_out + cr * price_in * 0.1 + (cw - cw1) * price_in * 1.25 + cw1 * price_in * 2) AS micro
  FROM t LEFT JOIN p ON t.model = p.model)
SELECT model, count(*) AS n, sum(i)::BIGINT AS input, (sum(micro))::DOUBLE AS micro_usd FROM c GROUP BY model""")
def b21_price_usage(spark, sf):
    named, prices = model_events(spark, sf)
    usage = named.select("model", F.floor("value").alias("input"), (F.col("event_id") % 50).alias("output"),
                         (F.col("user_id") % 40).alias("cache_read"), (F.col("event_id") % 30).alias("cache_write"),
                         (F.col("event_id") % 7).alias("cache_write_1h"))
    priced = price_usage(usage, prices)
    return priced.groupBy("model").agg(
        F.count("*").alias("n"), F.sum("input").alias("input"),
        F.sum("micro_usd").cast("double").alias("micro_usd"))


@query("b23_parse_citation", """
WITH c AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || ':' || (page_id + 1) WHEN 1 THEN url ELSE url || ':x' END AS cite FROM pages)
SELECT page_id, CASE WHEN regexp_matches(cite, '^.*:[0-9]+$') THEN regexp_extract(cite, '^(.*):([0-9]+)$', 1) END AS file,
 CASE WHEN regexp_matches(cite, '^.*:[0-9]+$') THEN regexp_extract(cite, '^(.*):([0-9]+)$', 2)::INT END AS line FROM c""")
def b23_parse_citation(spark, sf):
    k = F.col("page_id") % 3
    cite = (F.when(k == 0, F.concat("url", F.lit(":"), (F.col("page_id") + 1).cast("string")))
            .when(k == 1, F.col("url")).otherwise(F.concat("url", F.lit(":x"))))
    found = read(spark, sf, "pages").select("page_id", t.parse_citation(cite).alias("c"))
    return found.select("page_id", F.col("c.file").alias("file"), F.col("c.line").alias("line"))
