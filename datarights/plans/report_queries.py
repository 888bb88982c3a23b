"""Report sections over records made of suppliers (stores) and the kinds of their line items (fields, evidence)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from datarights.operators.report import CATEGORY_ORDER, KIND_ORDER, VERDICT_ORDER, report_tables
from datarights.plans.registry import query, read
from datarights.plans.sqltext import s_array


def _word(words: list[str], at):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (at + 1).cast("int"))


def record_tables(spark, sf):
    """stores, fields, retention, evidence; a record is a nation."""
    s = read(spark, sf, "supplier")
    key, name = F.col("s_suppkey"), F.col("s_name").alias("store")
    verdict = _word(VERDICT_ORDER, key % 10)
    stores = s.select(F.col("s_nationkey").alias("record"), name, _word(KIND_ORDER, key % 8).alias("kind"), verdict.alias("verdict"),
                      F.when(verdict == "erased_after_timer", (key % 365).cast("int")).alias("timer_days"),
                      F.when(key % 3 == 1, "processor").when(key % 3 == 2, "controller").alias("recipient_kind"),
                      F.lit("infra/main.tf").alias("file"), key.cast("int").alias("line"))
    items = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag", "l_linenumber", "l_linestatus", "l_orderkey")
    field, n = F.concat(F.lower("l_returnflag"), F.col("l_linenumber").cast("string")), F.col("l_linenumber")
    owned = items.join(s.select("s_suppkey", "s_name", F.col("s_nationkey").alias("record")), "s_suppkey")
    fields = owned.select("record", name, field.alias("field"), _word(CATEGORY_ORDER, n % 6).alias("category"),
                          F.when(F.col("l_returnflag") == "R", _word(VERDICT_ORDER, (key + n) % 10)).alias("verdict"), F.lit("app/models.py").alias("file"), n.alias("line")).distinct()
    balance = F.col("s_acctbal")
    retention = s.where(balance > 0).select(F.col("s_nationkey").alias("record"), F.upper(F.replace("s_name", F.lit("#"), F.lit(" "))).alias("store"), _word(CATEGORY_ORDER, key % 6).alias("category"),
                                            F.when(balance > 2000, F.floor(balance / 10).cast("int")).alias("days"), F.when(balance > 6000, "after the contract ends").alias("criteria"),
                                            F.lit("docs/retention.md").alias("file"), key.cast("int").alias("line"))
    evidence = owned.select("record", name, F.when(F.col("l_linestatus") == "F", field).alias("field"),
                            F.concat(F.lit("app/orders"), (F.col("l_orderkey") % 7).cast("string"), F.lit(".py")).alias("file"), n.alias("line")).distinct()
    return stores, fields, retention, evidence


#: What each section shows beside record, store and place.
SECTIONS = {"inventory": ("field", "category", "kind"), "recipients": ("recipient_kind", "open", None), "retention": ("category", "limit", "line"),
            "erasure": ("field", "verdict", "cites"), "open_cells": ("cell", None, None)}


@query("f20_report", f"""
WITH st AS (SELECT s_nationkey AS record, s_name AS store, {s_array(KIND_ORDER)}[(s_suppkey % 8 + 1)::INT] AS kind, {s_array(VERDICT_ORDER)}[(s_suppkey % 10 + 1)::INT] AS verdict,
  CASE s_suppkey % 3 WHEN 1 THEN 'processor' WHEN 2 THEN 'controller' ELSE 'unknown' END AS rk, s_suppkey, s_acctbal AS b, s_suppkey % 8 AS kp, s_suppkey % 10 AS vp FROM supplier),
li AS (SELECT *, lower(l_returnflag) || l_linenumber AS field FROM lineitem JOIN st ON l_suppkey = s_suppkey),
fi AS (SELECT DISTINCT record, store, field, l_linenumber AS n, l_returnflag, s_suppkey, kind, kp FROM li),
ev AS (SELECT record, store, CASE WHEN l_linestatus = 'F' THEN field END AS field, list_sort(list(DISTINCT 'app/orders' || (l_orderkey % 7) || '.py:' || l_linenumber)) AS cites FROM li GROUP BY ALL),
er AS (SELECT record, store, NULL AS field, verdict, vp FROM st
  UNION ALL SELECT record, store, field, {s_array(VERDICT_ORDER)}[((s_suppkey + n) % 10 + 1)::INT], (s_suppkey + n) % 10 FROM fi WHERE l_returnflag = 'R'),
re AS (SELECT record, store, CASE WHEN b > 0 THEN {s_array(CATEGORY_ORDER)}[(s_suppkey % 6 + 1)::INT] END AS category, CASE WHEN b > 0 THEN s_suppkey END AS line, kp,
  CASE WHEN b > 6000 THEN floor(b / 10)::INT || ' days after the contract ends' WHEN b > 2000 THEN floor(b / 10)::INT || ' days' ELSE 'NO TIMER EVIDENCED' END AS lim FROM st)
SELECT 'inventory' AS section, record, store, field AS item, {s_array(CATEGORY_ORDER)}[(n % 6 + 1)::INT] AS what, kind AS more, kp::INT AS ord FROM fi
UNION ALL SELECT 'recipients', record, store, rk, CASE WHEN rk = 'unknown' THEN 'true' ELSE 'false' END, NULL, NULL FROM st WHERE kind = 'third_party'
UNION ALL SELECT 'retention', record, store, category, lim, line::VARCHAR, kp::INT FROM re
UNION ALL SELECT 'erasure', er.record, er.store, er.field, verdict, array_to_string(cites, ','), vp::INT FROM er LEFT JOIN ev ON er.record = ev.record AND er.store = ev.store AND er.field IS NOT DISTINCT FROM ev.field
UNION ALL SELECT 'open_cells', record, store, 'recipient_kind', NULL, NULL, NULL FROM st WHERE kind = 'third_party' AND rk = 'unknown'
UNION ALL SELECT 'open_cells', record, store, 'retention justification', NULL, NULL, NULL FROM re""")
def f20(spark, sf):
    tables = report_tables(*record_tables(spark, sf), ["record"])
    parts = []
    for section, (item, what, more) in SECTIONS.items():
        t = tables[section]
        shown = F.concat_ws(",", more) if more == "cites" else F.col(more).cast("string") if more else F.lit(None).cast("string")
        if more == "cites":
            shown = F.when(F.col(more).isNotNull(), shown)
        ord_ = F.col("ord") if "ord" in t.columns else F.lit(None).cast("int")
        what_ = F.col(what).cast("string") if what else F.lit(None).cast("string")
        parts.append(t.select(F.lit(section).alias("section"), "record", "store", F.col(item).alias("item"), what_.alias("what"), shown.alias("more"), ord_.alias("ord")))
    return reduce(lambda a, b: a.unionByName(b), parts)
