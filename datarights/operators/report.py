"""Report tables of accepted records: inventory, recipients, retention, erasure, open cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.functions import text as t

#: The orders report rows come in.
KIND_ORDER = ["relational", "object_storage", "cache", "search_index", "queue", "log", "backup", "third_party"]
VERDICT_ORDER = ["pseudonymised", "not_erased", "external_manual", "no_entry_point", "governed_by_retention",
                 "no_schedule_evidenced", "unverified", "erased", "erased_after_timer", "anonymised"]
CATEGORY_ORDER = ["identifier", "contact", "financial", "behavioural", "free_text_may_contain", "technical"]


def place_of(column, order: list[str]):
    return (F.array_position(F.array(*[F.lit(w) for w in order]), column) - 1).cast("int")


def ordered(df: DataFrame, column: str, order: list[str], then: list[str]) -> DataFrame:
    """Rows in a fixed order of one column, then by the others; `ord` carries the place."""
    return df.withColumn("ord", place_of(F.col(column), order)).orderBy("ord", *then)


def report_tables(stores: DataFrame, fields: DataFrame, retention: DataFrame, evidence: DataFrame, record: list[str]) -> dict[str, DataFrame]:
    """The sections of a report as tables.

    `stores`: record, store, kind, verdict, timer_days, recipient_kind, file, line.
    `fields`: record, store, field, category, verdict (own, or null), file, line.
    `retention`: record, store, category, days, criteria, file, line.
    `evidence`: record, store, field (or null), file, line.
    """
    inventory = fields.join(stores.select(*record, "store", "kind"), [*record, "store"]).withColumn("ord", place_of(F.col("kind"), KIND_ORDER))
    recipients = (stores.where("kind = 'third_party'")
                  .select(*record, "store", F.coalesce("recipient_kind", F.lit("unknown")).alias("recipient_kind"))
                  .withColumn("open", F.col("recipient_kind") == "unknown"))
    named = retention.withColumn("_k", t.norm_simple("store")).drop("store")
    kept = stores.select(*record, "store", "kind", t.norm_simple("store").alias("_k")).join(named, [*record, "_k"], "left")
    limit = F.concat_ws(" ", F.when(F.col("days").isNotNull(), F.concat(F.col("days").cast("string"), F.lit(" days"))), F.col("criteria"))
    periods = kept.select(*record, "store", "category", F.when(limit == "", "NO TIMER EVIDENCED").otherwise(limit).alias("limit"), "file", "line",
                          place_of(F.col("kind"), KIND_ORDER).alias("ord"))
    cited = evidence.groupBy(*record, "store", "field").agg(F.array_sort(F.collect_set(F.concat_ws(":", "file", F.col("line").cast("string")))).alias("cites"))
    rows = (stores.select(*record, "store", F.lit(None).cast("string").alias("field"), "verdict", "timer_days")
            .unionByName(fields.where("verdict IS NOT NULL").select(*record, "store", "field", "verdict", F.lit(None).cast("int").alias("timer_days"))))
    same = [rows[c].eqNullSafe(cited[c]) for c in [*record, "store", "field"]]
    erasure = (rows.join(cited, same, "left").select(*[rows[c] for c in rows.columns], "cites")
               .withColumn("ord", place_of(F.col("verdict"), VERDICT_ORDER)))
    open_cells = (recipients.where("open").select(*record, "store", F.lit("recipient_kind").alias("cell"))
                  .unionByName(periods.select(*record, "store", F.lit("retention justification").alias("cell")).distinct()))
    return {"inventory": inventory, "recipients": recipients, "retention": periods, "erasure": erasure, "open_cells": open_cells}
