"""Claims scored against truth: matching, precision and recall, unsafe claims, regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.functions.text import norm, singular, strip_prefix, base

REACHING = ["erased", "erased_after_timer", "anonymised"]
BACKUP_ONLY = ["governed_by_retention", "no_schedule_evidenced"]


def count_if(test) -> F.Column:
    return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("bigint")


def ratio(top, bottom):
    """top/bottom as a double; 0 where there is nothing to divide by."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))


def f1_of(precision, recall):
    return F.when(precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def claim_fields(records: DataFrame) -> DataFrame:
    """One row per claimed field of a record, the field's own verdict before the store's.

    A backup with a verdict that backups do not take is marked invalid and never reaches.
    Input columns: the run keys plus `stores` (array of structs as in a record).
    """
    keys = [c for c in records.columns if c != "stores"]
    stores = records.select(*keys, F.posexplode("stores").alias("store_pos", "s"))
    fields = stores.select(*keys, "store_pos", F.col("s.name").alias("store_name"), F.col("s.kind").alias("kind"),
                           F.col("s.erasure.verdict").alias("store_verdict"), F.col("s.declared_at").alias("declared_at"),
                           F.posexplode("s.fields").alias("field_pos", "f"))
    verdict = F.coalesce("f.erasure.verdict", "store_verdict")
    bad = (F.col("kind") == "backup") & ~verdict.isin(BACKUP_ONLY)
    return fields.select(*keys, "store_pos", "field_pos", "store_name", F.col("f.name").alias("field_name"), "kind",
                         "declared_at", verdict.alias("verdict"), F.coalesce(bad, F.lit(False)).alias("invalid"),
                         (F.coalesce(verdict.isin(REACHING), F.lit(False)) & ~F.coalesce(bad, F.lit(False))).alias("reaches"))


def extract_tuples(claims: DataFrame, run: list[str], store_key="store", field_key="field") -> DataFrame:
    """First claim per (run, store, field) kept; `copies` says how many there were."""
    first = F.min_by(F.struct("verdict", "reaches", "kind", "invalid"), F.struct("store_pos", "field_pos")).alias("c")
    return (claims.groupBy(*run, store_key, field_key).agg(first, F.count("*").alias("copies"))
            .select(*run, store_key, field_key, "c.*", "copies"))


def rekey(claims: DataFrame, truth_stores: DataFrame, run: list[str], prefixes: list[str]) -> DataFrame:
    """Adds `store` and `field`: normalised names, prefix-stripped where the rest is known.

    A claimed store no truth store is named like is re-keyed by its declaration line when that
    line declares a file store (a dotted name) nobody else claims.
    `truth_stores`: case columns in common with `run`, plus name, file, line.
    """
    case = [c for c in run if c in truth_stores.columns]
    bare = base("name")
    known = truth_stores.select(*case, singular(strip_prefix(bare, prefixes)).alias("_k")).distinct()
    stores = claims.select(*run, "store_pos", "store_name", "declared_at").dropDuplicates([*run, "store_pos"])
    stores = stores.withColumn("_b", base("store_name")).withColumn("_p", strip_prefix(F.col("_b"), prefixes))
    hit = known.select(*case, F.col("_k").alias("_ps"), F.lit(True).alias("_known_cut"))
    stores = stores.withColumn("_ps", F.when(F.col("_p") != F.col("_b"), singular(F.col("_p")))).join(hit, [*case, "_ps"], "left")
    stores = stores.withColumn("store", F.when(F.col("_known_cut"), norm("_p")).otherwise(norm("_b")))
    named = known.select(*case, F.col("_k").alias("store"), F.lit(True).alias("_known"))
    stores = stores.join(named, [*case, "store"], "left")
    files = (truth_stores.where("name LIKE '%.%'").groupBy(*case, "file", "line")
             .agg(F.min(norm("name")).alias("_file_store")))
    stores = stores.withColumn("_f", F.col("declared_at.file")).withColumn("_l", F.col("declared_at.line"))
    stores = stores.join(files.select(*case, F.col("file").alias("_f"), F.col("line").alias("_l"), "_file_store"), [*case, "_f", "_l"], "left")
    taken = stores.select(*run, F.col("store").alias("_file_store"), F.lit(True).alias("_taken")).distinct()
    stores = stores.join(taken, [*run, "_file_store"], "left")
    free = F.col("_known").isNull() & F.col("_file_store").isNotNull() & F.col("_taken").isNull()
    first = stores.where(free).groupBy(*run, "_file_store").agg(F.min("store_pos").alias("_first"))
    stores = stores.join(first, [*run, "_file_store"], "left")
    stores = stores.withColumn("store", F.when(free & (F.col("store_pos") == F.col("_first")), F.col("_file_store")).otherwise(F.col("store")))
    return (claims.join(stores.select(*run, "store_pos", "store"), [*run, "store_pos"])
            .withColumn("field", norm("field_name")))


def match_tuples(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match of (verdict, reaches) on `keys`; both sides hold one row per key."""
    p = pred.select(*keys, F.col("reaches").alias("pred_reaches"), F.col("verdict").alias("pred_verdict"),
                    F.lit(True).alias("in_pred"))
    t = truth.select(*keys, F.col("reaches").alias("true_reaches"), F.col("verdict").alias("true_verdict"),
                     F.lit(True).alias("in_truth"))
    both = p.join(t, keys, "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_pred", "in_truth")})


def score(matched: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and the unsafe counts per group.

    A wrong verdict on a matched key counts as a false positive and a false negative.
    """
    both = F.col("in_pred") & F.col("in_truth")
    same = F.col("pred_reaches") == F.col("true_reaches")
    counted = matched.groupBy(*by).agg(
        count_if(both & same).alias("tp"),
        count_if(F.col("in_pred") & ~(both & same)).alias("fp"),
        count_if(F.col("in_truth") & ~(both & same)).alias("fn"),
        count_if(both & F.col("pred_reaches") & ~F.col("true_reaches")).alias("false_safe"),
        count_if(F.col("in_pred") & ~F.col("in_truth") & F.col("pred_reaches")).alias("unmatched_reaching"),
        count_if(F.col("in_pred") & (F.col("pred_verdict") == "unverified")).alias("unverified"))
    return with_prf(counted)


def with_prf(counted: DataFrame) -> DataFrame:
    empty = F.col("tp") + F.col("fp") + F.col("fn") == 0
    out = counted.withColumn("precision", F.when(empty, 1.0).otherwise(ratio(F.col("tp"), F.col("tp") + F.col("fp"))))
    out = out.withColumn("recall", F.when(empty, 1.0).otherwise(ratio(F.col("tp"), F.col("tp") + F.col("fn"))))
    return out.withColumn("f1", F.when(empty, 1.0).otherwise(f1_of(F.col("precision"), F.col("recall"))))


def without_record(scored: DataFrame, has_record) -> DataFrame:
    """A run that delivered no record scores zero and has no false negatives."""
    for column in ("fn", "tp", "fp"):
        scored = scored.withColumn(column, F.when(has_record, F.col(column)).otherwise(F.lit(0).cast("bigint")))
    for column in ("precision", "recall", "f1"):
        scored = scored.withColumn(column, F.when(has_record, F.col(column)).otherwise(0.0))
    return scored


def unsafe_ever(states: DataFrame, truth: DataFrame, run: list[str], keys: list[str]) -> DataFrame:
    """Every tuple that any state of a run claimed to reach erasure and the truth does not, drafts that a gate turned down included.

    `states`: run, attempt, delivered (the record handed over, else a draft), keys, reaches; `truth`: the
    columns it shares with `run`, keys, reaches. One row per run and tuple: the first attempt that claimed
    it, whether a draft and whether the delivered record did, and whether the truth knows the tuple at all.
    States are folded before they meet the truth, so attempts do not multiply it.
    """
    case = [c for c in run if c in truth.columns]
    claimed = states.where("reaches").groupBy(*run, *keys).agg(
        F.min("attempt").alias("first_attempt"), F.bool_or(~F.col("delivered")).alias("in_draft"), F.bool_or("delivered").alias("in_delivered"))
    known = truth.select(*case, *keys, F.col("reaches").alias("_true")).distinct()
    both = claimed.join(known, [*case, *keys], "left").where("NOT coalesce(_true, false)")
    return both.withColumn("matched", F.col("_true").isNotNull()).drop("_true")


def score_states(states: DataFrame, truth: DataFrame, run: list[str], keys: list[str]) -> DataFrame:
    """`score` of every state of a run (run, attempt, delivered): what a rejected draft would have been worth."""
    by = [*run, "attempt", "delivered"]
    asked = states.select(*by).distinct().join(truth, [c for c in run if c in truth.columns])
    return score(match_tuples(states, asked, [*by, *keys]), by)


def confusion(matched: DataFrame, by: list[str]) -> DataFrame:
    return (matched.where("in_pred AND in_truth").groupBy(*by, "true_verdict", "pred_verdict")
            .agg(F.count("*").alias("n")))


def pass_flag(stop, f1, false_safe, duplicates):
    return (stop == "accepted") & (f1 == 1.0) & (false_safe == 0) & (duplicates == 0)


def set_check(pred: DataFrame, truth: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """matched, missing and spurious distinct keys per group."""
    p = pred.select(*keys).distinct().withColumn("_p", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    both = p.join(t, keys, "full_outer")
    return both.groupBy(*by).agg(
        count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("matched"),
        count_if(F.col("_p").isNull()).alias("missing"), count_if(F.col("_t").isNull()).alias("spurious"))


def regressions(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Paired keys that passed before and fail now. Inputs: keys plus boolean `passed`."""
    old = previous.where("passed").select(*keys)
    return current.where("NOT passed").select(*keys).join(old, keys)
