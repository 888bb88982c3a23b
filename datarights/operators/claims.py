"""Submitted claims against computed facts: citations, matching, missing stores, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datarights.functions import text as t
from datarights.operators.scoring import BACKUP_ONLY, REACHING

SPAN = 64
HIGH_RISK = ["not_erased", "pseudonymised", "external_manual", "no_entry_point", "no_schedule_evidenced", "unverified"]
RECIPIENT_KINDS = ["unknown", "internal", "processor", "external_controller"]


# --- citations ------------------------------------------------------------------------------------

def enclosing_span(cites: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `start` and `end` of the smallest span around each cited line, null where none.

    A span is listed under every 64-line bucket it touches, so the range test rides on an
    equality join.
    """
    cites = cites.withColumn("_b", F.floor(F.col("line") / SPAN))
    listed = spans.select(*keys, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor(F.col("end") / SPAN))).alias("_b"))
    asked = cites.select(*keys, "line", "_b").distinct()
    best = (asked.join(listed, [*keys, "_b"]).where("start <= line AND line <= end")
            .groupBy(*keys, "line").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("len"), "start", "end")).alias("s"))
            .select(*keys, "line", "s.start", "s.end"))
    return cites.drop("_b").join(best, [*keys, "line"], "left")


def check_citations(cites: DataFrame, files: DataFrame, line_table: DataFrame, spans: DataFrame, repo: list[str]) -> DataFrame:
    """Adds `problem` to each citation: the first check it fails, or null.

    `cites`: cite_id, repo keys, file, line, symbol (null where none is carried), has_symbol,
    scanned_only. `files`: repo keys, file, n_lines, scanned. `line_table`: repo keys, file, line,
    text. `spans`: repo keys, file, start, end of simple statements.
    """
    keys = [*repo, "file"]
    seen = cites.join(files.select(*keys, "n_lines", "scanned"), keys, "left")
    relative = ~F.col("file").rlike(r"^/|(^|/)\.\.(/|$)") & (F.col("file") != "")
    exists = F.col("n_lines").isNotNull() & relative
    stem = t.norm(F.coalesce("symbol", F.lit("")))
    early = (F.when(~exists, "no_file").when(F.col("scanned_only") & ~F.col("scanned"), "not_scanned")
             .when(~F.col("line").between(1, F.col("n_lines")), "past_end")
             .when(F.col("has_symbol") & (stem == ""), "no_symbol"))
    seen = seen.withColumn("_early", early)
    open_ = enclosing_span(seen.where("_early IS NULL AND has_symbol").select("cite_id", *keys, "line", "symbol"), spans, keys)
    rows = open_.select("cite_id", *keys, t.norm("symbol").alias("_want"), t.symbol_parts(F.col("symbol")).alias("_parts"), F.explode(
        F.sequence(F.coalesce("start", "line"), F.coalesce("end", "line"))).alias("line"))
    # Tokens are made after the join: cited lines only, and of those only words near the symbol. Lines are not sent
    # whole to every executor: alike files are small on disk, and Spark judges their lines by that.
    read = rows.join(line_table.select(*keys, "line", "text").hint("merge"), [*keys, "line"])
    read = read.withColumn("_tok", t.tokens_like("text", F.concat(F.array("_want"), "_parts")))
    found = read.groupBy("cite_id").agg(
        F.bool_or(F.array_contains("_tok", F.col("_want"))).alias("_whole"), F.first("_parts").alias("_parts"),
        F.flatten(F.collect_set(F.array_intersect("_parts", "_tok"))).alias("_got"))
    good = found.where((F.col("_whole")) | ((F.size("_parts") > 1) & (F.size(F.array_except("_parts", "_got")) == 0)))
    out = seen.join(good.select("cite_id", F.lit(True).alias("_good")), "cite_id", "left")
    problem = F.coalesce("_early", F.when(F.col("has_symbol") & F.col("_good").isNull(), "symbol_absent"))
    return out.withColumn("problem", problem).drop("_early", "_good", "n_lines", "scanned")


def evidence_index(cites: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cited line: its symbols and the sections that cite it, both sorted.

    Distinct first, so a line cited by everybody folds before it is gathered.
    """
    flat = cites.select(*keys, "line", "symbol", "section").distinct()
    return flat.groupBy(*keys, "line").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"),
                                           F.array_sort(F.collect_set("section")).alias("sections"))


# --- stores and edits --------------------------------------------------------------------------------

def fires(guard: Column, linked: Column) -> Column:
    """A detected store that must be in the record: strong, or qualified and linked to a subject."""
    return (guard == "strong") | ((guard == "qualified") & linked)


def missing_stores(stores: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    unclaimed = stores.join(matched.select(*keys).distinct(), keys, "left_anti")
    return unclaimed.where(fires(F.col("guard"), F.col("linked")))


def evidence_phrase(fields: DataFrame, keys: list[str], first: int = 3) -> DataFrame:
    """The `first` sorted guarded field names of a store, else of all its fields."""
    distinct = fields.select(*keys, "field", (F.col("guard") != "").alias("_g")).distinct()
    top = distinct.groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_set(F.when(F.col("_g"), F.col("field")))), 1, first).alias("_strong"),
        F.slice(F.array_sort(F.collect_set("field")), 1, first).alias("_all"))
    return top.select(*keys, F.array_join(F.when(F.size("_strong") > 0, F.col("_strong")).otherwise(F.col("_all")), ", ").alias("phrase"))


def apply_edits(stores: DataFrame, edits: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """`recipient_kind` set from human edits; edits outside the enum go to a reject table."""
    good = edits.where(F.col("value").isin(RECIPIENT_KINDS))
    last = good.groupBy(*keys).agg(F.max_by("value", "ord").alias("_edit"))
    out = stores.join(last, keys, "left")
    kind = F.coalesce("_edit", "recipient_kind", F.when(F.col("kind") == "third_party", "unknown"))
    return out.withColumn("recipient_kind", kind).drop("_edit"), edits.where(~F.col("value").isin(RECIPIENT_KINDS))


def acceptance(records: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """Every record and whether it is accepted: none of the three blocking lists has a row for it."""
    blocks = F.col("kind").isin("rejected_claim", "missing_store", "bad_citation")
    blocked = lists.where(blocks).select(*keys).distinct().withColumn("_blocked", F.lit(True))
    return records.select(*keys).distinct().join(blocked, keys, "left").select(*keys, F.col("_blocked").isNull().alias("accepted"))


# --- one-to-one matching of claimed to detected stores --------------------------------------------------

def match_claims(claims: DataFrame, stores: DataFrame, record: list[str]) -> DataFrame:
    """Record store -> detected store, each detected store at most once.

    Sweep one takes claims in order: an exact name among unclaimed stores, else the declaration
    line. Sweep two does the same for what is left and then strips an app prefix.
    `claims`: record keys, claim_pos, name, file, line. `stores`: record keys, store_id, name,
    model, kind, file, line. Within a record claims are settled in order of position, all
    records side by side.
    """
    model_parts = F.split("model", r"\.")
    row_model = F.col("model").isNotNull() & (F.col("kind") == "relational")
    own = F.array(t.norm("store_id"), t.norm("name"), F.when(row_model, t.norm(F.element_at(model_parts, -1))))
    prefix = F.when(row_model, F.concat(t.norm(F.element_at(model_parts, 1)), F.lit("_")))
    keyed = stores.withColumn("_own", own).withColumn("_prefix", prefix)
    cut_keys = F.transform("_own", lambda k: F.when(k.startswith(F.col("_prefix")), F.substr(k, F.length("_prefix") + F.lit(1))))
    keyed = keyed.withColumn("_keys", F.array_distinct(F.filter(F.concat("_own", cut_keys), lambda k: k.isNotNull() & (k != ""))))
    names = keyed.select(*record, "store_id", F.explode("_keys").alias("_k")).distinct()
    asked = claims.select(*record, "claim_pos", t.norm("name").alias("_n"), "file", "line")
    by_name = (asked.join(names.withColumnRenamed("_k", "_n"), [*record, "_n"])
               .select(*record, "claim_pos", "store_id", F.lit(0).alias("how")))
    lines = stores.where("file IS NOT NULL").select(*record, "store_id", "file", "line")
    by_line = asked.join(lines, [*record, "file", "line"]).select(*record, "claim_pos", "store_id", F.lit(1).alias("how"))
    tail = F.when(F.instr("_n", "_") > 0, F.expr("substring(_n, instr(_n, '_') + 1)"))
    stripped = asked.withColumn("_n", tail).where("_n IS NOT NULL").join(names.withColumnRenamed("_k", "_n"), [*record, "_n"])
    by_tail = stripped.select(*record, "claim_pos", "store_id", F.lit(2).alias("how"))
    first = settle_in_order(by_name.unionByName(by_line), record)
    left = by_name.unionByName(by_line).unionByName(by_tail)
    left = left.join(first.select(*record, "claim_pos"), [*record, "claim_pos"], "left_anti")
    left = left.join(first.select(*record, "store_id"), [*record, "store_id"], "left_anti")
    return first.unionByName(settle_in_order(left, record))


def settle_in_order(pairs: DataFrame, record: list[str]) -> DataFrame:
    """Claims in position order each take their best free store, for all records at once.

    In each round a claim settles if no earlier open claim of its record wants any store it
    could still take; chains of claims over one store take one round each, others none.
    """
    from datarights.session import cut

    open_ = cut(pairs.groupBy(*record, "claim_pos", "store_id").agg(F.min("how").alias("how")))
    out = None
    while not open_.isEmpty():
        earliest = open_.groupBy(*record, "store_id").agg(F.min("claim_pos").alias("_first"))
        marked = open_.join(earliest, [*record, "store_id"])
        ready = (marked.groupBy(*record, "claim_pos").agg(
            F.bool_and(F.col("claim_pos") == F.col("_first")).alias("_ready"), F.min(F.struct("how", "store_id")).alias("p"))
            .where("_ready").select(*record, "claim_pos", F.col("p.store_id").alias("store_id"), F.col("p.how").alias("how")))
        won = cut(ready)
        out = won if out is None else out.unionByName(won)
        open_ = cut(open_.join(won.select(*record, "store_id"), [*record, "store_id"], "left_anti")
                    .join(won.select(*record, "claim_pos"), [*record, "claim_pos"], "left_anti"))
    return out if out is not None else open_.select(*record, "claim_pos", "store_id", "how")


# --- verdict comparison ----------------------------------------------------------------------------------

def compare_claims(claims: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `outcome` and `rule` to each claim, by the first rule that fits.

    `claims`: keys (record and store id, null where unmatched), field (null for the store's own
    claim), kind, claimed, cited (array of `file:line`). `verdicts`: keys, found, found_kind, allowed
    (array of `file:line` on the evidence found). A claim safer than the evidence is kept and
    noted; a claim the evidence does not carry is rejected.
    """
    v = verdicts.select(*keys, "found", "found_kind", "allowed", F.lit(True).alias("_seen"))
    both = claims.join(v, keys, "left")
    reaches = F.col("claimed").isin(REACHING)
    found_reaches = F.col("found").isin(REACHING)
    whole = F.col("field").isNull()
    backup = F.col("claimed").isin(BACKUP_ONLY)
    off_path = (whole & (F.col("claimed") == F.col("found")) & reaches & (F.size(F.coalesce("cited", F.array().cast("array<string>"))) > 0)
                & (F.size(F.coalesce("allowed", F.array().cast("array<string>"))) > 0) & ~F.arrays_overlap("cited", "allowed"))
    rule = (F.when((F.col("kind") == "backup") != backup, "wrong_kind")
            .when(F.col("_seen").isNull() & reaches, "uncorroborated")
            .when(F.col("_seen").isNull(), "uncorroborated_safe")
            .when(reaches & (F.col("found") == "unverified"), "unresolved")
            .when(reaches & ~found_reaches, "false_safe")
            .when((F.col("claimed") == "erased") & (F.col("found") == "erased_after_timer"), "timer_first")
            .when((F.col("claimed") == "erased_after_timer") & (F.col("found") == "erased"), "timer_not_needed")
            .when(~reaches & found_reaches, "more_careful")
            .when(~reaches & (F.col("found") == "unverified"), "cannot_tell")
            .when(off_path, "off_path").otherwise("agrees"))
    outcome = (F.when(F.col("rule").isin("wrong_kind", "uncorroborated", "unresolved", "false_safe", "timer_first", "off_path"), "rejected")
               .when(F.col("rule").isin("timer_not_needed", "more_careful"), "divergence")
               .when(F.col("rule").isin("uncorroborated_safe", "cannot_tell"), "informational").otherwise("accepted"))
    return both.withColumn("rule", rule).withColumn("outcome", outcome).drop("_seen")


def wrong_kind_notes(claims: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Matched claims whose stated kind is not the detected one: noted, never blocking."""
    v = verdicts.select(*keys, "found_kind")
    return claims.where("field IS NULL").join(v, keys).where("kind <> found_kind")


# --- ratings ---------------------------------------------------------------------------------------------

def risk_rating(fields: DataFrame, by: list[str]) -> DataFrame:
    """high: a high-risk verdict on a store with an identifier or contact field; medium: all
    stores reach erasure, one of them by timer; low otherwise. `fields`: by, store, verdict, category."""
    rated = fields.groupBy(*by).agg(
        F.bool_or(F.col("verdict").isin(HIGH_RISK) & F.coalesce(F.col("category").isin("identifier", "contact"), F.lit(False))).alias("_high"),
        F.bool_and(F.col("verdict").isin(REACHING)).alias("_all"), F.bool_or(F.col("verdict") == "erased_after_timer").alias("_timer"))
    rating = F.when(F.col("_high"), "high").when(F.col("_all") & F.col("_timer"), "medium").otherwise("low")
    return rated.select(*by, rating.alias("rating"))


def verifier_rating(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """The same rating from verdicts alone: a guard hit, a subject link, or no visible column
    stands in for the category. `verdicts`: by, verdict, guard, linked, n_columns."""
    rated = verdicts.groupBy(*by).agg(
        F.bool_or(F.col("verdict").isin(HIGH_RISK) & ((F.col("guard") != "") | F.col("linked") | (F.col("n_columns") == 0))).alias("_high"),
        F.bool_or(F.col("verdict").isin(REACHING)).alias("_some"),
        F.bool_or(~F.col("verdict").isin(REACHING + BACKUP_ONLY)).alias("_other"),
        F.bool_or(F.col("verdict") == "erased_after_timer").alias("_timer"))
    rating = F.when(F.col("_high"), "high").when(F.col("_some") & ~F.col("_other") & F.col("_timer"), "medium").otherwise("low")
    return rated.select(*by, rating.alias("rating"))


def rating_cross_check(claimed: DataFrame, computed: DataFrame, by: list[str]) -> DataFrame:
    other = computed.select(*by, F.col("rating").alias("computed"))
    return claimed.join(other, by).where("rating <> computed")


# --- history -----------------------------------------------------------------------------------------------

def resolved_history(rejections: DataFrame, accepted: DataFrame, record: list[str]) -> DataFrame:
    """Each rejected claim with what the accepted record says now; each missing store with the
    attempt that added it; bad citations as they were. `rejections`: record, attempt, kind, store. `accepted`: record, store, verdict."""
    now = accepted.select(*record, "store", F.col("verdict").alias("revised_to"), F.lit(True).alias("_in"))
    out = rejections.join(now, [*record, "store"], "left")
    added = F.when((F.col("kind") == "missing_store") & F.col("_in"), F.col("attempt") + 1)
    revised = F.when(F.col("kind") == "rejected_claim", F.col("revised_to"))
    return out.withColumn("added_on_attempt", added).withColumn("revised_to", revised).drop("_in")


def reverify(stored: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Differences between stored and recomputed answers, one row per differing value."""
    a = stored.select(*keys, F.lit(True).alias("_a"), *[F.col(v).cast("string").alias(f"was_{v}") for v in values])
    b = recomputed.select(*keys, F.lit(True).alias("_b"), *[F.col(v).cast("string").alias(f"now_{v}") for v in values])
    both = a.join(b, keys, "full_outer")
    gone = F.when(F.col("_b").isNull(), F.struct(F.lit("not recomputed").alias("what"), F.lit(None).cast("string").alias("was"), F.lit(None).cast("string").alias("now")))
    new = F.when(F.col("_a").isNull(), F.struct(F.lit("not stored").alias("what"), F.lit(None).cast("string").alias("was"), F.lit(None).cast("string").alias("now")))
    cells = [F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"was_{v}").eqNullSafe(F.col(f"now_{v}")),
                    F.struct(F.lit(v).alias("what"), F.col(f"was_{v}").alias("was"), F.col(f"now_{v}").alias("now"))) for v in values]
    return both.select(*keys, F.explode(F.array_compact(F.array(gone, new, *cells))).alias("d")).select(*keys, "d.*")


# --- record integrity -----------------------------------------------------------------------------------

#: Words of a legal conclusion, which a record never states.
LEGAL = (r"(?i)complian|unlawful|lawful|legal basis|legitimate interest|consent of the data subject"
         r"|Article \d+ (?:is|has been) (?:met|satisfied)")
NEEDS_EVIDENCE = [*REACHING, "pseudonymised", "governed_by_retention"]
TIMED = ["erased_after_timer", "governed_by_retention"]


def _block_tests(verdict: Column, n_evidence: Column, timer: Column, kind: Column) -> list[Column]:
    backup = kind == "backup"
    return [
        F.when(verdict.isin(NEEDS_EVIDENCE) & (n_evidence == 0), F.lit("evidence needed")),
        F.when(verdict.isin(TIMED) & timer.isNull(), F.lit("timer needed")),
        F.when(~verdict.isin(TIMED) & timer.isNotNull(), F.lit("timer not allowed")),
        F.when(backup & ~verdict.isin(BACKUP_ONLY), F.lit("backup verdict needed")),
        F.when(~backup & verdict.isin(BACKUP_ONLY), F.lit("backup verdict not allowed"))]


def check_invariants(records: DataFrame, key: str = "record_id") -> DataFrame:
    """Integrity violations of nested records: record key, pointer, problem."""
    def size(col):
        return F.size(F.coalesce(col, F.array()))

    def out(df: DataFrame, pointer: Column, tests: list[Column]) -> DataFrame:
        return df.select(key, pointer.alias("pointer"), F.explode(F.array_compact(F.array(*tests))).alias("problem"))

    stores = records.select(key, F.size(F.coalesce("entry_points", F.array())).alias("n_entries"), F.posexplode("stores").alias("i", "s"))
    at = F.concat(F.lit("/stores/"), F.col("i").cast("string"))
    verdict = F.col("s.erasure.verdict")
    stores = stores.withColumn("_key", t.norm_simple(F.coalesce("s.name", F.lit(""))))
    copies = stores.groupBy(key, "_key").agg(F.min("i").alias("_i0"))
    stores = stores.join(copies, [key, "_key"])
    parts = [
        out(stores, at, [F.when(size(F.col("s.fields")) == 0, F.lit("store without fields"))]),
        out(stores, F.concat(at, F.lit("/name")), [F.when(F.col("i") > F.col("_i0"), F.lit("duplicate store name"))]),
        out(stores, F.concat(at, F.lit("/erasure/verdict")), [F.when(
            (F.col("n_entries") == 0) & ~F.col("s.kind").isin("backup", "third_party") & ~verdict.eqNullSafe(F.lit("no_entry_point")),
            F.lit("no entry points, so the verdict is no_entry_point"))]),
        out(stores, F.concat(at, F.lit("/erasure")), _block_tests(verdict, size(F.col("s.erasure.evidence")), F.col("s.erasure.timer_days"), F.col("s.kind")))]

    fields = stores.select(key, "i", "s.kind", verdict.alias("store_verdict"), F.posexplode("s.fields").alias("j", "f"))
    fat = F.concat(F.lit("/stores/"), F.col("i").cast("string"), F.lit("/fields/"), F.col("j").cast("string"))
    fields = fields.withColumn("_key", t.norm_simple(F.coalesce("f.name", F.lit(""))))
    first = fields.groupBy(key, "i", "_key").agg(F.min("j").alias("_j0"))
    fields = fields.join(first, [key, "i", "_key"])
    own = fields.where("f.erasure IS NOT NULL")
    parts += [
        out(fields, F.concat(fat, F.lit("/name")), [F.when(F.col("j") > F.col("_j0"), F.lit("duplicate field name"))]),
        out(own, F.concat(fat, F.lit("/erasure")), _block_tests(F.col("f.erasure.verdict"), size(F.col("f.erasure.evidence")), F.col("f.erasure.timer_days"), F.col("kind"))),
        out(own, F.concat(fat, F.lit("/erasure/verdict")), [F.when(F.col("f.erasure.verdict").eqNullSafe(F.col("store_verdict")), F.lit("override repeats the store"))])]

    keep = records.select(key, F.posexplode("retention").alias("i", "r"))
    rat = F.concat(F.lit("/retention/"), F.col("i").cast("string"))
    keep = keep.withColumn("_key", t.norm_simple(F.coalesce("r.store", F.lit(""))))
    known = copies.select(key, "_key", F.lit(True).alias("_known"))
    keep = keep.join(known, [key, "_key"], "left")
    parts.append(out(keep, rat, [
        F.when(F.col("r.days").isNull() & (F.coalesce("r.criteria", F.lit("")) == ""), F.lit("days or criteria needed")),
        F.when(F.col("r.file").isNull() | F.col("r.line").isNull(), F.lit("file and line needed")),
        F.when(F.col("_known").isNull(), F.lit("names no store")), F.when(F.col("r.days") < 0, F.lit("negative days"))]))

    def cites(df: DataFrame, pointer: Column, cite: Column) -> DataFrame:
        c = df.select(key, pointer.alias("pointer"), cite.alias("c")).where("c IS NOT NULL")
        return c.select(key, "pointer", F.explode(F.array_compact(F.array(
            F.when(F.col("c.file").rlike(r"^/|(^|/)\.\.(/|$)"), F.lit("path is not relative")),
            F.when(F.col("c.line") < 1, F.lit("lines are 1-based"))))).alias("problem"))

    def pair(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.file").alias("file"), F.col(f"{c}.line").alias("line")))

    def listed(df: DataFrame, pointer: Column, array: str) -> DataFrame:
        e = df.select(key, pointer.alias("_p"), F.posexplode(array).alias("k", "e"))
        return cites(e, F.concat("_p", F.lit("/evidence/"), F.col("k").cast("string")), pair("e"))
    for name in ("data_subjects", "entry_points"):
        e = records.select(key, F.posexplode(name).alias("i", "e"))
        parts.append(cites(e, F.concat(F.lit(f"/{name}/"), F.col("i").cast("string")), pair("e")))
    parts += [cites(stores, F.concat(at, F.lit("/declared_at")), pair("s.declared_at")),
              cites(stores, F.concat(at, F.lit("/subject_link")), pair("s.subject_link")), cites(fields, fat, pair("f")),
              listed(stores, F.concat(at, F.lit("/erasure")), "s.erasure.evidence"), listed(own, F.concat(fat, F.lit("/erasure")), "f.erasure.evidence")]

    def words(df: DataFrame, pointer: Column, text: Column) -> DataFrame:
        return df.where(text.rlike(LEGAL)).select(key, pointer.alias("pointer"), F.lit("legal conclusion").alias("problem"))
    parts += [words(stores, F.concat(at, F.lit("/note")), F.col("s.note")), words(stores, F.concat(at, F.lit("/erasure/note")), F.col("s.erasure.note")),
              words(fields, F.concat(fat, F.lit("/note")), F.col("f.note")), words(own, F.concat(fat, F.lit("/erasure/note")), F.col("f.erasure.note")),
              words(keep, F.concat(rat, F.lit("/criteria")), F.col("r.criteria"))]
    return reduce(DataFrame.unionByName, parts)
