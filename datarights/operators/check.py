"""The whole check of submitted records against their repositories, many of both in one run.

Files go through scan, facts, resolution, inventory and edges once, whatever the number of records.
Records add starts (entry points that they declare) and columns to the search, so verdicts are made per
view: one for all records of a repository that add the same. What is found becomes feedback items of
seven kinds in one tagged table, and one aggregation folds them to ordered lists and the answer.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.functions import text as t
from datarights.operators import claims as cl
from datarights.operators.entrypoints import declared_starts, reconcile
from datarights.operators.resolve import resolve
from datarights.operators.scoring import BACKUP_ONLY
from datarights.operators.verdicts import Estate, build_estate, explain, verdicts
from datarights.session import stage
from datarights.sources import corpus as co
from datarights.sources.facts import extract_facts
from datarights.sources.rules import Rules, rules as default_rules

CITE = "struct<file: string, line: int, symbol: string>"
BLOCK = f"struct<verdict: string, evidence: array<{CITE}>, timer_days: int, note: string>"
FIELD = f"struct<name: string, file: string, line: int, note: string, erasure: {BLOCK}>"
STORE = f"struct<name: string, kind: string, declared_at: {CITE}, subject_link: {CITE}, note: string, erasure: {BLOCK}, fields: array<{FIELD}>>"
#: A submitted record; absent parts are null.
RECORD = (f"data_subjects array<{CITE}>, entry_points array<struct<name: string, kind: string, file: string, line: int>>, stores array<{STORE}>, "
          f"retention array<struct<store: string, days: int, criteria: string, file: string, line: int>>, "
          f"hints struct<observed_region_hints: array<{CITE}>, security_evidence: array<{CITE}>>")
PARTS = ["data_subjects", "entry_points", "stores", "retention", "hints"]
#: How a missing store is said to hold its fields, per kind; others write them.
VERBS = {"object_storage": "uploads", "search_index": "indexes", "queue": "enqueues", "third_party": "sends", "log": "logs", "backup": "backs up"}
#: Each list of the feedback: its fields, the first of which are its order.
LISTS = {
    "schema_errors": ["pointer", "problem"],
    "rejected_claims": ["store", "field", "claim", "reason", "detail", "path", "expected"],
    "missing_stores": ["store", "kind", "evidence"],
    "missing_entry_points": ["file", "line", "name", "kind"],
    "bad_citations": ["file", "line", "symbol", "problem", "expected"],
    "unverified": ["store", "claim", "reason", "detail"],
    "conservative_divergences": ["store", "claim", "found", "via", "file", "line"],
}
BLOCKING = ["schema_errors", "rejected_claims", "missing_stores", "bad_citations"]
_TYPES = {"line": "int", "path": f"array<{CITE}>"}


@dataclass
class Scanned:
    """Files of many repositories and what was found in them."""

    files: DataFrame
    spans: DataFrame
    estate: Estate


def scan(files: DataFrame, r: Rules | None = None) -> Scanned:
    """From files (repo_id, path, text), skipped ones included, to the inventory and the edges."""
    r = r or default_rules()
    sized = stage(files.select("repo_id", "path", "text").withColumn("n_bytes", F.octet_length("text").cast("bigint")))
    python = stage(co.classify_paths(sized, r).where("skip_reason IS NULL AND path LIKE '%.py'").select("repo_id", "path", "text"))
    facts = extract_facts(python)
    v = r.map("versioning")
    config = co.scan_config(sized, r).select("repo_id", "path", "text")
    versioning = co.versioning(config.unionByName(python), ["repo_id", "path"], r.words("versioning_literals"), v["qualifier"], int(v["window"]))
    return Scanned(sized, facts["span"], build_estate(resolve(facts, python), versioning, r))


def parse_records(rows: DataFrame, column: str = "record") -> DataFrame:
    """record_id, repo_id and the parts of a record, from JSON. What does not parse is a record without parts."""
    return rows.select("record_id", "repo_id", F.from_json(column, RECORD).alias("_r")).select("record_id", "repo_id", "_r.*")


# --- citations ------------------------------------------------------------------------------------------

def _cite(at: str, symbol: str | None, scanned: bool) -> str:
    named = f"{at}.{symbol}" if symbol else "CAST(NULL AS STRING)"
    return (f"named_struct('file', coalesce({at}.file, ''), 'line', coalesce({at}.line, 0), 'symbol', {named}, 'has_symbol', {named} IS NOT NULL, 'scanned_only', {str(scanned).lower()})")


def _each(array: str, symbol: str | None, scanned: bool, keep: str = "true") -> str:
    return f"transform(filter(coalesce({array}, array()), c -> {keep}), c -> {_cite('c', symbol, scanned)})"


def record_citations(records: DataFrame) -> DataFrame:
    """record_id, repo_id, file, line, symbol, has_symbol, scanned_only: every place that a record cites, once."""
    block = "concat({0}, {1})".format(_each("filter(array({at}.declared_at), x -> x IS NOT NULL)", "symbol", True),
                                      _each("filter(array({at}.subject_link), x -> x IS NOT NULL)", None, True)).replace("{at}", "s")
    own = f"flatten(transform(coalesce(s.fields, array()), f -> concat(array({_cite('f', 'name', True)}), {_each('f.erasure.evidence', 'symbol', True)})))"
    stores = f"flatten(transform(coalesce(stores, array()), s -> concat({block}, {own}, {_each('s.erasure.evidence', 'symbol', True)})))"
    parts = [stores, _each("entry_points", "name", True), _each("retention", None, False, "c.file IS NOT NULL AND c.line IS NOT NULL"), _each("data_subjects", None, False),
             _each("hints.observed_region_hints", None, False), _each("hints.security_evidence", None, False)]
    return records.select("record_id", "repo_id", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("c")).select("record_id", "repo_id", "c.*").distinct()


def bad_citations(scanned: Scanned, records: DataFrame) -> DataFrame:
    cites = stage(record_citations(records).withColumn("cite_id", F.monotonically_increasing_id()))
    cited = cites.select("repo_id", F.col("file").alias("path")).distinct()
    read = scanned.files.join(cited, ["repo_id", "path"], "left_semi")
    known = scanned.estate.code.modules.select("repo_id", "path", F.lit(True).alias("_module")).distinct()
    files = read.join(known, ["repo_id", "path"], "left").select("repo_id", F.col("path").alias("file"), F.size(co.line_array(F.col("text"))).alias("n_lines"),
                                                              F.coalesce("_module", F.lit(False)).alias("scanned"))
    table = co.lines(read, ["repo_id", "path"]).withColumnRenamed("path", "file")
    spans = scanned.spans.select("repo_id", F.col("path").alias("file"), F.col("line").alias("start"), F.col("end_line").alias("end"))
    checked = cl.check_citations(cites, files, table, spans, ["repo_id"]).where("problem IS NOT NULL")
    past = (F.col("problem") == "past_end") & F.coalesce(F.col("symbol") == "", F.lit(True))
    expected = (F.when(F.col("problem").isin("no_file", "not_scanned"), "cite_scanned").when(F.col("problem") == "no_symbol", "cite_name")
                .when(past, "cite_line").otherwise("cite_symbol"))
    return checked.select("record_id", "repo_id", "file", "line", F.coalesce("symbol", F.lit("")).alias("symbol"), "problem", expected.alias("expected")).distinct()


# --- views: verdicts per repository and what its records add ------------------------------------------------

def _views(records: DataFrame, starts: DataFrame, claimed: DataFrame) -> DataFrame:
    """record_id, repo_id, view: records of a repository that add equal starts and columns share a view."""
    a = starts.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("name", "kind", "file", "line", "symbol", "flags"))).alias("_a"))
    b = claimed.groupBy("record_id").agg(F.sort_array(F.collect_set(F.struct("store_id", "column"))).alias("_b"))
    signed = records.select("record_id", "repo_id").join(a, "record_id", "left").join(b, "record_id", "left")
    signed = signed.select("record_id", "repo_id", F.sha2(F.to_json(F.struct("_a", "_b")), 256).alias("_sig"))
    first = signed.groupBy("repo_id", "_sig").agg(F.min("record_id").alias("_first"))
    return stage(signed.join(first, ["repo_id", "_sig"]).select("record_id", "repo_id", F.concat_ws("#", "repo_id", "_first").alias("view")))


def _viewed(thing, views: DataFrame):
    """A table, or all tables of an estate, once for each view of its repository; repo_id is then the view."""
    if isinstance(thing, DataFrame):
        return thing.join(views, "repo_id").drop("repo_id").withColumnRenamed("view", "repo_id") if "repo_id" in thing.columns else thing
    if isinstance(thing, dict):
        return {k: _viewed(v, views) for k, v in thing.items()}
    if dataclasses.is_dataclass(thing):
        return dataclasses.replace(thing, **{f.name: _viewed(getattr(thing, f.name), views) for f in dataclasses.fields(thing)})
    return thing


# --- feedback ---------------------------------------------------------------------------------------------

def _tagged(df: DataFrame, into: str, **cells) -> DataFrame:
    """Rows of one list in the columns that all lists share."""
    fields = sorted({c for names in LISTS.values() for c in names})
    made = [cells[c].cast(_TYPES.get(c, "string")).alias(c) if c in cells else F.lit(None).cast(_TYPES.get(c, "string")).alias(c) for c in fields]
    return df.select("record_id", F.lit(into).alias("list"), *made)


def fold_feedback(records: DataFrame, items: DataFrame) -> DataFrame:
    """record_id, repo_id, accepted and the seven ordered lists; a record without items is accepted."""
    gathered = [F.sort_array(F.collect_list(F.when(F.col("list") == name, F.struct(*fields)))).alias(name) for name, fields in LISTS.items()]
    folded = items.groupBy("record_id").agg(*gathered)
    out = records.select("record_id", "repo_id").distinct().join(folded, "record_id", "left")
    clean = reduce(lambda a, b: a & b, [F.coalesce(F.size(c) == 0, F.lit(True)) for c in BLOCKING])
    return out.select("record_id", "repo_id", clean.alias("accepted"), *[F.coalesce(c, F.array()).alias(c) for c in LISTS])


def _claims(records: DataFrame) -> DataFrame:
    s = records.select("record_id", "repo_id", F.posexplode("stores").alias("claim_pos", "s"))
    cited = F.transform(F.coalesce("s.erasure.evidence", F.array()), lambda c: F.concat_ws(":", c["file"], c["line"].cast("string")))
    return s.select("record_id", "repo_id", "claim_pos", F.coalesce("s.name", F.lit("")).alias("name"), F.coalesce("s.kind", F.lit("")).alias("kind"),
                    F.coalesce("s.erasure.verdict", F.lit("")).alias("claimed"), F.col("s.declared_at.file").alias("file"), F.col("s.declared_at.line").alias("line"),
                    cited.alias("cited"), F.col("s.fields").alias("fields"))


def _evidence(estate: Estate, found: dict[str, DataFrame]) -> DataFrame:
    """repo_id, store_id, found, found_kind, rule, path, allowed and where the found way ends."""
    keys = ["repo_id", "store_id"]
    stores = found["stores"].select(*keys, "kind", "verdict", "rule", "entry", "evidence_file", "evidence_line")
    steps = found["steps"].withColumn("store_id", F.regexp_replace("target", "^store:", ""))
    steps = steps.join(stores.select(*keys, "entry"), [*keys, "entry"], "left_semi")
    short = F.substring_index(F.substring_index("dst", ":", -1), ".", -1)
    walk = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", "file", "line", short.alias("symbol"), "rule"))).alias("_walk"))
    at = lambda f, l: F.concat_ws(":", f, F.col(l).cast("string")).alias("at")
    touched = estate.relations.select("repo_id", F.explode(F.array("child", "parent")).alias("store_id"), at("file", "line")).unionByName(
        estate.primitives.select(*keys, at("file", "line"))).unionByName(stores.where("evidence_file IS NOT NULL").select(*keys, at("evidence_file", "evidence_line"))).unionByName(
        steps.select(*keys, at("file", "line")))
    allowed = touched.groupBy(*keys).agg(F.collect_set("at").alias("allowed"))
    token = estate.relations.where("token <> ''").groupBy("repo_id", F.col("file").alias("_ef"), F.col("line").alias("_el")).agg(F.min("token").alias("_token"))
    out = stores.join(walk, keys, "left").join(allowed, keys, "left").withColumn("_end", F.element_at("_walk", -1))
    out = out.withColumns({"_ef": F.coalesce("_end.file", "evidence_file"), "_el": F.coalesce("_end.line", "evidence_line")}).join(token, ["repo_id", "_ef", "_el"], "left")
    via = F.when(F.col("_end").isNotNull(), F.coalesce(F.concat(F.lit("on_delete="), "_token"), "_end.rule")).otherwise(F.col("rule"))
    path = F.transform(F.coalesce("_walk", F.array()), lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["symbol"].alias("symbol")))
    return out.select(*keys, F.col("verdict").alias("found"), F.col("kind").alias("found_kind"), "rule", path.alias("path"),
                      F.when(F.col("_walk").isNotNull(), F.col("allowed")).otherwise(F.array()).alias("allowed"), via.alias("via"), F.col("_ef").alias("end_file"), F.col("_el").alias("end_line"))


def _compared(claims: DataFrame, evidence: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every claim, of a store and of a field with a verdict of its own, with its rule and outcome.

    A field is compared with its own found verdict where there is one, else with its store's; fields of
    a store that nothing corroborates, or that has a verdict of another kind, are not compared."""
    own = overrides.groupBy("repo_id", "store_id", t.norm("field").alias("fkey")).agg(F.min_by("verdict", "field").alias("found"))
    whole = evidence.withColumn("fkey", F.lit(""))
    fields = own.join(evidence.select("repo_id", "store_id", "found_kind", F.array().cast("array<string>").alias("allowed")), ["repo_id", "store_id"])
    seen = whole.select("repo_id", "store_id", "fkey", "found", "found_kind", "allowed").unionByName(fields)
    stores = claims.withColumns({"field": F.lit(None).cast("string"), "fkey": F.lit("")})
    wrong = (F.col("kind") == "backup") != F.col("claimed").isin(BACKUP_ONLY)
    said = claims.where(F.col("store_id").isNotNull() & ~wrong).select(
        "record_id", "repo_id", "claim_pos", "name", "store_id", F.lit(None).cast("string").alias("kind"), F.explode("fields").alias("f"))
    said = said.where("f.erasure IS NOT NULL").select("record_id", "repo_id", "claim_pos", "name", "store_id", "kind", F.coalesce("f.name", F.lit("")).alias("field"),
                                                    F.coalesce("f.erasure.verdict", F.lit("")).alias("claimed"), F.array().cast("array<string>").alias("cited"))
    said = said.withColumn("fkey", t.norm("field")).join(own.select("repo_id", "store_id", "fkey", F.lit(True).alias("_own")), ["repo_id", "store_id", "fkey"], "left")
    said = said.withColumn("fkey", F.when(F.col("_own"), F.col("fkey")).otherwise("")).drop("_own")
    asked = stores.select(*said.columns).unionByName(said)
    return cl.compare_claims(asked, seen, ["repo_id", "store_id", "fkey"])


def check_records(scanned: Scanned, records: DataFrame, r: Rules | None = None, integrity: bool = True) -> DataFrame:
    """Feedback for every record: accepted, and seven lists, each in its order.

    `records`: record_id (unique), repo_id and the columns of `RECORD`. A record with integrity errors gets
    these alone, unless `integrity` is not asked for. Otherwise claims that the evidence does not carry, detected stores that are missing and
    citations that do not hold reject it; undeclared entry points, what cannot be decided, and claims more
    careful than the evidence are told and do not. A repository without files has no stores, so every
    reaching claim about it is uncorroborated and every citation bad.
    """
    r = r or default_rules()
    records, estate = stage(records.select("record_id", "repo_id", *PARTS)), scanned.estate
    none = records.select("record_id", F.lit("").alias("pointer"), F.lit("").alias("problem")).where("false")
    errors = stage(cl.check_invariants(records)) if integrity else none
    sound = records.join(errors.select("record_id").distinct(), "record_id", "left_anti")

    declared = sound.select("record_id", "repo_id", F.explode("entry_points").alias("e")).select(
        "record_id", "repo_id", F.coalesce("e.name", F.lit("")).alias("name"), F.coalesce("e.file", F.lit("")).alias("file"), F.coalesce("e.line", F.lit(0)).alias("line"), "e.kind")
    reconciled = stage(reconcile(declared.drop("kind"), estate.entries, estate.code.symbols, r, sound))
    kinds = declared.groupBy("record_id", "name", "file").agg(F.max("kind").alias("_kind"))
    starts = declared_starts(reconciled, estate.entries).join(kinds, ["record_id", "name", "file"], "left").withColumn("kind", F.coalesce("_kind", "kind")).drop("_kind")

    claims = stage(_claims(sound))
    of_record = estate.stores.join(sound.select("record_id", "repo_id"), "repo_id")
    pairs = stage(cl.match_claims(claims, of_record, ["record_id", "repo_id"]))
    claims = claims.join(pairs.select("record_id", "claim_pos", "store_id"), ["record_id", "claim_pos"], "left")
    claimed = claims.where("store_id IS NOT NULL").select("record_id", "store_id", F.explode("fields").alias("f")).select("record_id", "store_id", F.col("f.name").alias("column")).where("column IS NOT NULL")

    views = _views(sound, starts, claimed)
    to_view = views.select("record_id", "view")
    by_view = lambda df: df.join(to_view, "record_id").drop("repo_id").withColumnRenamed("view", "repo_id")
    one = _viewed(estate, views.select("repo_id", "view").distinct())
    extra = stage(by_view(starts).drop("record_id").distinct())
    found = verdicts(one, r, extra_starts=None if extra.isEmpty() else extra, claimed=by_view(claimed.withColumn("repo_id", F.lit(""))).select("repo_id", "store_id", "column").distinct())
    evidence = stage(_evidence(one, found))
    details = explain(one, found, r).select("repo_id", "store_id", "detail")
    asked = by_view(claims)
    told = _told(asked, evidence, found["fields"], details)

    claim = F.concat(F.lit("erasure.verdict="), "claimed")
    expected = (F.when(F.col("rule") == "wrong_kind", F.when(F.col("kind") == "backup", "backup_verdict").otherwise("kind_verdict"))
                .when(F.col("rule").isin("uncorroborated", "unresolved"), "unverified").when(F.col("rule") == "off_path", "cite_on_path").otherwise(F.concat(F.lit("verdict:"), "found")))
    shown = F.when(F.col("rule").isin("wrong_kind", "uncorroborated"), F.array()).otherwise(F.coalesce("path", F.array()))
    why = F.when(F.col("rule") == "false_safe", F.col("detail")).when(F.col("rule").isin("unresolved", "timer_first"), F.col("found_rule"))
    other_kind = told.where("field IS NULL AND rule <> 'wrong_kind' AND found_kind IS NOT NULL AND kind <> '' AND kind <> found_kind")
    phrase = cl.evidence_phrase(estate.fields, ["repo_id", "store_id"])
    at = estate.fields.groupBy("repo_id", "store_id").agg(F.min(F.struct("file", "line")).alias("_at"))
    verb = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in VERBS.items()], F.lit("writes"))
    missing = cl.missing_stores(of_record, pairs, ["record_id", "store_id"]).join(phrase, ["repo_id", "store_id"], "left").join(at, ["repo_id", "store_id"], "left")
    where = F.coalesce(F.concat_ws(":", F.coalesce("file", "_at.file"), F.coalesce("line", "_at.line").cast("string")), "store_id")
    undeclared = reconciled.where("status = 'missing'").join(estate.entries.groupBy("repo_id", "name", "file", "line").agg(F.min("kind").alias("kind")), ["repo_id", "name", "file", "line"], "left")
    col = F.col
    items = [
        _tagged(errors, "schema_errors", pointer=col("pointer"), problem=col("problem")),
        _tagged(told.where("outcome = 'rejected'"), "rejected_claims", store=col("name"), field=col("field"), claim=claim, reason=col("rule"), detail=why, path=shown, expected=expected),
        _tagged(missing, "missing_stores", store=col("store_id"), kind=col("kind"), evidence=F.concat_ws(" ", where, verb, F.coalesce(F.nullif("phrase", F.lit("")), F.lit("personal data")))),
        _tagged(undeclared, "missing_entry_points", file=col("file"), line=col("line"), name=col("name"), kind=F.coalesce("kind", F.lit("unknown"))),
        _tagged(bad_citations(scanned, sound), "bad_citations", file=col("file"), line=col("line"), symbol=col("symbol"), problem=col("problem"), expected=col("expected")),
        _tagged(told.where("outcome = 'informational'"), "unverified", store=col("name"), claim=claim, reason=col("rule"), detail=F.when(col("rule") == "cannot_tell", col("found_rule"))),
        _tagged(other_kind, "unverified", store=col("name"), claim=F.concat(F.lit("kind="), "kind"), reason=F.lit("other_kind"), detail=col("found_kind")),
        _tagged(told.where("outcome = 'divergence'"), "conservative_divergences", store=col("name"), claim=claim, found=col("found"), via=col("via"), file=col("end_file"), line=col("end_line"))]
    return fold_feedback(records, stage(reduce(DataFrame.unionByName, items)))


def _told(claims: DataFrame, evidence: DataFrame, overrides: DataFrame, details: DataFrame) -> DataFrame:
    """Compared claims beside the evidence on their store."""
    compared = _compared(claims, evidence, overrides).drop("found_kind", "allowed")
    more = evidence.select("repo_id", "store_id", "found_kind", F.col("rule").alias("found_rule"), "path", "via", "end_file", "end_line")
    return stage(compared.join(more, ["repo_id", "store_id"], "left").join(details, ["repo_id", "store_id"], "left"))


def check_claims(files: DataFrame, records: DataFrame, r: Rules | None = None, integrity: bool = True) -> DataFrame:
    """From source files (repo_id, path, text) and records to feedback. Repositories without a record are not scanned."""
    asked = files.join(records.select("repo_id").distinct(), "repo_id", "left_semi")
    return check_records(scan(asked, r), records, r, integrity)
