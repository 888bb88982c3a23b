"""Verdicts: does closing an account reach each store, and if not, why not.

Every input is a joined table; the order of the rules is one CASE per table of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.functions import text as t
from datarights.operators.edges import (build_edges, enforcing_engines, loaded_modules, primitives, receivers, row_stores, synthetic_edges)
from datarights.operators.entrypoints import entry_points, schedules_of, task_table
from datarights.operators.graph import all_modes, first_paths, paths, reach
from datarights.operators.inventory import detect_stores, null, settings_facts, union
from datarights.operators.resolve import Code, hub_members, propagate_bindings, references, tail_of, unmodelled
from datarights.operators.scoring import REACHING
from datarights.session import rule_table, stage, stage_all
from datarights.sources.rules import Rules, rules as default_rules

JOBS = ["cli", "task"]


@dataclass
class Estate:
    """All tables of a scanned code estate, from facts to verdicts."""

    code: Code
    stores: DataFrame
    fields: DataFrame
    relations: DataFrame
    settings: dict
    entries: DataFrame
    tasks: DataFrame
    bindings: DataFrame
    receivers: DataFrame
    primitives: DataFrame
    edges: DataFrame
    hubs: DataFrame
    flags: DataFrame
    versioning: DataFrame


def build_estate(code: Code, versioning: DataFrame, r: Rules | None = None, store_detectors: list | None = None, entry_detectors: list | None = None) -> Estate:
    """Inventory, entry points and the edge table; each stage is written once."""
    r = r or default_rules()
    stores, fields, relations = detect_stores(code, r, store_detectors)
    settings = settings_facts(code, r)
    settings = dict(zip(settings, stage_all(list(settings.values()))))
    entries = entry_points(code, stores, settings["schedules"], r, entry_detectors)
    tasks, heard, enforcing = stage_all([task_table(code, r), receivers(code, loaded_modules(code, settings["apps"]), r), enforcing_engines(code, settings["engines"], r)])
    sent = heard.where("sender IS NOT NULL").groupBy("repo_id", "symbol").agg(F.min("sender").alias("model")).withColumn("var", F.lit("instance"))
    bindings = code.bindings.unionByName(sent.join(code.bindings.select("repo_id", "symbol", "var"), ["repo_id", "symbol", "var"], "left_anti"))
    bindings = stage(bindings)
    prims = stage(primitives(code, stores, relations, bindings, r))
    synthetic, flags = synthetic_edges(code, stores, relations, entries, prims, settings, heard, enforcing, tasks, r)
    return Estate(code, stores, fields, relations, settings, entries, tasks, bindings, heard, prims, build_edges(code, synthetic),
                  hub_members(code.symbols), stage(flags), stage(versioning))


# --- writes and anonymisation ------------------------------------------------------------------------------

def classify_write(assigns: DataFrame, constants: DataFrame, r: Rules) -> DataFrame:
    """Adds `write`: marker, pseudonymous, constant or opaque, tried in that order.

    `assigns`: repo_id, column, value_kind, value, keys. `constants`: repo_id, name of every
    module-level literal.
    """
    value = F.coalesce("value", F.lit(""))
    last = tail_of(F.replace(value, F.lit("()"), F.lit("")))
    fixed = F.col("value_kind").isin("literal", "none")
    stamps = sorted({w.split(".")[-1] for w in r.words("timestamp_calls")})
    marker = t.in_words(F.col("column"), r.words("marker_fields")) & (fixed | tail_of(value).isin(stamps))
    calls = r.words("pseudonym_calls")
    joined = F.concat(value, F.lit(" "), F.array_join("keys", " "))
    pseudo = t.contains_any(value, calls) | last.isin(sorted({c.split(".")[-1] for c in calls})) | t.contains_any(joined, r.words("pseudonym_marks"))
    known = constants.select("repo_id", F.col("name").alias("_short"), F.lit(True).alias("_const")).distinct()
    out = assigns.withColumn("_short", F.when(F.col("value_kind") == "name", tail_of(value))).join(known, ["repo_id", "_short"], "left")
    kind = F.when(marker, "marker").when(pseudo, "pseudonymous").when(fixed | F.coalesce("_const", F.lit(False)), "constant").otherwise("opaque")
    return out.withColumn("write", kind).drop("_short", "_const")


def writes_on(estate: Estate, on_path: DataFrame, r: Rules) -> DataFrame:
    """First classified write per (model, column) in the symbols of `on_path` (repo_id, symbol)."""
    code = estate.code
    bound = propagate_bindings(estate.bindings, code.calls, code.symbols)
    a = code.assigns.where("scope IS NOT NULL AND contains(target, '.')").select(
        "repo_id", F.col("scope").alias("symbol"), F.col("path").alias("file"), "line", "seq", "value_kind", "value", "keys",
        F.regexp_extract("target", r"^(.*)\.[^.]*$", 1).alias("var"), tail_of("target").alias("column"))
    a = a.join(on_path.select("repo_id", "symbol").distinct(), ["repo_id", "symbol"], "left_semi")
    a = a.join(bound, ["repo_id", "symbol", "var"], "left")
    own = code.symbols.select("repo_id", F.col("name").alias("symbol"), "owner")
    a = a.join(own, ["repo_id", "symbol"], "left").withColumn("model", F.coalesce("model", F.when(F.col("var").isin("self", "instance"), F.col("owner")))).where("model IS NOT NULL")
    constants = code.assigns.where("scope IS NULL AND value_kind IN ('literal', 'none')").select("repo_id", F.col("target").alias("name"))
    a = classify_write(a, constants, r)
    return a.groupBy("repo_id", "model", "column").agg(F.min_by(F.struct("write", "file", "line", "symbol"), F.struct("symbol", "seq")).alias("w")).select("repo_id", "model", "column", "w.*")


def columns_under_test(stores: DataFrame, fields: DataFrame, code: Code, claimed: DataFrame | None = None) -> DataFrame:
    """repo_id, store_id, column: detected columns and claimed ones, without the key columns."""
    seen = fields.select("repo_id", "store_id", F.col("field").alias("column"))
    if claimed is not None:
        seen = seen.unionByName(claimed.select("repo_id", "store_id", "column"))
    keys = code.fields.where("parent IS NULL").where(F.map_contains_key("kw", F.lit("primary_key"))).select("repo_id", F.col("owner").alias("model"), F.col("target").alias("column"))
    keys = keys.join(stores.select("repo_id", "store_id", "model"), ["repo_id", "model"]).select("repo_id", "store_id", "column")
    return seen.distinct().where(~F.col("column").isin("id", "pk")).join(keys, ["repo_id", "store_id", "column"], "left_anti")


def anonymisation(stores: DataFrame, columns: DataFrame, writes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per store: anonymised, pseudonymised or unclear from the writes on the path; and per field."""
    mine = stores.where("model IS NOT NULL").select("repo_id", "store_id", "model").join(writes.where("write <> 'marker'"), ["repo_id", "model"])
    any_ = mine.groupBy("repo_id", "store_id").agg(F.bool_or(F.col("write") == "pseudonymous").alias("_pseudo"), F.bool_or(F.col("write") == "opaque").alias("_opaque"),
                                                   F.min(F.struct("file", "line")).alias("_at"))
    cols = columns.join(mine.select("repo_id", "store_id", "column", "write"), ["repo_id", "store_id", "column"], "left")
    per = cols.groupBy("repo_id", "store_id").agg(F.bool_and(F.coalesce(F.col("write") == "constant", F.lit(False))).alias("_all"))
    roots = stores.where("subject_root").select("repo_id", F.col("store_id").alias("parent"))
    links = relations.where("field_name <> ''").join(roots, ["repo_id", "parent"], "left_semi").select("repo_id", F.col("child").alias("store_id"), F.col("field_name").alias("column"))
    kept = links.join(mine.select("repo_id", "store_id", "column"), ["repo_id", "store_id", "column"], "left_anti").select("repo_id", "store_id", F.lit(True).alias("_key")).distinct()
    out = any_.join(per, ["repo_id", "store_id"], "left").join(kept, ["repo_id", "store_id"], "left")
    verdict = (F.when(F.coalesce("_all", F.lit(False)) & F.col("_key").isNull(), "anonymised").when(F.col("_pseudo"), "pseudonymised").when(F.col("_opaque"), None)
               .when(F.col("_all").isNotNull(), "pseudonymised"))
    out = out.withColumn("anon", verdict).withColumn("anon_opaque", verdict.isNull() & F.col("_opaque"))
    word = F.when(F.col("write") == "constant", "anonymised").when(F.col("write") == "pseudonymous", "pseudonymised").when(F.col("write") == "opaque", "unverified").otherwise("not_erased")
    fields = cols.join(any_.select("repo_id", "store_id"), ["repo_id", "store_id"], "left_semi").select("repo_id", "store_id", "column", word.alias("field_verdict"))
    return out.select("repo_id", "store_id", "anon", "anon_opaque", F.col("_at.file").alias("anon_file"), F.col("_at.line").alias("anon_line")), fields


# --- timers ------------------------------------------------------------------------------------------------

def parse_days(code: Code, jobs: DataFrame, r: Rules) -> DataFrame:
    """repo_id, symbol, days: the retention period a job reads, in whole days.

    Day-bearing keywords of its calls in order (hours floored, at least 1), literal or a
    constant; else a retention constant of the job's own module. `jobs`: repo_id, symbol, module.
    """
    spark = code.imports.sparkSession
    units = rule_table(spark, [(str(a), int(b), int(c)) for a, b, c in r.rows("day_kwargs")], "k string, per int, ord int")
    c = code.calls.select("repo_id", F.col("caller").alias("symbol"), "module", "line", "dotted", F.explode("kw").alias("k", "a")).join(jobs.select("repo_id", "symbol"), ["repo_id", "symbol"], "left_semi")
    c = c.join(units, ["k"])
    lits = code.assigns.where("scope IS NULL AND value_kind = 'literal'").select("repo_id", "module", F.col("target").alias("short"), "seq", "value")
    own = lits.groupBy("repo_id", "module", "short").agg(F.min_by("value", "seq").alias("_own"))
    anywhere = lits.groupBy("repo_id", "short").agg(F.min_by("value", F.struct("module", "seq")).alias("_any"))
    c = c.withColumn("short", F.when(F.col("a.kind").isin("name", "attribute"), tail_of("a.value"))).join(own, ["repo_id", "module", "short"], "left").join(anywhere, ["repo_id", "short"], "left")
    text = F.when(F.col("a.kind") == "literal", F.col("a.value")).otherwise(F.coalesce("_own", "_any"))
    n = F.trim(text).try_cast("int")
    direct = c.withColumn("days", F.greatest(F.lit(1), F.floor(n / F.col("per")).cast("int"))).where(n.isNotNull())
    direct = direct.groupBy("repo_id", "symbol").agg(F.min_by("days", F.struct("line", "dotted", "ord")).alias("_direct"))
    named = jobs.select("repo_id", "symbol", "module").join(own.where(F.col("short").isin(r.words("retention_constants"))), ["repo_id", "module"])
    named = named.withColumn("_n", F.trim("_own").try_cast("int")).where("_n IS NOT NULL").groupBy("repo_id", "symbol").agg(F.min_by("_n", "short").alias("_named"))
    return jobs.select("repo_id", "symbol").distinct().join(direct, ["repo_id", "symbol"], "left").join(named, ["repo_id", "symbol"], "left").select(
        "repo_id", "symbol", F.coalesce("_direct", "_named").alias("days")).where("days IS NOT NULL")


def backup_retention(estate: Estate, r: Rules) -> DataFrame:
    """repo_id, store_id, days, cited, file, line for backups with a constant or a schedule beside them."""
    code = estate.code
    mods = code.modules.select("repo_id", F.col("path").alias("file"), "module")
    b = estate.stores.where("kind = 'backup'").select("repo_id", "store_id", "file").join(mods, ["repo_id", "file"], "left")
    consts = code.assigns.where("scope IS NULL AND value_kind = 'literal'").where(F.col("target").isin(r.words("retention_constants"))).select(
        "repo_id", "module", F.col("target").alias("const"), F.trim("value").try_cast("int").alias("days"), "line").where("days IS NOT NULL")
    d = b.join(consts, ["repo_id", "module"]).groupBy("repo_id", "store_id").agg(F.min_by(F.struct("days", "file", "line"), F.struct("const", "line")).alias("d"))
    said = estate.settings["schedules"].select("repo_id", F.struct(F.col("file").alias("sfile"), F.col("line").alias("sline")).alias("_s"), "file", "names")
    beside = b.join(said.select("repo_id", "file", "_s"), ["repo_id", "file"]).select("repo_id", "store_id", "_s")
    named = b.join(said.select("repo_id", F.explode("names").alias("module"), "_s"), ["repo_id", "module"]).select("repo_id", "store_id", "_s")
    s = beside.unionByName(named).groupBy("repo_id", "store_id").agg(F.min("_s").alias("s"))
    out = b.select("repo_id", "store_id").join(d, ["repo_id", "store_id"], "left").join(s, ["repo_id", "store_id"], "left")
    return out.select("repo_id", "store_id", F.col("d.days").alias("retention_days"), (F.col("d").isNotNull() | F.col("s").isNotNull()).alias("cited"),
                      F.coalesce("d.file", "s.sfile").alias("cite_file"), F.coalesce("d.line", "s.sline").alias("cite_line"))


# --- the table ---------------------------------------------------------------------------------------------

def _best_hit(hits: DataFrame, name: str) -> DataFrame:
    """The first entry point, in name order, of those that reach a store."""
    picked = F.min_by(F.struct("entry", "entry_symbol", "entry_flags"), F.struct("entry_name", "entry_file", "entry_line", "entry_kind")).alias(name)
    return hits.groupBy("repo_id", "node").agg(picked)


def verdicts(estate: Estate, r: Rules | None = None, extra_starts: DataFrame | None = None, claimed: DataFrame | None = None) -> dict[str, DataFrame]:
    """store verdicts, field verdicts and the cited paths behind them.

    `extra_starts`: declared entry points (repo_id, name, kind, file, line, symbol, flags).
    `claimed`: repo_id, store_id, column of a record's own columns.
    """
    r = r or default_rules()
    code, stores, relations = estate.code, estate.stores, estate.relations
    cols = ["repo_id", "name", "kind", "file", "line", "symbol", "flags"]
    entries = estate.entries.select(*cols)
    edges = estate.edges
    if extra_starts is not None:
        entries = entries.unionByName(extra_starts.select(*cols))
        more = extra_starts.where("symbol IS NOT NULL").select(
            "repo_id", F.concat(F.lit("entry:"), "name").alias("src"), F.col("symbol").alias("dst"), F.lit("entry").alias("kind"), "file", "line", F.lit("SE0").alias("rule"),
            F.lit(False).alias("ambiguous"), all_modes().alias("modes"),
            null().alias("sets_mode"), F.lit(False).alias("hub"), F.lit("").alias("note"))
        edges = edges.unionByName(more.select(*edges.columns))
    entries = entries.withColumn("entry", F.concat(F.lit("entry:"), "name"))
    starts = entries.select("repo_id", "entry", F.col("entry").alias("node"), F.lit("none").alias("mode")).distinct()
    sure_states = stage(reach(edges, starts, resolved_only=True))
    sure = stage(first_paths(sure_states))
    loose = stage(first_paths(reach(edges, starts, hubs=estate.hubs)))
    who = entries.select("repo_id", "entry", F.col("name").alias("entry_name"), F.col("file").alias("entry_file"), F.col("line").alias("entry_line"), F.col("kind").alias("entry_kind"),
                         F.col("symbol").alias("entry_symbol"), F.col("flags").alias("entry_flags"))
    live = ~F.array_contains("entry_flags", "unscheduled")
    node = stores.select("repo_id", "node", "store_id")
    sure_hits = stage(sure.join(node, ["repo_id", "node"]).join(who, ["repo_id", "entry"]).where(live))
    loose_hits = loose.join(node, ["repo_id", "node"]).join(who, ["repo_id", "entry"]).where(live)
    symbols = code.symbols.select("repo_id", F.col("name").alias("symbol"))
    walked = stage(sure.join(who.where(live), ["repo_id", "entry"]).select("repo_id", F.col("node").alias("symbol"), "entry", "entry_kind", "entry_flags").join(symbols, ["repo_id", "symbol"], "left_semi"))

    # writes on the path; markers only where the path is not a job's own
    writes = stage(writes_on(estate, walked, r))
    columns = stage(columns_under_test(stores, estate.fields, code, claimed))
    anon, field_verdicts = anonymisation(stores, columns, writes, relations)
    anon, field_verdicts = stage_all([anon, field_verdicts])
    user_writes = writes_on(estate, walked.where(~F.col("entry_kind").isin(JOBS)), r).where("write = 'marker'")
    marks = stage(stores.where("model IS NOT NULL").select("repo_id", "store_id", "model").join(user_writes, ["repo_id", "model"]).groupBy("repo_id", "store_id").agg(
        F.min(F.struct("file", "line", "column")).alias("mark")))

    # jobs and timers
    jobs = who.where(live & F.col("entry_kind").isin(JOBS))
    job_symbols = jobs.where("entry_symbol IS NOT NULL").select("repo_id", F.col("entry_symbol").alias("symbol")).distinct().join(
        code.symbols.select("repo_id", F.col("name").alias("symbol"), "short", "module", "file", "decorators"), ["repo_id", "symbol"])
    when = stage(schedules_of(code, job_symbols.where("size(decorators) > 0"), estate.tasks, estate.settings["schedules"], r))
    days = stage(parse_days(code, job_symbols, r))
    scheduled = when.select("repo_id", F.col("symbol").alias("entry_symbol"), F.struct(F.col("file").alias("sfile"), F.col("line").alias("sline")).alias("sched"))
    job_hits = sure_hits.where(F.col("entry_kind").isin(JOBS)).join(scheduled, ["repo_id", "entry_symbol"]).join(marks, ["repo_id", "store_id"])
    timer = job_hits.groupBy("repo_id", "store_id").agg(F.min_by(F.struct("entry", "entry_symbol", "sched"), F.struct("entry_name", "entry_file", "entry_line", "entry_kind")).alias("timer"))
    timer = timer.withColumn("symbol", F.col("timer.entry_symbol")).join(days, ["repo_id", "symbol"], "left").drop("symbol")
    timer = stage(timer.withColumnRenamed("days", "timer_days"))

    # Entry points that do not count for a store: its timer's own job, and unscheduled jobs
    # beside a marker. Flags on stores and on entries, not a list of their pairs.
    idle = jobs.join(scheduled.select("repo_id", "entry_symbol"), ["repo_id", "entry_symbol"], "left_anti").select("repo_id", "entry", F.lit(True).alias("_idle")).distinct()
    own_job = timer.select("repo_id", "store_id", F.col("timer.entry").alias("_own"))
    marked = marks.select("repo_id", "store_id", F.lit(True).alias("_marked"))

    def counting(hits: DataFrame) -> DataFrame:
        h = hits.join(idle, ["repo_id", "entry"], "left").join(own_job, ["repo_id", "store_id"], "left").join(marked, ["repo_id", "store_id"], "left")
        return h.where(~F.coalesce(F.col("_idle") & F.col("_marked"), F.lit(False)) & ~F.coalesce(F.col("entry") == F.col("_own"), F.lit(False)))
    hit = stage(_best_hit(counting(sure_hits), "hit"))
    any_hit = _best_hit(sure_hits, "any_hit")
    maybe = stage(_best_hit(counting(loose_hits), "maybe"))
    # steps of the winning paths
    wanted = hit.select("repo_id", F.col("hit.entry").alias("entry"), "node").unionByName(any_hit.select("repo_id", F.col("any_hit.entry").alias("entry"), "node")).distinct()
    steps = stage(paths(sure_states, wanted))
    last = steps.groupBy("repo_id", "entry", "target").agg(F.max_by(F.struct("file", "line", "note"), "step").alias("last"), F.collect_set("dst").alias("through"))
    last = stage(last.withColumnRenamed("target", "node"))
    of_hit = hit.select("repo_id", "node", F.col("hit.entry").alias("entry")).join(last, ["repo_id", "entry", "node"], "left")

    # downgrades on the path
    odd = unmodelled(code.symbols, r).select("repo_id", F.col("symbol").alias("dst"))
    odd_on = steps.join(odd, ["repo_id", "dst"], "left_semi").join(hit.select("repo_id", F.col("hit.entry").alias("entry"), F.col("node").alias("target")), ["repo_id", "entry", "target"], "left_semi")
    odd_on = stage(odd_on.select("repo_id", F.col("target").alias("node"), "dst").distinct())
    only_odd = node.select("repo_id", "node").where("false")
    if not odd_on.isEmpty():
        # One search per store, from a root in front of all its repository's entry points.
        again = odd_on.select("repo_id", F.col("node").alias("entry")).distinct().select("repo_id", "entry", F.lit("entry:*").alias("node"), F.lit("none").alias("mode"))
        root = who.where(live).select("repo_id", "entry").distinct().select(
            "repo_id", F.lit("entry:*").alias("src"), F.col("entry").alias("dst"), F.lit("entry").alias("kind"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit("SE0").alias("rule"),
            F.lit(False).alias("ambiguous"), all_modes().alias("modes"), null().alias("sets_mode"), F.lit(False).alias("hub"), F.lit("").alias("note"))
        blocked = odd_on.select("repo_id", F.col("node").alias("entry"), F.col("dst").alias("node"))
        round_ = reach(edges.unionByName(root.select(*edges.columns)), again, resolved_only=True, blocked=blocked)
        bypass = round_.where("entry = node").select("repo_id", "node").distinct()
        only_odd = stage(odd_on.select("repo_id", "node").distinct().join(bypass, ["repo_id", "node"], "left_anti"))
    versioned = estate.versioning.select("repo_id").distinct().withColumn("_versioned", F.lit(True))
    with_id = code.calls.where(F.map_contains_key("kw", F.lit("VersionId"))).select("repo_id", F.col("path").alias("_f"), F.col("line").alias("_l"), F.lit(True).alias("_vid")).distinct()

    # protecting children
    state = stage(protect_state(estate, any_hit.join(last.withColumn("any_entry", F.col("entry")).drop("entry"), ["repo_id", "node"], "left").where("any_hit.entry = any_entry")))
    bad_child = state.where("protect IN ('absent', 'disqualified')").select("repo_id", F.col("store_id").alias("child"))
    parents = relations.join(bad_child, ["repo_id", "child"], "left_semi").select("repo_id", F.col("parent").alias("store_id")).distinct().join(node, ["repo_id", "store_id"]).select("repo_id", F.col("node").alias("dst"))
    on_way = of_hit.select("repo_id", "node", F.explode_outer("through").alias("dst")).unionByName(node.select("repo_id", "node", F.col("node").alias("dst"))).join(parents, ["repo_id", "dst"], "left_semi")
    on_way = on_way.select("repo_id", "node", F.lit(True).alias("_blocked_parent")).distinct()

    # reasons the tool cannot tell
    reasons = stage(unverified_reasons(estate, edges, sure_hits, walked, any_hit))
    unparsed = code.extra["errors"].select("repo_id", "file", F.lit(True).alias("_unparsed")).distinct()
    declared = only_declared_symbols(walked)
    proof = writes.join(stores.select("repo_id", "store_id", "model"), ["repo_id", "model"]).select("repo_id", "store_id", "symbol").unionByName(
        timer.select("repo_id", "store_id", F.col("timer.entry_symbol").alias("symbol")))
    proof = proof.groupBy("repo_id", "store_id").agg(F.collect_set("symbol").alias("_syms"))
    proof = proof.select("repo_id", "store_id", F.explode("_syms").alias("symbol")).join(declared, ["repo_id", "symbol"]).groupBy("repo_id", "store_id").agg(
        F.bool_and("only_declared").alias("_capped_proof"))

    has_entries = entries.select("repo_id").distinct().withColumn("_entries", F.lit(True))
    forwards = forwarding(estate, steps, hit, r)
    s = stores.select("repo_id", "store_id", "kind", "node", "file", "line", "guard", "linked", "flags", "model")
    for part, on in ((has_entries, ["repo_id"]), (backup_retention(estate, r), ["repo_id", "store_id"]), (hit, ["repo_id", "node"]), (maybe, ["repo_id", "node"]),
                     (of_hit.drop("entry"), ["repo_id", "node"]), (anon, ["repo_id", "store_id"]), (timer, ["repo_id", "store_id"]), (marks, ["repo_id", "store_id"]),
                     (only_odd.withColumn("_odd", F.lit(True)), ["repo_id", "node"]), (versioned, ["repo_id"]), (reasons, ["repo_id", "store_id"]),
                     (unparsed, ["repo_id", "file"]), (state, ["repo_id", "store_id"]), (on_way, ["repo_id", "node"]), (proof, ["repo_id", "store_id"]), (forwards, ["repo_id", "store_id"])):
        s = s.join(part, on, "left")
    s = s.withColumn("_f", F.col("last.file")).withColumn("_l", F.col("last.line")).join(with_id, ["repo_id", "_f", "_l"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    hit_ = F.col("hit").isNotNull()
    row = lambda verdict, rule: F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
    table = (
        F.when((F.col("kind") == "backup") & yes("cited"), row("governed_by_retention", "row 1"))
        .when(F.col("kind") == "backup", row("no_schedule_evidenced", "row 1"))
        .when((F.col("kind") == "third_party") & yes("_forwards"), row("erased", "R24"))
        .when(F.col("kind") == "third_party", row("external_manual", "row 2"))
        .when(~yes("_entries"), row("no_entry_point", "row 3"))
        .when(hit_ & yes("_odd"), row("unverified", "R27"))
        .when(hit_ & (F.col("kind") == "object_storage") & yes("_versioned") & ~yes("_vid"), row("not_erased", "R13"))
        .when(hit_, row("erased", "row 4"))
        .when(F.col("anon") == "anonymised", row("anonymised", "row 5"))
        .when(F.col("timer").isNotNull() & F.col("timer_days").isNotNull(), row("erased_after_timer", "row 6"))
        .when(F.col("anon") == "pseudonymised", row("pseudonymised", "row 7"))
        .when(yes("_unparsed"), row("unverified", "R28"))
        .when(F.col("maybe").isNotNull(), row("unverified", "R26 ambiguous"))
        .when(F.col("reason").isNotNull(), F.struct(F.lit("unverified").alias("verdict"), F.col("reason").alias("rule")))
        .when(yes("anon_opaque"), row("unverified", "R26 opaque write"))
        .otherwise(row("not_erased", "row 9")))
    s = s.withColumn("_t", table)
    reaches = F.col("_t.verdict").isin(REACHING) & ~F.col("kind").isin("backup", "third_party")
    capped = reaches & (F.array_contains("hit.entry_flags", "declared_unregistered") | (~hit_ & yes("_capped_proof")))
    held = reaches & ((F.col("protect") == "disqualified") | yes("_blocked_parent"))
    capped, held = F.coalesce(capped, F.lit(False)), F.coalesce(held, F.lit(False))
    verdict = F.when(capped | held, "unverified").otherwise(F.col("_t.verdict"))
    rule = F.when(capped, "declared, not registered").when(held, "protected child").otherwise(F.col("_t.rule"))
    days_ = F.when(verdict == "erased_after_timer", F.col("timer_days")).when(verdict == "governed_by_retention", F.col("retention_days"))
    n_columns = estate.fields.groupBy("repo_id", "store_id").agg(F.count("*").alias("n_columns"))
    out = s.select("repo_id", "store_id", "kind", "guard", "linked", verdict.alias("verdict"), rule.alias("rule"), days_.alias("days"), F.col("hit.entry").alias("entry"),
                   F.coalesce("last.file", "anon_file", "cite_file", "mark.file").alias("evidence_file"), F.coalesce("last.line", "anon_line", "cite_line", "mark.line").alias("evidence_line"),
                   F.col("mark.column").alias("marker"), "protect")
    out = stage(out.join(n_columns, ["repo_id", "store_id"], "left").fillna(0, ["n_columns"]))
    over = field_verdicts.join(out.where("verdict IN ('anonymised', 'pseudonymised')").select("repo_id", "store_id", "verdict"), ["repo_id", "store_id"]).where("field_verdict <> verdict")
    return {"stores": out, "fields": over.select("repo_id", "store_id", F.col("column").alias("field"), F.col("field_verdict").alias("verdict")), "steps": steps, "walked": walked, "sure_hits": sure_hits}


def protect_state(estate: Estate, hits: DataFrame) -> DataFrame:
    """repo_id, store_id, protect: absent, disqualified or qualified, for children that block a parent.

    `hits`: repo_id, node, last (the last step of the path that reaches the child).
    """
    rel = estate.relations.withColumn("_tok", t.norm("token"))
    cascade = rel.where("_tok = 'cascade'").select("repo_id", "parent", F.lit(True).alias("_sib")).distinct()
    sibling = rel.where("_tok = 'restrict'").join(cascade, ["repo_id", "parent"], "left_semi").select("repo_id", F.col("child").alias("store_id"), F.lit(True).alias("_exempt")).distinct()
    tokens = rel.where("_tok IN ('protect', 'restrict')").groupBy("repo_id", F.col("child").alias("store_id")).agg(F.bool_or(F.col("_tok") == "protect").alias("_p"))
    blocking = tokens.join(sibling, ["repo_id", "store_id"], "left").where("_p OR _exempt IS NULL").select("repo_id", "store_id")
    some = F.exists(F.map_values("kw"), lambda a: a["kind"] == "literal")
    narrow = estate.code.calls.where(F.col("name").isin("filter", "exclude") & some).select("repo_id", F.col("path").alias("_f"), F.col("line").alias("_l"), F.lit(True).alias("_narrow")).distinct()
    h = hits.select("repo_id", "node", F.col("last.file").alias("_f"), F.col("last.line").alias("_l"))
    b = blocking.join(estate.stores.select("repo_id", "store_id", "node"), ["repo_id", "store_id"]).join(h, ["repo_id", "node"], "left").join(narrow, ["repo_id", "_f", "_l"], "left")
    state = F.when(F.col("_f").isNull(), "absent").when(F.col("_narrow"), "disqualified").otherwise("qualified")
    return b.select("repo_id", "store_id", state.alias("protect"))


def only_declared_symbols(walked: DataFrame) -> DataFrame:
    """repo_id, symbol, only_declared: reached from unregistered declared starts and no others."""
    return walked.groupBy("repo_id", "symbol").agg(F.bool_and(F.array_contains("entry_flags", "declared_unregistered")).alias("only_declared"))


def unverified_reasons(estate: Estate, edges: DataFrame, sure_hits: DataFrame, walked: DataFrame, any_hit: DataFrame) -> DataFrame:
    """repo_id, store_id, reason: the first reason, in a fixed order, why a store cannot be decided."""
    code, stores, rel = estate.code, estate.stores, estate.relations
    reached = sure_hits.select("repo_id", "store_id").distinct()
    parent_reached = rel.join(reached.select("repo_id", F.col("store_id").alias("parent")), ["repo_id", "parent"], "left_semi")
    say = lambda df, rank, why: df.select("repo_id", "store_id", F.struct(F.lit(rank).alias("o"), F.lit(why).alias("why")).alias("w"))
    split = stores.where(F.array_contains("flags", "django_file_field")).join(estate.settings["cleanup"].where("mode = 'DISAGREE'"), ["repo_id"], "left_semi")
    split = split.select("repo_id", "store_id", "model").join(row_stores(stores).select("repo_id", "model", F.col("store_id").alias("_own")), ["repo_id", "model"]).join(
        reached.select("repo_id", F.col("store_id").alias("_own")), ["repo_id", "_own"], "left_semi")
    ddl = estate.flags.where("flag = 'r6_unverified'").join(parent_reached.where("ondelete <> ''").select("repo_id", F.col("child").alias("store_id")), ["repo_id", "store_id"], "left_semi")
    tok = rel.withColumn("_tok", t.norm("token"))
    restrict = tok.where("_tok = 'restrict'").join(tok.where("_tok = 'cascade'").select("repo_id", "parent"), ["repo_id", "parent"], "left_semi").select("repo_id", F.col("child").alias("store_id")).distinct()
    rawed = estate.primitives.where("mode = 'raw_sql'").select("repo_id", F.col("store_id").alias("parent")).distinct()
    raw = parent_reached.join(rawed, ["repo_id", "parent"], "left_semi").select("repo_id", F.col("child").alias("store_id")).distinct()
    path = walked.select("repo_id", "symbol").distinct()
    refs = references(code)
    refs = refs.join(path.select("repo_id", F.col("symbol").alias("caller")), ["repo_id", "caller"], "left_semi").join(path.select("repo_id", F.col("symbol").alias("target")), ["repo_id", "target"], "left_anti")
    weak = estate.receivers.where("nested AND weak").select("repo_id", F.col("symbol").alias("node"), F.lit("weak").alias("why"))
    origins = stage(weak.unionByName(refs.select("repo_id", F.col("target").alias("node"), F.lit("reference").alias("why"))).distinct())
    node = stores.select("repo_id", "store_id", "node")
    frames = [say(split, 1, "R10"), say(ddl, 2, "R6"), say(restrict, 3, "R3b"), say(raw, 4, "R19")]
    if not origins.isEmpty():
        starts = origins.select("repo_id", F.concat_ws(":", "why", "node").alias("entry"), "node", F.lit("none").alias("mode"))
        from_symbol = stage(reach(edges, starts, hubs=estate.hubs).select("repo_id", "entry", "node").distinct().join(node, ["repo_id", "node"]))
        frames.append(say(from_symbol.where("entry LIKE 'weak:%'"), 5, "R11"))
        frames.append(say(from_symbol.where("entry LIKE 'reference:%'"), 7, "R26 reference"))
    opaque = code.calls.where("rule = 'CG-12'").select("repo_id", F.substring_index("receiver", ".", 1).alias("client"), F.col("path").alias("file"))
    clients = stores.where("size(clients) > 0").select("repo_id", "store_id", "file", "clients")
    held = clients.select("repo_id", "store_id", F.explode("clients").alias("client")).join(opaque, ["repo_id", "client"], "left_semi").select("repo_id", "store_id")
    files = clients.select("repo_id", "store_id", "file").unionByName(estate.primitives.join(clients.select("repo_id", "store_id"), ["repo_id", "store_id"], "left_semi").select("repo_id", "store_id", "file"))
    near = files.join(opaque, ["repo_id", "file"], "left_semi").select("repo_id", "store_id")
    frames.append(say(held.unionByName(near).distinct(), 6, "R26 opaque call"))
    return union(frames).groupBy("repo_id", "store_id").agg(F.min("w").alias("w")).select("repo_id", "store_id", F.col("w.why").alias("reason"))


def forwarding(estate: Estate, steps: DataFrame, hit: DataFrame, r: Rules) -> DataFrame:
    """repo_id, store_id, _forwards: a third party told, by literal, to delete downstream as well."""
    spark = steps.sparkSession
    kinds = [(name, f) for name, _r, _i, _t, _s, _d, forward in r.rows("recipients") for f in forward]
    wanted = rule_table(spark, kinds, "store_id string, value string")
    on = hit.select("repo_id", F.col("hit.entry").alias("entry"), F.col("node").alias("target"))
    said = steps.join(on, ["repo_id", "entry", "target"], "left_semi").withColumn("value", F.substring_index("note", "|", -1)).withColumn("store_id", F.regexp_replace("target", "^store:", ""))
    return said.join(wanted, ["store_id", "value"], "left_semi").select("repo_id", "store_id", F.lit(True).alias("_forwards")).distinct()


def explain(estate: Estate, found: dict[str, DataFrame], r: Rules | None = None) -> DataFrame:
    """repo_id, store_id, detail: the first probe that fits a store, else its rule."""
    r = r or default_rules()
    v = found["stores"].select("repo_id", "store_id", "kind", "verdict", "rule", "marker")
    s = estate.stores.select("repo_id", "store_id", "model", "flags")
    reached = found["sure_hits"].select("repo_id", "store_id", F.lit(True).alias("_hit")).distinct()
    called = estate.edges.where("kind = 'call'").select("repo_id", F.col("dst").alias("caller")).distinct()
    known = estate.code.symbols.select("repo_id", F.col("name").alias("caller"))
    lonely = estate.primitives.join(known, ["repo_id", "caller"], "left_semi").join(called, ["repo_id", "caller"], "left_anti")
    lonely = lonely.groupBy("repo_id", "store_id").agg(F.min(F.struct("file", "line", "caller")).alias("_lonely"))
    heard = estate.receivers.groupBy("repo_id").agg(F.array_sort(F.collect_set("sender")).alias("_senders"), F.bool_or(F.col("sender").isNull()).alias("_any"))
    row = row_stores(estate.stores).select("repo_id", "model", F.col("store_id").alias("_row"))
    rel = estate.relations.select("repo_id", F.col("child").alias("_c"), F.upper("token").alias("_tok"), "kind")
    mine = s.join(row, ["repo_id", "model"], "left").select("repo_id", "store_id", F.explode(F.array_compact(F.array("store_id", "_row"))).alias("_c")).distinct().join(rel, ["repo_id", "_c"])
    facts = mine.groupBy("repo_id", "store_id").agg(
        F.bool_or(F.col("_tok") == "DB_CASCADE").alias("_r4"), F.bool_or(F.col("_tok").isin("SET_NULL", "SET_DEFAULT", "SET", "DO_NOTHING")).alias("_r2"),
        F.bool_or((F.col("kind") == "relationship") & (F.col("_tok") != "") & ~t.cascade_is_delete(F.lower("_tok"), r.words("cascade_tokens"))).alias("_r5"))
    out = v.join(s, ["repo_id", "store_id"])
    for part, on in ((reached, ["repo_id", "store_id"]), (lonely, ["repo_id", "store_id"]), (heard, ["repo_id"]), (facts, ["repo_id", "store_id"])):
        out = out.join(part, on, "left")
    miss = F.col("_hit").isNull()
    detail = F.coalesce(
        F.when(miss & F.col("_lonely").isNotNull(), F.lit("R26 defined but has no callers")),
        F.when((F.col("verdict") != "erased_after_timer") & F.col("marker").isNotNull(), F.lit("R25 only sets a flag")),
        F.when(miss & F.col("model").isNotNull() & ~F.col("_any") & ~F.array_contains("_senders", F.col("model")), F.lit("R9 receiver has another sender")),
        F.when(F.array_contains("flags", "django_file_field"), F.lit("R8 a row cascade does not delete the file")),
        F.when(F.col("_r4"), F.lit("R4 no delete signal is sent")), F.when(miss & F.col("_r5"), F.lit("R5 no delete token")),
        F.when(miss & F.col("_r2"), F.lit("R2 the row survives")), F.when(F.array_contains("flags", "recipient:stripe"), F.lit("R22 not erased at the recipient")), F.col("rule"))
    return out.select("repo_id", "store_id", "verdict", detail.alias("detail"))

