"""Edges the frameworks imply: cascades, receivers, overrides, tasks and deletion primitives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datarights.functions import text as t
from datarights.operators.graph import all_modes, closure, mode_array, package_seeds
from datarights.operators.inventory import first_literal, literals, matches_suffix, null, union
from datarights.operators.resolve import Code, call_edges, dotted_of, head_of, join_name, lookup, model_of, tail_of
from datarights.session import rule_table, stage, stage_all
from datarights.sources.rules import Rules

COLUMNS = ["repo_id", "src", "dst", "kind", "file", "line", "rule", "ambiguous", "modes", "sets_mode", "hub", "note"]


def edge_rows(df: DataFrame, kind, rule, modes: Column, **cells) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    base = {"kind": as_col(kind), "rule": as_col(rule), "modes": modes, "ambiguous": F.lit(False), "sets_mode": null(), "hub": F.lit(False), "note": F.lit(""), **cells}
    return df.select(*[(base[c] if c in base else F.col(c)).alias(c) for c in COLUMNS])


def row_stores(stores: DataFrame) -> DataFrame:
    """repo_id, model, store_id, node of the row store of each model."""
    rows = stores.where("kind = 'relational' AND model IS NOT NULL")
    return rows.groupBy("repo_id", "model").agg(F.min(F.struct("store_id", "node")).alias("s")).select("repo_id", "model", "s.store_id", "s.node")


# --- engines and receivers ---------------------------------------------------------------------------------

def import_links(code: Code) -> DataFrame:
    """repo_id, src, dst: module imports module, function-level imports included."""
    mods = code.modules.select("repo_id", F.col("module").alias("dst")).distinct()
    return code.imports.select("repo_id", F.col("module").alias("src"), F.col("dotted").alias("dst")).join(mods, ["repo_id", "dst"], "left_semi").distinct()


def loaded_modules(code: Code, apps: DataFrame) -> DataFrame:
    """repo_id, module: what the framework loads from its installed apps, and what that imports.

    A repository without an apps setting counts as fully loaded.
    """
    labels = apps.select("repo_id", F.explode("keys").alias("label"))
    parts = labels.select("repo_id", F.filter(F.split("label", r"\."), lambda p: p != "").alias("p")).where("size(p) > 0")
    last, n = F.element_at("p", -1), F.size("p")
    whole = F.array_join("p", ".")
    upper = last.rlike("^[A-Z]")
    cut_one = F.when(upper, F.array_join(F.slice("p", F.lit(1), n - 1), "."))
    cut_two = F.when(upper & (n >= 3) & (F.element_at("p", F.greatest(n - 1, F.lit(1))) == "apps"), F.array_join(F.slice("p", F.lit(1), F.greatest(n - 2, F.lit(0))), "."))
    packages = parts.select("repo_id", F.explode(F.array_compact(F.array(whole, cut_one, cut_two))).alias("package")).where("package <> ''").distinct()
    modules = code.modules.select("repo_id", "module").distinct()
    has_apps = apps.select("repo_id").distinct()
    seeds = package_seeds(modules.join(has_apps, ["repo_id"], "left_semi"), packages)
    found = closure(import_links(code), seeds.select("repo_id", F.lit("apps").alias("entry"), F.col("module").alias("node")))
    rest = modules.join(has_apps, ["repo_id"], "left_anti")
    return found.select("repo_id", F.col("node").alias("module")).unionByName(rest).distinct()


def _span_text(code: Code, spans: DataFrame) -> DataFrame:
    """Adds `body`: the source lines after a symbol's first line up to its last."""
    text = spans.join(code.files.select("repo_id", F.col("path").alias("file"), F.col("text").alias("_src")), ["repo_id", "file"], "left")
    lines = F.slice(F.split("_src", "\n"), F.col("sline") + 1, F.greatest(F.col("eline") - F.col("sline"), F.lit(0)))
    return text.withColumn("body", F.array_join(lines, "\n")).drop("_src")


def receivers(code: Code, loaded: DataFrame, r: Rules) -> DataFrame:
    """Delete-signal receivers with their sender, by decorator or by connect call."""
    sym = code.symbols.select("repo_id", F.col("name").alias("symbol"), "module", "file", F.col("line").alias("sline"), F.col("end_line").alias("eline"), "nested", "decorators", "short")
    d = sym.select("*", F.explode("decorators").alias("d")).where("d.name = 'receiver'")
    a = d.select("repo_id", "symbol", "module", "file", "sline", "eline", "nested", tail_of(F.get("d.args", F.lit(0))).alias("signal"), F.col("d.keywords")["sender"].alias("sender"),
                 F.col("d.keywords")["weak"].alias("weak"), F.col("file").alias("at_file"), F.col("d.line").alias("at_line"))
    c = code.calls.where("name = 'connect'").withColumn("signal", tail_of("receiver")).where(F.col("signal").isin(r.words("delete_signals")))
    c = c.select("repo_id", "module", "signal", F.get("args", F.lit(0))["value"].alias("written"), F.col("kw")["sender"]["value"].alias("sender"), F.col("kw")["weak"]["value"].alias("weak"),
                 F.col("path").alias("at_file"), F.col("line").alias("at_line")).where("written IS NOT NULL")
    c = any_symbol(c, code).where("symbol IS NOT NULL").drop("module", "written").join(sym.drop("decorators", "short"), ["repo_id", "symbol"])
    every = union([a, c.select(*a.columns)]).where(F.col("signal").isin(r.words("delete_signals")))
    every = lookup(every.withColumn("head", head_of(F.coalesce("sender", F.lit("")))).withColumn("scope", null()), code.imports)
    names = code.classes.select("repo_id", F.col("name").alias("_n"), F.lit(True).alias("_k"))
    every = every.withColumn("_d", dotted_of(F.col("sender"))).withColumn("_l", join_name(F.col("module"), F.col("sender")))
    every = every.join(names.select("repo_id", F.col("_n").alias("_d"), F.col("_k").alias("_hd")), ["repo_id", "_d"], "left")
    every = every.join(names.select("repo_id", F.col("_n").alias("_l"), F.col("_k").alias("_hl")), ["repo_id", "_l"], "left")
    model = F.when(F.col("_hd"), F.col("_d")).when(F.col("_hl"), F.col("_l")).otherwise(F.nullif("sender", F.lit("")))
    every = every.withColumn("model", model)
    every = _span_text(code, every)
    guards = F.col("model").isNull() & t.contains_any(F.coalesce("body", F.lit("")), r.words("sender_guards"))
    live = loaded.withColumn("_live", F.lit(True))
    every = every.join(live, ["repo_id", "module"], "left")
    weak = F.when(F.col("weak").isNull(), True).otherwise(t.norm("weak") != "false")
    return every.select("repo_id", "symbol", "signal", F.col("model").alias("sender"), F.col("at_file").alias("file"), F.col("at_line").alias("line"), weak.alias("weak"), "nested",
                        guards.alias("guards_on_sender"), F.coalesce("_live", F.lit(False)).alias("connected")).distinct()


def any_symbol(uses: DataFrame, code: Code) -> DataFrame:
    """Adds `symbol` for `written`: imported, of the same module, else the only one so named."""
    u = lookup(uses.withColumn("head", head_of("written")).withColumn("scope", null()), code.imports)
    u = u.withColumn("_d", dotted_of(F.col("written"))).withColumn("_l", join_name(F.col("module"), F.col("written"))).withColumn("_t", tail_of("written"))
    names = code.symbols.select("repo_id", F.col("name").alias("_n"), F.lit(True).alias("_k"))
    u = u.join(names.select("repo_id", F.col("_n").alias("_d"), F.col("_k").alias("_hd")), ["repo_id", "_d"], "left")
    u = u.join(names.select("repo_id", F.col("_n").alias("_l"), F.col("_k").alias("_hl")), ["repo_id", "_l"], "left")
    one = code.symbols.groupBy("repo_id", F.col("short").alias("_t")).agg(F.count("*").alias("_c"), F.min("name").alias("_only")).where("_c = 1").select("repo_id", F.col("_t"), "_only")
    u = u.join(one, ["repo_id", "_t"], "left")
    out = F.coalesce(F.when(F.col("_hd"), F.col("_d")), F.when(F.col("_hl"), F.col("_l")), "_only")
    return u.withColumn("symbol", out).drop("head", "scope", "_d", "_l", "_t", "_hd", "_hl", "_only", "bind_kind", "bind_dotted")


def enforcing_engines(code: Code, engines: DataFrame, r: Rules) -> DataFrame:
    """repo_id of repositories whose bound engine is shown to enforce foreign keys.

    A server engine enforces, unless it is one of several of different kinds; for the rest
    a connect listener on that engine, in a module the engine's own loads, must emit the pragma.
    """
    strong = F.col("url").isin(r.words("enforcing_engines"))
    for word in r.words("enforcing_urls"):
        strong = strong | F.col("url").startswith(word) | F.col("url").contains(f"backends.{word}")
    per = engines.groupBy("repo_id").agg(F.count("*").alias("n"), F.sum(F.when(strong, 1).otherwise(0)).alias("k"))
    sure = per.where("k > 0 AND (n = 1 OR k = n)").select("repo_id")
    open_ = per.where("k = 0").select("repo_id", "n")
    mods = code.modules.select("repo_id", F.col("path").alias("file"), "module")
    seeds = engines.join(open_, ["repo_id"], "left_semi").join(mods, ["repo_id", "file"]).select("repo_id", F.lit("engine").alias("entry"), F.col("module").alias("node"))
    allowed = closure(import_links(code), seeds).select("repo_id", F.col("node").alias("module")).distinct()
    deco = code.symbols.select("repo_id", F.col("name").alias("symbol"), "module", F.explode("decorators").alias("d")).where("d.name = 'listens_for' AND size(d.args) >= 2")
    deco = deco.where(t.norm(F.get("d.args", F.lit(1))) == "connect").select("repo_id", "symbol", "module", tail_of(F.get("d.args", F.lit(0))).alias("target"))
    call = code.calls.where("name = 'listen' AND size(args) >= 3").where(t.norm(F.get("args", F.lit(1))["value"]) == "connect")
    call = call.select("repo_id", "module", F.get("args", F.lit(2))["value"].alias("written"), tail_of(F.get("args", F.lit(0))["value"]).alias("target"))
    call = any_symbol(call, code).where("symbol IS NOT NULL").select("repo_id", "symbol", "target").join(code.symbols.select("repo_id", F.col("name").alias("symbol"), "module"), ["repo_id", "symbol"])
    listeners = deco.unionByName(call.select(*deco.columns)).join(allowed, ["repo_id", "module"], "left_semi").join(open_, ["repo_id"])
    named = engines.select("repo_id", tail_of("var").alias("target"), F.lit(True).alias("_var")).where("target <> ''").distinct()
    listeners = listeners.join(named, ["repo_id", "target"], "left").where("target = 'Engine' OR (_var AND n = 1)")
    wanted = [w.replace(" ", "") for w in r.words("pragma_literals")]
    emits = F.exists(F.concat("args", F.map_values("kw")), lambda a: (a["kind"] == "literal") & t.contains_any(F.replace(a["value"], F.lit(" "), F.lit("")), wanted))
    emitting = code.calls.where(emits).select("repo_id", F.col("caller").alias("symbol")).distinct()
    return sure.unionByName(listeners.join(emitting, ["repo_id", "symbol"], "left_semi").select("repo_id")).distinct()


# --- primitives ----------------------------------------------------------------------------------------------

def match_primitives(code: Code, r: Rules) -> DataFrame:
    """Calls against deletion patterns: one row per (call, pattern) that fits, with the order tried."""
    rows = [(int(o), k, p, p.split(".")[-1], a, m, rule) for o, k, p, a, m, rule in r.rows("primitives")]
    table = rule_table(code.imports.sparkSession, rows, "ord int, store_kind string, pattern string, tail string, arg0_call string, sets string, prim_rule string")
    tails = sorted({x[3] for x in rows})
    calls = code.calls.where(F.col("name").isin(tails))
    joined = calls.join(table, calls["name"] == table["tail"])
    dotted = F.coalesce(F.nullif("dotted", F.lit("")), "name")
    return joined.where(t.call_matches(dotted, F.col("name"), F.col("pattern")))


def keyed_targets(code: Code, hits: DataFrame, stores: DataFrame, r: Rules) -> DataFrame:
    """Store a keyed deletion touches, by the call's own literal and never by its client."""
    k = hits.where("store_kind <> 'relational'").select("repo_id", "module", "call_id", "store_kind", "args", "kw").dropDuplicates(["repo_id", "call_id", "store_kind"])
    bucket = literals(k.where("store_kind = 'object_storage'"), F.col("kw")["Bucket"], code)
    cache = literals(k.where("store_kind = 'cache'"), F.get("args", F.lit(0)), code).withColumn("literal", t.namespace("literal"))
    index = literals(k.where("store_kind = 'search_index'"), F.col("kw")["index"], code)
    queue = first_literal(k.where("store_kind = 'queue'"), r.words("queue_delete_kwargs"), code)
    said = union([p.select("repo_id", "call_id", "store_kind", "literal") for p in (bucket, cache, index, queue)]).where("literal <> ''")
    ids = stores.groupBy("repo_id", F.col("kind").alias("store_kind"), t.norm("identity").alias("_n")).agg(F.min(F.struct("store_id", "node")).alias("_s"))
    return said.withColumn("_n", t.norm("literal")).join(ids, ["repo_id", "store_kind", "_n"]).select("repo_id", "call_id", "store_kind", F.col("_s.store_id").alias("store_id"))


def relational_targets(code: Code, hits: DataFrame, stores: DataFrame, relations: DataFrame, bindings: DataFrame, r: Rules) -> DataFrame:
    """repo_id, call_id, ord, store_id, mode, rule of deletions from tables, by the shape of the call."""
    h = hits.where("store_kind = 'relational'").select("repo_id", "module", "call_id", "caller", "owner", "name", "receiver", "args", "ord", "arg0_call", "sets", "prim_rule")
    rows = row_stores(stores).select("repo_id", "model", "store_id")
    segments = F.transform(F.split("receiver", r"\."), lambda p: F.replace(p, F.lit("()"), F.lit("")))
    h = h.withColumn("_seg", segments)
    arg0 = F.get("args", F.lit(0))
    last = tail_of("receiver")
    session = ((F.col("name") == "delete") & last.isin("session", "db")) | F.col("receiver").endswith("session")
    raw = (F.col("sets") == "raw_sql")
    shape = (F.when(F.col("arg0_call") != "", F.when((arg0["kind"] == "call") & (tail_of(arg0["value"]) == F.col("arg0_call")), F.when(raw, "raw").otherwise("statement")))
             .when(raw, "raw").when(session, "session").when(F.col("receiver").contains("."), "chain").otherwise("plain"))
    h = h.withColumn("_shape", shape).where("_shape IS NOT NULL")
    qs = F.array(*[F.lit(w) for w in r.words("queryset_segments")])
    words = (F.when(F.col("_shape") == "statement", F.concat(arg0["refs"], arg0["names"], arg0["keys"]))
             .when(F.col("_shape") == "session", F.transform("args", lambda a: a["value"]))
             .when((F.col("_shape") == "chain") & (F.size("_seg") >= 2) & F.arrays_overlap("_seg", qs), F.array(F.get("_seg", F.lit(0))))
             .when(F.col("_shape") == "plain", F.array("receiver")))
    asked = h.where("_shape <> 'raw'").select("repo_id", "module", "call_id", "ord", "caller", "owner", F.posexplode(words).alias("i", "written"))
    found = model_of(asked, code, bindings).where("model IS NOT NULL").groupBy("repo_id", "call_id", "ord").agg(F.min_by("model", "i").alias("model"))
    h = h.join(found, ["repo_id", "call_id", "ord"], "left").join(rows, ["repo_id", "model"], "left")
    # Chains: own rows for `Model.objects...`, the related rows for `subject.accessor.all()`.
    second = F.get("_seg", F.lit(1))
    h = h.withColumn("_accessor", F.when((F.col("_shape") == "chain") & ~F.array_contains(qs, second), t.norm(second)))
    child_model = stores.select("repo_id", F.col("store_id").alias("child"), F.col("model").alias("_cm"))
    rel = relations.join(child_model, ["repo_id", "child"])
    names = F.array_compact(F.array(F.when(F.col("related_name") != "", t.norm("related_name")), F.when((F.col("kind") == "relationship") & (F.col("field_name") != ""), t.norm("field_name")),
                                    F.when((F.col("kind") == "fk") & F.col("_cm").isNotNull(), t.norm(F.concat(tail_of("_cm"), F.lit("_set"))))))
    access = rel.select("repo_id", F.col("parent").alias("store_id"), "child", "file", "line", F.explode(names).alias("_accessor"))
    access = access.groupBy("repo_id", "store_id", "_accessor").agg(F.min(F.struct("file", "line", "child")).alias("_a")).select("repo_id", "store_id", "_accessor", F.col("_a.child").alias("_child"))
    h = h.join(access, ["repo_id", "store_id", "_accessor"], "left")
    # A plain name bound to a queryset is not an instance.
    held = code.assigns.where("scope IS NOT NULL").where(F.arrays_overlap(F.transform(F.split("value", r"\."), lambda p: F.replace(p, F.lit("()"), F.lit(""))), qs)).select(
        "repo_id", F.col("scope").alias("caller"), F.col("target").alias("receiver"), F.lit(True).alias("_qs")).distinct()
    h = h.join(held, ["repo_id", "caller", "receiver"], "left")
    sql = raw_targets(h.where("_shape = 'raw'"), stores)
    h = h.join(sql, ["repo_id", "call_id", "ord"], "left")
    store = (F.when(F.col("_shape") == "raw", F.col("_raw")).when(F.col("_accessor").isNotNull(), F.col("_child")).otherwise(F.col("store_id")))
    queryset = (F.col("_shape") == "chain") | ((F.col("_shape") == "plain") & F.coalesce("_qs", F.lit(False)))
    mode = F.when(queryset, "queryset_delete").otherwise(F.nullif("sets", F.lit("")))
    rule = F.when(queryset, "R15").otherwise(F.col("prim_rule"))
    return h.select("repo_id", "call_id", "ord", store.alias("store_id"), mode.alias("mode"), rule.alias("rule")).where("store_id IS NOT NULL")


def raw_targets(calls: DataFrame, stores: DataFrame) -> DataFrame:
    """The table named in a raw DELETE literal, matched to a row store by normalised id."""
    texts = F.flatten(F.transform("args", lambda a: F.concat(F.array(a["value"]), a["keys"])))
    each = calls.select("repo_id", "call_id", "ord", F.posexplode(texts).alias("i", "sql")).withColumn("_n", t.norm(t.raw_delete_target("sql"))).where("_n IS NOT NULL")
    ids = stores.where("kind = 'relational'").groupBy("repo_id", t.norm("store_id").alias("_n")).agg(F.min("store_id").alias("_raw"))
    return each.join(ids, ["repo_id", "_n"]).groupBy("repo_id", "call_id", "ord").agg(F.min_by("_raw", "i").alias("_raw"))


def primitives(code: Code, stores: DataFrame, relations: DataFrame, bindings: DataFrame, r: Rules) -> DataFrame:
    """repo_id, store_id, caller, file, line, call, mode, rule: one store at most per call (recipients aside)."""
    hits = stage(match_primitives(code, r))
    rel, keyed = stage_all([relational_targets(code, hits, stores, relations, bindings, r), keyed_targets(code, hits, stores, r)])
    by_key = hits.where("store_kind <> 'relational'").select("repo_id", "call_id", "store_kind", "ord", F.nullif("sets", F.lit("")).alias("mode"), F.col("prim_rule").alias("rule")).join(
        keyed, ["repo_id", "call_id", "store_kind"]).select("repo_id", "call_id", "ord", "store_id", "mode", "rule")
    # `row.field.delete()` on a file field goes first and takes the call.
    f = code.calls.where("name = 'delete' AND contains(receiver, '.')").select("repo_id", "module", "call_id", "caller", "owner", F.regexp_extract("receiver", r"^(.*)\.[^.]*$", 1).alias("written"), tail_of("receiver").alias("_field"))
    f = model_of(f, code, bindings).where("model IS NOT NULL").withColumn("store_id", F.concat(t.norm(tail_of("model")), F.lit("."), "_field"))
    f = f.join(stores.select("repo_id", "store_id"), ["repo_id", "store_id"], "left_semi").select("repo_id", "call_id", F.lit(-1).alias("ord"), "store_id", null().alias("mode"), F.lit("R8").alias("rule"))
    best = union([rel, by_key, f]).groupBy("repo_id", "call_id").agg(F.min_by(F.struct("store_id", "mode", "rule"), "ord").alias("b"))
    at = code.calls.select("repo_id", "call_id", "caller", F.col("path").alias("file"), "line", F.coalesce(F.nullif("dotted", F.lit("")), "name").alias("call"), "name", "kw", "dotted")
    own = best.join(at, ["repo_id", "call_id"]).select("repo_id", "call_id", "b.store_id", "caller", "file", "line", "call", "b.mode", "b.rule", F.lit("").alias("forwards"))
    parts = [own]
    kwarg = r.map("pii_switches")["forwarding_kwarg"]
    for name, rule, _i, _t, _s, deletes, _f in r.rows("recipients"):
        if deletes:
            sent = at.where(matches_suffix("call", deletes)).join(stores.where(F.col("store_id") == name).select("repo_id"), ["repo_id"], "left_semi")
            arg = F.col("kw")[kwarg]
            parts.append(sent.select("repo_id", "call_id", F.lit(name).alias("store_id"), "caller", "file", "line", "call", null().alias("mode"), F.lit(rule).alias("rule"),
                                     F.when(arg["kind"] == "literal", arg["value"]).otherwise("").alias("forwards")))
    return union(parts)


# --- synthetic edges -------------------------------------------------------------------------------------------

def synthetic_edges(code: Code, stores: DataFrame, relations: DataFrame, entries: DataFrame, prims: DataFrame, settings: dict[str, DataFrame], receivers_: DataFrame,
                    enforcing: DataFrame, tasks: DataFrame, r: Rules) -> tuple[DataFrame, DataFrame]:
    """All edges beside the calls, and the (repo_id, store_id, flag) notes made on the way."""
    node = stores.select("repo_id", "store_id", "node")
    parent = node.select("repo_id", F.col("store_id").alias("parent"), F.col("node").alias("src"))
    child = node.select("repo_id", F.col("store_id").alias("child"), F.col("node").alias("dst"))
    rel = relations.join(parent, ["repo_id", "parent"]).join(child, ["repo_id", "child"]).join(enforcing.withColumn("_enf", F.lit(True)), ["repo_id"], "left")
    tokens = rule_table(code.imports.sparkSession, [(a, b, c, d, e) for a, b, c, d, e in r.rows("on_delete")], "token string, is_edge boolean, edge_kind string, edge_rule string, sets string")
    rows_deleted = mode_array(["model_delete", "queryset_delete"])
    fk = rel.where("kind = 'fk' AND token <> ''").join(tokens, ["token"]).where("is_edge")
    parts = [edge_rows(fk, F.col("edge_kind"), F.col("edge_rule"), rows_deleted, sets_mode=F.nullif("sets", F.lit("")), note=F.concat(F.lit("on_delete="), "token"))]
    ddl = rel.where("kind = 'fk' AND token = ''").where(t.norm("ondelete") == "cascade")
    parts.append(edge_rows(ddl.where("_enf"), "SE7", "R6", all_modes()))
    passive = relations.where("passive_deletes").select("repo_id", F.col("child").alias("_p")).distinct()
    loose = ddl.where("_enf IS NULL").select("repo_id", "child", F.explode(F.array("child", "parent")).alias("_p")).join(passive.withColumn("_pass", F.lit(True)), ["repo_id", "_p"], "left")
    flags = loose.groupBy("repo_id", F.col("child").alias("store_id")).agg(F.when(F.bool_or(F.coalesce("_pass", F.lit(False))), "r6_not_erased").otherwise("r6_unverified").alias("flag"))
    session = mode_array(["session_delete"])
    orm = rel.where("kind = 'relationship'").where(t.cascade_is_delete("token", r.words("cascade_tokens")))
    parts.append(edge_rows(orm, "SE5", "R5", session, note=F.concat(F.lit("cascade="), "token")))
    parts.append(edge_rows(rel.where("kind = 'secondary'"), "SE6", "R7", session))
    live = receivers_.where("connected AND NOT guards_on_sender AND NOT (nested AND weak)")
    row = row_stores(stores)
    by_sender = live.where("sender IS NOT NULL").join(row.select("repo_id", F.col("model").alias("sender"), F.col("node").alias("src")), ["repo_id", "sender"])
    parts.append(edge_rows(by_sender, "SE2", "R9", rows_deleted, dst=F.col("symbol")))
    # A receiver without a sender hears every table: they meet in one node per repository, so
    # tables times receivers is never written out.
    every = live.where("sender IS NULL")
    tables = stores.where("kind = 'relational'").select("repo_id", F.col("node").alias("src"), "file", "line").join(every.select("repo_id").distinct(), ["repo_id"], "left_semi")
    parts.append(edge_rows(tables, "SE2", "R9", rows_deleted, dst=F.lit("signal:any")))
    parts.append(edge_rows(every, "SE2", "R9", rows_deleted, src=F.lit("signal:any"), dst=F.col("symbol")))
    deco = code.classes.select("repo_id", F.col("name").alias("model"), F.col("file").alias("cfile"), F.col("line").alias("cline"), F.transform("decorators", lambda d: d["dotted"]).alias("marks"))
    filed = stores.where(F.array_contains("flags", "django_file_field") & F.col("model").isNotNull()).select("repo_id", "model", F.col("node").alias("dst"))
    clean = filed.join(row.select("repo_id", "model", F.col("node").alias("src")), ["repo_id", "model"]).join(deco, ["repo_id", "model"]).join(settings["cleanup"], ["repo_id"])
    keeps = F.when(F.col("mode") == "ALL", ~F.exists("marks", lambda m: m.endswith("cleanup.ignore"))).when(F.col("mode") == "SELECT", F.exists("marks", lambda m: m.endswith("cleanup.select")))
    parts.append(edge_rows(clean.where(keeps), "SE3", "R10", rows_deleted, file=F.col("cfile"), line=F.col("cline")))
    over = code.symbols.where("short = 'delete' AND owner IS NOT NULL").select("repo_id", F.col("owner").alias("model"), F.col("name").alias("dst"), "file", "line")
    parts.append(edge_rows(over.join(row.select("repo_id", "model", F.col("node").alias("src")), ["repo_id", "model"]), "SE8", "R14", mode_array(["model_delete"])))
    events = r.words("mapper_delete_events")
    heard = code.symbols.select("repo_id", F.col("name").alias("dst"), "file", F.explode("decorators").alias("d")).where("d.name = 'listens_for' AND size(d.args) >= 2")
    heard = heard.where(F.get("d.args", F.lit(1)).isin(events)).select("repo_id", "dst", "file", F.col("d.line").alias("line"), tail_of(F.get("d.args", F.lit(0))).alias("short"))
    listen = code.calls.where("name = 'listen' AND size(args) >= 3").where(F.get("args", F.lit(1))["value"].isin(events)).select(
        "repo_id", "module", F.col("path").alias("file"), "line", F.get("args", F.lit(2))["value"].alias("written"), tail_of(F.get("args", F.lit(0))["value"]).alias("short"))
    listen = any_symbol(listen, code).where("symbol IS NOT NULL").select("repo_id", F.col("symbol").alias("dst"), "file", "line", "short")
    by_short = code.classes.groupBy("repo_id", "short").agg(F.min("name").alias("model")).join(row.select("repo_id", "model", F.col("node").alias("src")), ["repo_id", "model"]).select("repo_id", "short", "src")
    parts.append(edge_rows(heard.unionByName(listen).join(by_short, ["repo_id", "short"]), "SE9", "R18", session))
    admin = entries.where("admin_only").select("repo_id", F.col("node").alias("src"), "sets_mode", "file", "line", F.explode("models").alias("model")).join(row, ["repo_id", "model"])
    own_delete = code.symbols.where("short = 'delete'").select("repo_id", F.col("owner").alias("model"), F.col("name").alias("_over"))
    admin = admin.join(own_delete, ["repo_id", "model"], "left").withColumn("dst", F.when((F.col("sets_mode") == "model_delete") & F.col("_over").isNotNull(), F.col("_over")).otherwise(F.col("node")))
    parts.append(edge_rows(admin, "SE10", "R16", mode_array(["none"]), sets_mode=F.col("sets_mode")))
    named = entries.where("symbol IS NOT NULL").join(code.symbols.select("repo_id", F.col("name").alias("symbol")), ["repo_id", "symbol"], "left_semi")
    parts.append(edge_rows(named, "entry", "SE0", all_modes(), src=F.col("node"), dst=F.col("symbol")))
    sent = code.calls.where(F.col("name").isin(r.words("dispatch_calls")))
    sent = sent.withColumn("task", F.when(F.get("args", F.lit(0))["kind"] == "literal", F.get("args", F.lit(0))["value"])).withColumn("short", F.when(F.col("receiver") != "", tail_of("receiver")))
    lone = tasks.groupBy("repo_id", tail_of("symbol").alias("short")).agg(F.count("*").alias("_k"), F.min("symbol").alias("_lone")).where("_k = 1").select("repo_id", F.col("short"), "_lone")
    sent = sent.join(tasks.select("repo_id", "task", F.col("symbol").alias("_named")), ["repo_id", "task"], "left").join(lone, ["repo_id", "short"], "left")
    sent = sent.withColumn("dst", F.coalesce("_named", "_lone")).where("dst IS NOT NULL")
    parts.append(edge_rows(sent, "SE11", "CG-16", all_modes(), src=F.col("caller"), file=F.col("path")))
    prim = prims.join(node.select("repo_id", "store_id", F.col("node").alias("dst")), ["repo_id", "store_id"])
    parts.append(edge_rows(prim, "SE12", F.col("rule"), all_modes(), src=F.col("caller"), sets_mode=F.col("mode"), note=F.concat_ws("|", "call", "forwards")))
    return union(stage_all(parts)), flags


def build_edges(code: Code, synthetic: DataFrame) -> DataFrame:
    """Call edges and synthetic edges as one table."""
    return stage(call_edges(code.calls).select(*COLUMNS).unionByName(synthetic.select(*COLUMNS)).distinct())

