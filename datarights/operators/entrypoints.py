"""Where the deletion of an account begins: eight detectors, each symbol claimed by the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datarights.functions import text as t
from datarights.operators.inventory import null, union
from datarights.operators.resolve import Code, dotted_of, head_of, join_name, lookup, tail_of
from datarights.sources.rules import Rules
from datarights.session import stage, stage_all

COLUMNS = ["repo_id", "name", "kind", "file", "line", "symbol", "admin_only", "sets_mode", "path", "models", "flags", "ord"]


def vocabulary(name, r: Rules) -> Column:
    return t.vocabulary_hit(name, r.words("vocabulary"), r.words("action_only"), r.words("subject_words"))


def _rows(df: DataFrame, kind: str, flag: Column | str | None, order: int, **cells) -> DataFrame:
    flags = F.array().cast("array<string>") if flag is None else F.array(F.lit(flag)) if isinstance(flag, str) else flag
    base = {"kind": F.lit(kind), "admin_only": F.lit(False), "sets_mode": null(), "path": F.lit(""), "models": F.array().cast("array<string>"),
            "flags": flags, "ord": F.lit(order), **cells}
    return df.select(*[(base[c] if c in base else F.col(c)).alias(c) for c in COLUMNS])


def _symbol_rows(symbols: DataFrame) -> DataFrame:
    return symbols.select("repo_id", F.col("short").alias("name"), F.col("name").alias("symbol"), "file", "line", "decorators", "owner", "module", "nested")


def _qualified(df: DataFrame, code: Code, roots: DataFrame, r: Rules, path: Column) -> DataFrame:
    """Rows whose name, deleted model or route says they close an account."""
    binds = code.bindings.join(roots, ["repo_id", "model"], "left_semi").select("repo_id", "symbol", F.lit(True).alias("_root")).distinct()
    seen = df.join(binds, ["repo_id", "symbol"], "left")
    segment = t.subject_path_segment(path, r.words("subject_segments"), r.words("excluded_verbs"))
    return seen.where(vocabulary("name", r).isNotNull() | F.coalesce("_root", F.lit(False)) | segment).drop("_root")


def named_symbol(uses: DataFrame, code: Code, written: str = "written") -> DataFrame:
    """Adds `symbol`: a view or handler as written: imported, local, or the only free function so named."""
    u = lookup(uses.withColumn("head", head_of(written)).withColumn("scope", null()), code.imports)
    u = u.withColumn("_d", dotted_of(F.col(written))).withColumn("_l", join_name(F.col("module"), F.col(written))).withColumn("_t", tail_of(written))
    names = code.symbols.select("repo_id", F.col("name").alias("_n"))
    u = u.join(names.select("repo_id", F.col("_n").alias("_d"), F.lit(True).alias("_hd")), ["repo_id", "_d"], "left")
    u = u.join(names.select("repo_id", F.col("_n").alias("_l"), F.lit(True).alias("_hl")), ["repo_id", "_l"], "left")
    free = code.symbols.where("owner IS NULL").groupBy("repo_id", F.col("short").alias("_t")).agg(F.count("*").alias("_k"), F.min("name").alias("_only"))
    u = u.join(free.where("_k = 1").select("repo_id", F.col("_t"), "_only"), ["repo_id", "_t"], "left")
    symbol = F.coalesce(F.when(F.col("_hd"), F.col("_d")), F.when(F.col("_hl"), F.col("_l")), "_only")
    return u.withColumn("symbol", symbol).drop("head", "scope", "_d", "_l", "_t", "_hd", "_hl", "_only", "bind_kind", "bind_dotted")


def task_table(code: Code, r: Rules) -> DataFrame:
    """repo_id, task, symbol: the name a task is dispatched under."""
    each = code.symbols.select("repo_id", "module", "short", F.col("name").alias("symbol"), F.explode("decorators").alias("d")).where(F.col("d.name").isin(r.words("task_decorators")))
    given = F.coalesce(F.nullif(F.col("d.keywords")["name"], F.lit("")), F.concat_ws(".", "module", "short"))
    return each.groupBy("repo_id", given.alias("task")).agg(F.max("symbol").alias("symbol"))


def schedules_of(code: Code, jobs: DataFrame, tasks: DataFrame, schedules: DataFrame, r: Rules) -> DataFrame:
    """What says a job ever runs: repo_id, symbol, how, file, line; the best citation per job.

    A decorator keyword first, then a settings entry that names it, then a dispatching call
    that mentions it, each by (file, line). `jobs`: repo_id, symbol, short, decorators.
    """
    own = union([jobs.select("repo_id", "symbol", F.col("short").alias("n")), jobs.select("repo_id", "symbol", F.col("symbol").alias("n")),
                 tasks.join(jobs.select("repo_id", "symbol"), ["repo_id", "symbol"], "left_semi").select("repo_id", "symbol", F.col("task").alias("n"))]).distinct()
    keyed = jobs.select("repo_id", "symbol", F.col("file"), F.explode("decorators").alias("d"))
    keyword = F.coalesce(*[F.when(F.map_contains_key("d.keywords", F.lit(k)), F.lit(k)) for k in r.words("schedule_keywords")])
    a = keyed.select("repo_id", "symbol", keyword.alias("how"), "file", F.col("d.line").alias("line"), F.lit(0).alias("o")).where("how IS NOT NULL")
    said = schedules.select("repo_id", "how", "file", "line", F.explode("names").alias("n"))
    b = said.join(own, ["repo_id", "n"]).select("repo_id", "symbol", "how", "file", "line", F.lit(1).alias("o"))
    sent = code.calls.where(F.col("name").isin(r.words("dispatch_calls") + ["add_periodic_task"]))
    words = F.array_union(F.transform(F.concat("args", F.map_values("kw")), lambda x: x["value"]),
                          F.when(F.col("receiver") != "", F.array("receiver", tail_of("receiver"))).otherwise(F.array().cast("array<string>")))
    c = sent.select("repo_id", F.col("name").alias("how"), F.col("path").alias("file"), "line", F.explode(words).alias("n")).join(own, ["repo_id", "n"])
    found = union([a, b, c.select("repo_id", "symbol", "how", "file", "line", F.lit(2).alias("o"))])
    return found.groupBy("repo_id", "symbol").agg(F.min(F.struct("o", "file", "line", "how")).alias("s")).select("repo_id", "symbol", "s.how", "s.file", "s.line")


def entry_points(code: Code, stores: DataFrame, schedules: DataFrame, r: Rules, detectors: list | None = None) -> DataFrame:
    """repo_id, name, kind, file, line, symbol, admin_only, sets_mode, path, models, flags, node."""
    symbols, classes = code.symbols, code.classes
    roots = stores.where("subject_root AND model IS NOT NULL").select("repo_id", "model").distinct()
    s = _symbol_rows(symbols)
    deco = s.select("*", F.posexplode("decorators").alias("pos", "d"))
    methods = F.transform(F.split(F.concat_ws(",", F.col("d.keywords")["methods"], F.array_join("d.args", ",")), ","), lambda m: F.upper(F.trim(m)))

    # 1 routes
    specs = {name: method for name, method in r.rows("route_decorators")}
    route_ok = F.lit(False)
    for name, method in specs.items():
        fits = F.col("d.name") == name
        route_ok = route_ok | (fits & F.array_contains(methods, method) if method else fits)
    routed = deco.where(route_ok).withColumn("route", F.coalesce(F.get("d.args", F.lit(0)), F.lit("")))
    routed = _qualified(routed, code, roots, r, F.col("route"))
    routed = routed.groupBy("repo_id", "name", "symbol", "file", "line").agg(F.min_by("route", "pos").alias("route"))
    routes = _rows(routed, "route", "route_decorator", 1, path=F.col("route"))

    # 2 url rules and 4 url patterns
    where = symbols.select("repo_id", F.col("name").alias("symbol"), F.col("short").alias("name"), "file", F.col("line").alias("sline"))
    rule_calls = code.calls.where(F.col("name").isin(r.words("url_rule_calls")))
    rule = rule_calls.select("repo_id", "module", "call_id", F.coalesce(F.col("kw")["view_func"]["value"], F.get("args", F.lit(2))["value"], F.lit("")).alias("written"),
                             F.coalesce(F.get("args", F.lit(0))["value"], F.lit("")).alias("route"), F.col("kw")["methods"]["keys"].alias("m"))
    rule = rule.where(F.exists(F.coalesce("m", F.array().cast("array<string>")), lambda m: F.upper(F.trim(m)) == "DELETE") & (F.col("written") != ""))
    rule = named_symbol(rule, code).where("symbol IS NOT NULL").join(where, ["repo_id", "symbol"])
    rule = _qualified(rule, code, roots, r, F.col("route")).groupBy("repo_id", "name", "symbol", "file", "sline").agg(F.min_by("route", "call_id").alias("route"))
    rules_ = _rows(rule, "route", "route_registration", 2, path=F.col("route"), line=F.col("sline"))
    url_calls = code.calls.where(F.col("name").isin(r.words("url_calls")) & (F.size("args") >= 2))
    url = url_calls.select("repo_id", "module", "call_id", F.get("args", F.lit(1))["value"].alias("written"), F.get("args", F.lit(0))["value"].alias("route")).where("written <> ''")
    url = named_symbol(url, code).where("symbol IS NOT NULL").join(where, ["repo_id", "symbol"])
    url = url.where(vocabulary("name", r).isNotNull() | vocabulary("route", r).isNotNull()).groupBy("repo_id", "name", "symbol", "file", "sline").agg(F.min_by("route", "call_id").alias("route"))
    urls = _rows(url, "view", "urlpatterns_reference", 4, path=F.col("route"), line=F.col("sline"))

    # 3 viewsets
    base_tail = F.transform("names", lambda b: F.substring_index(b, ".", -1))
    sets = classes.where(F.exists(base_tail, lambda b: b.endswith("ViewSet"))).select("repo_id", "module", F.col("name").alias("owner"))
    attrs = code.class_assigns.where(F.col("target").isin(r.words("queryset_attrs"))).select("repo_id", "owner", F.explode("refs").alias("ref"))
    attrs = lookup(sets.join(attrs, ["repo_id", "owner"]).withColumn("head", F.col("ref")).withColumn("scope", null()), code.imports).withColumn("model", dotted_of(F.col("ref")))
    model = attrs.join(roots, ["repo_id", "model"], "left_semi").groupBy("repo_id", "owner").agg(F.max("model").alias("model"))
    acts = s.join(sets.select("repo_id", "owner"), ["repo_id", "owner"]).join(model, ["repo_id", "owner"], "left")
    is_action = F.exists("decorators", lambda d: (d["name"] == "action") & F.exists(
        F.split(F.concat_ws(",", d["keywords"]["methods"], F.array_join(d["args"], ",")), ","), lambda m: F.upper(F.trim(m)) == "DELETE"))
    acts = acts.where((F.col("name").isin(r.words("destroy_methods")) | is_action) & (F.col("model").isNotNull() | vocabulary("name", r).isNotNull()))
    viewsets = _rows(acts, "route", "drf_viewset", 3, models=F.array_compact(F.array("model")))

    # 5 delete views
    views = classes.where(F.exists(base_tail, lambda b: b.isin(r.words("delete_view_bases")))).where(
        vocabulary("short", r).isNotNull() | t.subject_word("short", r.words("subject_words"))).select("repo_id", F.col("name").alias("owner"), F.col("short").alias("cshort"), F.col("file").alias("cfile"), F.col("line").alias("cline"))
    held = views.join(s.where(F.col("name").isin("delete", "form_valid")), ["repo_id", "owner"], "left")
    held = held.select("repo_id", F.coalesce("name", "cshort").alias("name"), "symbol", F.coalesce("file", "cfile").alias("file"), F.coalesce("line", "cline").alias("line"))
    delete_views = _rows(held, "view", "delete_view", 5)

    # 6 commands
    cmds = classes.where(F.exists(base_tail, lambda b: b.isin(r.words("command_bases")))).select(
        "repo_id", F.concat("name", F.lit(".handle")).alias("symbol"), F.regexp_replace(F.substring_index("file", "/", -1), r"\.py$", "").alias("name"), F.col("file").alias("cfile"), F.col("line").alias("cline"))
    handle = symbols.select("repo_id", F.col("name").alias("symbol"), F.col("file").alias("hfile"), F.col("line").alias("hline"))
    speaks = code.calls.where(vocabulary("name", r).isNotNull()).select("repo_id", F.col("caller").alias("symbol"), F.lit(True).alias("_says")).distinct()
    cmds = cmds.join(handle, ["repo_id", "symbol"], "left").join(speaks, ["repo_id", "symbol"], "left").where(vocabulary("name", r).isNotNull() | (F.col("_says") & F.col("hfile").isNotNull()))
    cmds = cmds.select("repo_id", "name", F.when(F.col("hfile").isNotNull(), F.col("symbol")).alias("symbol"), F.coalesce("hfile", "cfile").alias("file"), F.coalesce("hline", "cline").alias("line"))
    commands = _rows(cmds, "cli", "BaseCommand_subclass", 6)
    click = deco.where(F.col("d.name").isin(r.words("cli_decorators"))).withColumn("given", F.coalesce(F.get("d.args", F.lit(0)), "name"))
    click = click.where(vocabulary("given", r).isNotNull() | vocabulary("name", r).isNotNull()).select("repo_id", "name", "symbol", "file", "line").distinct()
    clicks = _rows(click, "cli", "click_or_typer_command", 7)

    # 7 tasks
    tasks = task_table(code, r)
    job = deco.where(F.col("d.name").isin(r.words("task_decorators")) & vocabulary("name", r).isNotNull())
    job = job.select("repo_id", "name", "symbol", "file", "line", F.col("name").alias("short"), "decorators").dropDuplicates(["repo_id", "symbol"])
    when = schedules_of(code, job, tasks, schedules, r).select("repo_id", "symbol", F.lit(True).alias("_sched"))
    job = job.join(when, ["repo_id", "symbol"], "left")
    flags = F.array(F.lit("task_decorator"), F.when(F.col("_sched"), "schedule_registered").otherwise("unscheduled"))
    task_rows = _rows(job, "task", flags, 8)

    # 8 unclaimed functions
    free = s.where("owner IS NULL AND NOT nested").where(vocabulary("name", r).isNotNull())
    loose = _rows(free, "unknown", None, 10)
    found = stage_all([routes, rules_, viewsets, urls, delete_views, commands, clicks, task_rows, loose, admin_entry_points(code, stores, r)])
    admin = found.pop()
    found = union(found + [d(code) for d in detectors or []])
    # Detectors that claim a symbol keep it from later ones; several rows of one detector stay.
    first = found.where("symbol IS NOT NULL").groupBy("repo_id", "symbol").agg(F.min("ord").alias("_first"))
    # A viewset, delete view or command always registers, whoever claimed the symbol before.
    claims = F.col("symbol").isNull() | F.col("ord").isin(1, 3, 5, 6, 7) | (F.col("ord") == F.col("_first"))
    kept = found.join(first, ["repo_id", "symbol"], "left").where(claims).select(*COLUMNS)
    return stage(kept.unionByName(admin.select(*COLUMNS)).withColumn("node", F.concat(F.lit("entry:"), "name")).drop("ord").distinct())


def admin_entry_points(code: Code, stores: DataFrame, r: Rules) -> DataFrame:
    """Two entry points per repository over the registered models its admin may delete."""
    calls = code.calls.where(F.col("dotted").isin(r.words("admin_register_calls")) | (F.col("name") == "register"))
    regs = calls.where(F.size("args") > 0).select("repo_id", "module", F.get("args", F.lit(0))["value"].alias("written"), F.get("args", F.lit(1))["value"].alias("admin"), F.col("path").alias("file"), "line", F.lit(0).alias("o"))
    in_deco = lambda df, admin: df.select("repo_id", "module", admin.alias("admin"), "file", F.explode("decorators").alias("d")).where("d.name = 'register' AND size(d.args) > 0").select(
        "repo_id", "module", F.get("d.args", F.lit(0)).alias("written"), "admin", "file", F.col("d.line").alias("line"), F.lit(1).alias("o"))
    by_symbol = in_deco(code.symbols, null())
    by_class = in_deco(code.classes, F.col("name"))

    def resolved(df: DataFrame) -> DataFrame:
        return lookup(df.withColumn("head", head_of("written")).withColumn("scope", null()), code.imports).withColumn("model", dotted_of(F.col("written")))
    cites = resolved(union([regs, by_symbol])).select("repo_id", "model", "file", "line", "o")
    # The admin class registered for a model, by call or by decorator.
    called = lookup(resolved(regs.where("admin IS NOT NULL")).drop("head", "scope", "bind_kind", "bind_dotted").withColumn("head", head_of("admin")).withColumn("scope", null()), code.imports)
    called = called.withColumn("_d", dotted_of(F.col("admin"))).withColumn("_l", join_name(F.col("module"), F.col("admin")))
    pairs = union([called.select("repo_id", "model", F.col("_d").alias("admin"), F.lit(0).alias("o")), called.select("repo_id", "model", F.col("_l").alias("admin"), F.lit(1).alias("o")),
                   resolved(by_class).select("repo_id", "model", "admin", F.lit(2).alias("o"))])
    pairs = pairs.join(code.classes.select("repo_id", F.col("name").alias("admin")), ["repo_id", "admin"], "left_semi")
    admin_of = pairs.groupBy("repo_id", "model").agg(F.min_by("admin", "o").alias("admin"))
    perm = code.symbols.where("short = 'has_delete_permission'").select("repo_id", F.col("owner").alias("admin"), "file", "line", "end_line")
    body = perm.join(code.files.select("repo_id", F.col("path").alias("file"), "text"), ["repo_id", "file"])
    lines = F.transform(F.slice(F.split("text", "\n"), F.col("line"), F.col("end_line") - F.col("line") + 1), lambda x: F.trim(x))
    returns = F.filter(lines, lambda x: x.startswith("return"))
    denied = body.where((F.size(returns) == 1) & (F.get(returns, F.lit(0)) == "return False")).select("repo_id", "admin")
    denies = admin_of.join(denied, ["repo_id", "admin"], "left_semi").select("repo_id", "model")
    seen = stores.where("kind = 'relational' AND (guard <> '' OR linked)").select("repo_id", "model")
    ok = cites.join(seen, ["repo_id", "model"], "left_semi").join(denies, ["repo_id", "model"], "left_anti")
    per_repo = ok.groupBy("repo_id").agg(F.min(F.struct("o", "file", "line")).alias("c"), F.array_sort(F.collect_set("model")).alias("models"))
    each = per_repo.select("repo_id", "models", F.col("c.file").alias("file"), F.col("c.line").alias("line"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(m).alias("mode")) for n, m in r.rows("admin_entry_points")])).alias("e"))
    return _rows(each, "admin", "admin_registration", 9, name=F.col("e.name"), symbol=null(), admin_only=F.lit(True), sets_mode=F.col("e.mode"), models=F.col("models"))


def reconcile(declared: DataFrame, discovered: DataFrame, symbols: DataFrame, r: Rules, records: DataFrame | None = None) -> DataFrame:
    """Declared against discovered entry points, per record.

    `declared`: record_id, repo_id, name, file, line. `records`: record_id, repo_id of all records, so that
    one that declares nothing is told what it misses; without it only declaring records are known. Status: confirmed, unresolved,
    declared_only (something registers it), declared_unregistered (capped), missing.
    """
    by_name = discovered.select("repo_id", "name", "file", F.lit(True).alias("_hit")).distinct()
    d = declared.join(by_name, ["repo_id", "name", "file"], "left")
    spans = symbols.select("repo_id", F.col("short").alias("name"), "file", F.col("name").alias("symbol"), F.col("line").alias("lo"), F.col("end_line").alias("hi"), "decorators")
    inside = d.where("_hit IS NULL").join(spans, ["repo_id", "name", "file"]).where("line BETWEEN lo AND hi")
    marks = dict(r.rows("registering_decorators"))
    known = F.exists("decorators", lambda x: x["name"].isin(sorted(marks)))
    inside = inside.groupBy("record_id", "repo_id", "name", "file", "line").agg(
        F.min_by(F.struct("symbol", "lo", (known | F.col("file").contains("/management/commands/")).alias("reg")), "symbol").alias("s"))
    flagged = discovered.where("symbol IS NOT NULL AND size(flags) > 0").select("repo_id", F.col("symbol").alias("_sym"), F.lit(True).alias("_flag")).distinct()
    inside = inside.withColumn("_sym", F.col("s.symbol")).join(flagged, ["repo_id", "_sym"], "left")
    out = d.join(inside.select("record_id", "repo_id", "name", "file", "line", "s", "_flag"), ["record_id", "repo_id", "name", "file", "line"], "left")
    status = (F.when(F.col("_hit"), "confirmed").when(F.col("s").isNull(), "unresolved").when(F.col("s.reg") | F.col("_flag"), "declared_only").otherwise("declared_unregistered"))
    rows = out.select("record_id", "repo_id", "name", "file", "line", status.alias("status"), F.col("s.symbol").alias("symbol"))
    told = declared.select("record_id", "repo_id", "name", "file").distinct()
    per_record = (declared if records is None else records).select("record_id", "repo_id").distinct().join(discovered.select("repo_id", "name", "file", "line"), ["repo_id"])
    missing = per_record.join(told, ["record_id", "repo_id", "name", "file"], "left_anti").select(
        "record_id", "repo_id", "name", "file", "line", F.lit("missing").alias("status"), null().alias("symbol"))
    return rows.unionByName(missing)


def declared_starts(reconciled: DataFrame, discovered: DataFrame) -> DataFrame:
    """Declared entry points as further start nodes, the unregistered ones flagged for the cap."""
    new = reconciled.where(F.col("status").isin("declared_only", "declared_unregistered")).join(discovered.select("repo_id", "name"), ["repo_id", "name"], "left_anti")
    first = new.groupBy("record_id", "repo_id", "name").agg(F.min_by(F.struct("file", "line", "symbol", "status"), F.struct("file", "line")).alias("x"))
    return first.select("record_id", "repo_id", "name", F.lit("unknown").alias("kind"), "x.file", "x.line", "x.symbol", F.array("x.status").alias("flags"))
