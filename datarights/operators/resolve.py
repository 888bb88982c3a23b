"""Names, calls, bindings and constants resolved by joins, for every repository at once.

Rule priority is data (an ordinal or the order of a CASE), never plan order, so the optimizer
is free to reorder and broadcast as sizes suggest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datarights.operators.graph import all_modes
from datarights.session import cut, scratch_path, shuffles_removed, stage
from datarights.sources.rules import Rules, rules as default_rules

#: Callees whose target cannot be read off the source.
DYNAMIC = ["getattr", "eval", "exec", "globals", "locals", "__import__", "import_module"]
MODULE_CALLER = "<module>"


def head_of(column) -> Column:
    return F.substring_index(column, ".", 1)


def tail_of(column) -> Column:
    return F.substring_index(column, ".", -1)


def owner_path(column) -> Column:
    """`a.b.c` -> `a.b`; the empty string for a single name."""
    col = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.when(col.contains("."), F.regexp_extract(col, r"^(.*)\.[^.]*$", 1)).otherwise(""), "^$", "")


def join_name(module, name) -> Column:
    return F.when(F.coalesce(module, F.lit("")) == "", name).otherwise(F.concat(module, F.lit("."), name))


@dataclass
class Code:
    """The resolved tables of a code estate; every one carries repo_id."""

    modules: DataFrame
    files: DataFrame
    symbols: DataFrame
    classes: DataFrame
    class_assigns: DataFrame
    fields: DataFrame
    imports: DataFrame
    assigns: DataFrame
    name_refs: DataFrame
    raw_calls: DataFrame
    bases: DataFrame = None
    mro: DataFrame = None
    calls: DataFrame = None
    bindings: DataFrame = None
    constants: DataFrame = None
    extra: dict[str, DataFrame] = field(default_factory=dict)


# --- imports -------------------------------------------------------------------------------------------

def import_table(imports: DataFrame, symbols: DataFrame, classes: DataFrame, modules: DataFrame) -> DataFrame:
    """repo_id, module, scope (null: the module's own), local, kind, dotted: the binding that holds.

    A later import of a name replaces an earlier one; the bare package head that `import a.b`
    also binds gives way to any explicit binding.
    """
    picked = (imports.where("kind <> 'star'").groupBy("repo_id", "module", "scope", F.col("name").alias("local"))
              .agg(F.max_by("text", F.struct((F.col("kind") == "name").alias("explicit"), "path", "seq")).alias("dotted")))
    known = symbols.select("repo_id", F.col("name").alias("dotted")).unionByName(
        classes.select("repo_id", F.col("name").alias("dotted"))).distinct().withColumn("_s", F.lit(True))
    own = modules.select("repo_id", F.col("module").alias("dotted")).distinct().withColumn("_m", F.lit(True))
    out = picked.join(known, ["repo_id", "dotted"], "left").join(own, ["repo_id", "dotted"], "left")
    kind = F.when(F.col("_s"), "symbol").when(F.col("_m"), "module").otherwise("external")
    return out.select("repo_id", "module", "scope", "local", kind.alias("kind"), "dotted")


def lookup(uses: DataFrame, imports: DataFrame, head: str = "head", scope: str = "scope") -> DataFrame:
    """Adds `bind_kind`, `bind_dotted`: what `head` means in `scope` (innermost first), then in
    `module`. Distinct (module, scope, head) triples are looked up, not every use."""
    asked = uses.select("repo_id", "module", F.coalesce(F.col(scope), F.lit("")).alias("_scope_key"), F.col(head).alias("_head"))
    asked = asked.where("_head <> ''").distinct()
    parts = F.split("_scope_key", r"\.")
    chain = F.when(F.size(parts) >= 2, F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))
    local = imports.where("scope IS NOT NULL").select("repo_id", F.col("scope").alias("_at"), F.col("local").alias("_head"), "kind", "dotted")
    inner = (asked.select("*", F.explode(chain).alias("_at")).join(local, ["repo_id", "_at", "_head"])
             .groupBy("repo_id", "module", "_scope_key", "_head").agg(F.max_by(F.struct("kind", "dotted"), F.length("_at")).alias("_in")))
    outer = imports.where("scope IS NULL").select("repo_id", "module", F.col("local").alias("_head"), F.struct("kind", "dotted").alias("_out"))
    both = asked.join(inner, ["repo_id", "module", "_scope_key", "_head"], "left").join(outer, ["repo_id", "module", "_head"], "left")
    bound = both.select("repo_id", "module", "_scope_key", "_head", F.coalesce("_in", "_out").alias("_b")).where("_b IS NOT NULL")
    keyed = uses.withColumn("_scope_key", F.coalesce(F.col(scope), F.lit(""))).withColumn("_head", F.col(head))
    out = keyed.join(bound, ["repo_id", "module", "_scope_key", "_head"], "left")
    return (out.withColumn("bind_kind", F.col("_b.kind")).withColumn("bind_dotted", F.col("_b.dotted")).drop("_b", "_scope_key", "_head"))


def dotted_of(written: Column) -> Column:
    """`written` with its head replaced by what the head is bound to (after `lookup`)."""
    rest = F.substr(written, F.length(head_of(written)) + F.lit(1))
    return F.when(F.col("bind_dotted").isNotNull(), F.concat("bind_dotted", rest)).otherwise(written)


# --- classes -------------------------------------------------------------------------------------------

def class_bases(classes: DataFrame, imports: DataFrame) -> DataFrame:
    """repo_id, cls, ord, written, dotted, base (null outside the repository), via."""
    each = classes.select("repo_id", "module", F.col("name").alias("cls"), F.posexplode("names").alias("ord", "written"))
    each = lookup(each.withColumn("head", head_of("written")).withColumn("scope", F.lit(None).cast("string")), imports)
    each = each.withColumn("dotted", dotted_of(F.col("written"))).withColumn("local", join_name(F.col("module"), F.col("written")))
    names = classes.select("repo_id", F.col("name").alias("base"), "short").distinct()
    by_import = each.join(names.select("repo_id", F.col("base").alias("dotted"), F.lit(True).alias("_i")), ["repo_id", "dotted"], "left")
    both = by_import.join(names.select("repo_id", F.col("base").alias("local"), F.lit(True).alias("_l")), ["repo_id", "local"], "left")
    picks = F.array_compact(F.array(F.when(F.col("_i"), F.struct(F.col("dotted").alias("base"), F.lit("imported").alias("via"))),
                                    F.when(F.col("_l") & ~(F.coalesce("_i", F.lit(False)) & (F.col("local") == F.col("dotted"))),
                                           F.struct(F.col("local").alias("base"), F.lit("local").alias("via")))))
    found = both.withColumn("_p", picks)
    sure = found.where(F.size("_p") > 0).select("repo_id", "cls", "ord", "written", "dotted", F.posexplode("_p").alias("sub", "_b"))
    sure = sure.select("repo_id", "cls", "ord", "sub", "written", "dotted", "_b.base", "_b.via")
    rest = found.where(F.size("_p") == 0).select("repo_id", "cls", "ord", "written", "dotted", tail_of("written").alias("short"))
    guess = rest.join(names, ["repo_id", "short"], "left").select(
        "repo_id", "cls", "ord", F.lit(0).alias("sub"), "written", "dotted", "base", F.when(F.col("base").isNotNull(), "short").alias("via"))
    return sure.unionByName(guess)


def linearise(classes: DataFrame, bases: DataFrame) -> DataFrame:
    """repo_id, cls, ancestor, path, imported, named, named_path: every class reached through bases, once.

    `path` is the first way there, depth first and left to right; the class itself has the empty path.
    `imported` says that some way has imported names only, `named` that some way has no short-name guess,
    `named_path` is the first of those. A class is settled once, after its bases: of two ways to an ancestor
    the first is that by the first base, so a class puts its step before the ways of its bases. Ways are
    held as ranks of steps, four bytes each, and spelled at the end. What a depth shuffled goes when its ways
    are written. Classes that reach a circle are settled by rounds.
    """
    spark, names = classes.sparkSession, classes.select("repo_id", F.col("name").alias("cls")).distinct()
    steps = bases.where("base IS NOT NULL").select("repo_id", "cls", "base", "via", "ord", "sub", F.concat(
        F.lpad(F.col("ord").cast("string"), 10, "0"), F.lit("-"), F.lpad(F.col("sub").cast("string"), 10, "0"), F.lit("-"), "base", F.lit("/")).alias("step"))
    steps = cut(steps.withColumn("rank", F.dense_rank().over(Window.partitionBy("repo_id", "cls").orderBy("step"))))
    depths, circular = _depths(cut(names.unionByName(steps.select("repo_id", F.col("base").alias("cls"))).distinct()), steps)
    of_base = depths.select("repo_id", F.col("cls").alias("base"), F.col("depth").alias("below"))
    edges = stage(steps.drop("step").join(depths, ["repo_id", "cls"]).join(of_base, ["repo_id", "base"]), ["depth"])
    below = edges.groupBy("depth").agg(F.collect_set("below").alias("at"))
    folder, at = scratch_path(spark, "ways"), {r["depth"]: sorted(r["at"]) for r in below.collect()}
    way = "struct<code: binary, ord: int, sub: int>"
    schema = f"repo_id string, cls string, ancestor string, any {way}, named {way}, imported boolean"
    read = lambda levels: spark.read.schema(schema).parquet(*[f"{folder}/{n}" for n in levels]).hint("merge")
    start = F.struct(F.lit(b"").alias("code"), F.lit(0).alias("ord"), F.lit(0).alias("sub"))
    own = depths.select("repo_id", "cls", F.col("cls").alias("ancestor"), start.alias("any"), start.alias("named"), F.lit(True).alias("imported"), "depth")
    levels = [r["depth"] for r in depths.select("depth").distinct().orderBy("depth").collect()]

    def through(kind: str) -> Column:
        first = F.col(f"{kind}.code") == F.lit(b"")
        code = F.concat(F.unhex(F.lpad(F.hex("rank"), 8, "0")), F.col(f"{kind}.code"))
        made = F.struct(code.alias("code"), F.when(first, F.col("ord")).otherwise(F.col(f"{kind}.ord")).alias("ord"), F.when(first, F.col("sub")).otherwise(F.col(f"{kind}.sub")).alias("sub"))
        return F.when(F.col(f"{kind}.code").isNotNull(), made)
    for n in levels:
        found = own.where(F.col("depth") == n).drop("depth")
        if n in at:
            came = edges.where(F.col("depth") == n).join(read(at[n]).withColumnRenamed("cls", "base"), ["repo_id", "base"]).select(
                "repo_id", "cls", "ancestor", through("any").alias("any"), F.when(F.col("via") != "short", through("named")).alias("named"),
                ((F.col("via") == "imported") & F.col("imported")).alias("imported"))
            found = came.groupBy("repo_id", "cls", "ancestor").agg(F.min("any").alias("any"), F.min("named").alias("named"), F.max("imported").alias("imported")).unionByName(found)
        with shuffles_removed(spark):
            found.write.parquet(f"{folder}/{n}")
    out = _by_rounds(circular, steps)
    if levels:
        ways = read(levels).repartition("repo_id", "cls").sortWithinPartitions("repo_id", "cls")
        spelled = ways.select("repo_id", "cls", "ancestor", "any.*", "imported", F.col("named.code").alias("ncode"), F.col("named.ord").alias("nord"), F.col("named.sub").alias("nsub"))
        out = spelled.mapInArrow(_spell, WAYS).unionByName(out)
    foreign = cut(steps.select("repo_id", F.col("base").alias("cls")).distinct().join(names, ["repo_id", "cls"], "left_anti"))
    return out if foreign.isEmpty() else out.join(foreign, ["repo_id", "cls"], "left_anti")


def _depths(nodes: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """repo_id, cls, depth (steps of the longest way down), and the classes that reach a circle, which have none."""
    edges, left = stage(steps.select("repo_id", "cls", "base").distinct()), nodes
    found, n = [left.withColumn("depth", F.lit(0))], left.count()
    while n:
        left = cut(edges.join(left.withColumnRenamed("cls", "base"), ["repo_id", "base"], "left_semi").select("repo_id", "cls").distinct())
        before, n = n, left.count()
        if n == before:
            break
        found.append(left.withColumn("depth", F.lit(len(found))))
    depths = reduce(DataFrame.unionByName, found).groupBy("repo_id", "cls").agg(F.max("depth").alias("depth"))
    return stage(depths.join(left, ["repo_id", "cls"], "left_anti")), left


WAYS = "repo_id string, cls string, ancestor string, path string, imported boolean, named boolean, named_path string"


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of steps to paths, class by class: a way without its last step is the way to another ancestor of the class."""
    def spelled(rows: list[tuple], at: int) -> list[str | None]:
        known: dict[bytes, str] = {b"": ""}
        for row in sorted((r for r in rows if r[at]), key=lambda r: len(r[at])):
            known[row[at]] = f"{known[row[at][:-4]]}{row[at + 1]:010d}-{row[at + 2]:010d}-{row[2]}/"
        return [None if r[at] is None else known[r[at]] for r in rows]

    def of_class(rows: list[tuple]) -> Iterator[tuple]:
        for r, path, named in zip(rows, spelled(rows, 3), spelled(rows, 7)):
            yield r[0], r[1], r[2], path, r[6], named is not None, named

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.bool_()] * 2 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in WAYS.split(", ")])
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    ready: list[tuple] = []
    for _, held in groupby(rows, key=lambda r: r[:2]):
        ready.extend(of_class(list(held)))
        if len(ready) >= 10_000:
            yield out(ready)
            ready = []
    if ready:
        yield out(ready)


def _by_rounds(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """The same for `nodes`, which may stand in circles: only ancestors whose way got better in a round are followed."""
    keys = ["repo_id", "kind", "cls", "ancestor"]
    step = steps.select("repo_id", F.col("cls").alias("ancestor"), "base", "via", "step")
    kinds = F.explode(F.array(F.lit("any"), F.lit("named"), F.lit("imported"))).alias("kind")
    allowed = (F.col("kind") == "any") | ((F.col("kind") == "named") & (F.col("via") != "short")) | (F.col("via") == F.col("kind"))
    best = better = cut(nodes.select("repo_id", kinds, "cls", F.col("cls").alias("ancestor"), F.lit("").alias("path")))
    while not better.isEmpty():
        found = better.join(step, ["repo_id", "ancestor"]).where(allowed).select("repo_id", "kind", "cls", F.col("base").alias("ancestor"), F.concat("path", "step").alias("path"))
        found = found.groupBy(*keys).agg(F.min("path").alias("path"))
        better = cut(found.join(best.withColumnRenamed("path", "_old"), keys, "left").where("_old IS NULL OR path < _old").drop("_old"))
        best = cut(best.unionByName(better).groupBy(*keys).agg(F.min("path").alias("path")))
    way = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("path")))
    return best.groupBy("repo_id", "cls", "ancestor").agg(way("any").alias("path"), way("imported").isNotNull().alias("imported"), way("named").isNotNull().alias("named"), way("named").alias("named_path"))


def find_methods(asked: DataFrame, mro: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo_id, cls, attr, own (false: bases only) -> `method`, the first in base order."""
    names = symbols.select("repo_id", F.col("name").alias("method"))
    cand = asked.distinct().join(mro.select("repo_id", "cls", "ancestor", "path"), ["repo_id", "cls"])
    cand = cand.where(F.col("own") | (F.col("path") != "")).withColumn("method", F.concat_ws(".", "ancestor", "attr"))
    return (cand.join(names, ["repo_id", "method"]).groupBy("repo_id", "cls", "attr", "own").agg(F.min_by("method", "path").alias("method")))


# --- calls ---------------------------------------------------------------------------------------------

def resolve_calls(code: Code) -> DataFrame:
    """Each call resolved, ambiguous or unresolved, with the rule that said so.

    A resolved call has one `target`. An ambiguous one has a `target` where one candidate
    is left, else a `hub` standing for all nodes of that short name, and `n_candidates`.
    """
    symbols, classes = code.symbols, code.classes
    module_level = F.col("caller") == join_name(F.col("module"), F.lit(MODULE_CALLER))
    calls = code.raw_calls.withColumn("scope", F.when(~module_level, F.col("caller")))
    owner = symbols.select("repo_id", F.col("name").alias("caller"), F.col("owner"))
    calls = calls.join(owner, ["repo_id", "caller"], "left")
    calls = calls.withColumn("head", F.when(F.col("form") == "name", F.col("name")).otherwise(head_of("receiver")))
    calls = lookup(calls, code.imports).withColumn("_dotted", dotted_of(F.col("dotted")))
    calls = calls.withColumn("_local", join_name(F.col("module"), F.col("name")))
    class_names = classes.select("repo_id", F.col("name").alias("bind_dotted"), F.lit(True).alias("_is_class")).distinct()
    calls = calls.join(class_names, ["repo_id", "bind_dotted"], "left")
    is_class_call = (F.col("bind_kind") == "symbol") & F.col("_is_class") & (F.col("receiver") == F.col("head"))
    self_call = F.col("receiver").isin("self", "cls") & F.col("owner").isNotNull()
    super_call = F.col("receiver").startswith("super()")
    ask = (F.when(F.col("form") == "name", F.struct(F.col("owner").alias("cls"), F.lit(True).alias("own")))
           .when(self_call, F.struct(F.col("owner").alias("cls"), F.lit(True).alias("own")))
           .when(super_call, F.struct(F.col("owner").alias("cls"), F.lit(False).alias("own")))
           .when(is_class_call, F.struct(F.col("bind_dotted").alias("cls"), F.lit(True).alias("own"))))
    calls = calls.withColumn("_ask", ask).withColumn("_cls", F.col("_ask.cls")).withColumn("_own", F.col("_ask.own"))
    asked = calls.where("_cls IS NOT NULL").select("repo_id", F.col("_cls").alias("cls"), F.col("name").alias("attr"), F.col("_own").alias("own"))
    methods = find_methods(asked, code.mro, symbols).select(
        "repo_id", F.col("cls").alias("_cls"), F.col("attr").alias("name"), F.col("own").alias("_own"), "method")
    calls = calls.join(methods, ["repo_id", "_cls", "name", "_own"], "left")
    named = symbols.select("repo_id", F.col("name").alias("_n"), F.lit(True).alias("_k"))
    calls = calls.join(named.select("repo_id", F.col("_n").alias("_local"), F.col("_k").alias("_has_local")), ["repo_id", "_local"], "left")
    calls = calls.join(named.select("repo_id", F.col("_n").alias("_dotted"), F.col("_k").alias("_has_dotted")), ["repo_id", "_dotted"], "left")
    shorts = symbols.groupBy("repo_id", F.col("short").alias("name")).agg(F.count("*").alias("n_candidates"), F.min("name").alias("_sole"))
    shorts = shorts.select("repo_id", F.col("name"), "n_candidates", "_sole")
    calls = calls.join(shorts, ["repo_id", "name"], "left").fillna(0, ["n_candidates"])
    star = code.extra["stars"].select("repo_id", "module", F.lit(True).alias("_star")).distinct()
    calls = calls.join(star, ["repo_id", "module"], "left")
    outside = code.bases.where("base IS NULL").select("repo_id", F.col("cls").alias("owner"), F.lit(True).alias("_outside")).distinct()
    calls = calls.join(outside, ["repo_id", "owner"], "left")

    def say(outcome: str, rule, target=None, reason: str | None = None) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"),
                        (target if target is not None else F.lit(None).cast("string")).alias("target"), F.lit(reason).cast("string").alias("reason"))
    n, sole, method = F.col("n_candidates"), F.col("_sole"), F.col("method")
    one_name = F.when(F.col("_star"), "CG-20").otherwise("CG-3")
    many_name = F.when(F.col("_star"), "CG-20").otherwise("CG-4")
    name_form = (
        F.when(F.col("bind_kind") == "symbol", say("resolved", "CG-1", F.col("bind_dotted")))
        .when(F.col("bind_kind") == "external", say("unresolved", "CG-5", reason="external"))
        .when(method.isNotNull(), say("resolved", "CG-2", method))
        .when(F.col("_has_local"), say("resolved", "CG-2", F.col("_local")))
        .when(n == 1, say("resolved", one_name, sole, "short_name"))
        .when(n > 1, say("ambiguous", many_name, reason="name_shared"))
        .otherwise(say("unresolved", "CG-5", reason="name_undefined")))
    self_rule = F.when(F.col("receiver") == "self", "CG-8").otherwise("CG-9")
    attr_form = (
        F.when(self_call & method.isNotNull(), say("resolved", self_rule, method))
        .when(self_call & F.col("_outside"), say("ambiguous", self_rule, reason="base_outside"))
        .when(self_call, say("unresolved", self_rule, reason="self_undefined"))
        .when(super_call & method.isNotNull(), say("resolved", "CG-10", method))
        .when(super_call, say("unresolved", "CG-10", reason="super_undefined"))
        .when((F.col("bind_kind") == "module") & F.col("_has_dotted"), say("resolved", "CG-6", F.col("_dotted")))
        .when(is_class_call & method.isNotNull(), say("resolved", "CG-6", method))
        .when(F.col("bind_kind") == "external", say("unresolved", "CG-7", reason="external"))
        .when(n == 1, say("ambiguous", "CG-11", sole, "receiver_open"))
        .when(n > 1, say("ambiguous", "CG-11", reason="receiver_open"))
        .otherwise(say("unresolved", "CG-11", reason="attribute_undefined")))
    verdict = (F.when(F.col("name").isin(DYNAMIC) | F.col("receiver").endswith("importlib"), say("unresolved", "CG-12", reason="dynamic"))
               .when(F.col("form") == "name", name_form).when(F.col("form") == "attribute", attr_form)
               .otherwise(say("unresolved", "CG-5", reason="callee_computed")))
    calls = calls.withColumn("_v", verdict).withColumn("target", F.col("_v.target"))
    twice = code.extra["redefined"].select("repo_id", F.col("name").alias("target"), F.lit(True).alias("_twice"))
    calls = calls.join(twice, ["repo_id", "target"], "left")
    outcome = F.when((F.col("_v.outcome") == "resolved") & F.col("_twice"), "ambiguous").otherwise(F.col("_v.outcome"))
    hub = F.when((outcome == "ambiguous") & F.col("target").isNull() & (n > 1), F.concat(F.lit("hub:"), "name"))
    reason = F.when((F.col("_v.outcome") == "resolved") & F.col("_twice"), "defined_twice").otherwise(F.col("_v.reason"))
    keep = ["repo_id", "call_id", "path", "module", "caller", "scope", "owner", "form", "name", "receiver", "dotted", "args", "kw", "line",
            "bind_kind", "bind_dotted"]
    return calls.select(*keep, outcome.alias("outcome"), F.col("_v.rule").alias("rule"), "target", hub.alias("hub"),
                        F.when(hub.isNotNull(), n).otherwise(F.col("target").isNotNull().cast("bigint")).alias("n_candidates"), reason.alias("reason"))


def call_edges(calls: DataFrame) -> DataFrame:
    found = calls.where("outcome IN ('resolved', 'ambiguous') AND (target IS NOT NULL OR hub IS NOT NULL)")
    return found.select(
        "repo_id", F.col("caller").alias("src"), F.coalesce("target", "hub").alias("dst"), F.lit("call").alias("kind"), F.col("path").alias("file"),
        "line", "rule", (F.col("outcome") == "ambiguous").alias("ambiguous"), all_modes().alias("modes"), F.lit(None).cast("string").alias("sets_mode"),
        F.col("hub").isNotNull().alias("hub"), F.lit("").alias("note"))


def hub_members(symbols: DataFrame) -> DataFrame:
    return symbols.select("repo_id", F.concat(F.lit("hub:"), "short").alias("hub"), F.col("name").alias("dst"))


# --- bindings and constants ----------------------------------------------------------------------------

def bind_models(code: Code) -> DataFrame:
    """repo_id, symbol, var, model: a local name whose assignment mentions exactly one model.

    The last such assignment of a name wins.
    """
    names = code.classes.select("repo_id", F.col("name").alias("model")).distinct()
    each = code.assigns.where("scope IS NOT NULL AND NOT contains(target, '.')").select(
        "repo_id", "module", "scope", "path", "seq", "target", F.explode("refs").alias("ref"))
    each = lookup(each.withColumn("head", F.col("ref")), code.imports)
    each = each.withColumn("_local", join_name(F.col("module"), F.col("ref")))
    hit = each.join(names.withColumnRenamed("model", "bind_dotted").withColumn("_m", F.col("bind_dotted")), ["repo_id", "bind_dotted"], "left")
    hit = hit.join(names.withColumnRenamed("model", "_local").withColumn("_ml", F.col("_local")), ["repo_id", "_local"], "left")
    hit = hit.withColumn("model", F.coalesce(F.when(F.col("bind_kind") == "symbol", F.col("_m")), "_ml")).where("model IS NOT NULL")
    one = (hit.groupBy("repo_id", "scope", "path", "seq", "target").agg(F.count_distinct("model").alias("_n"), F.min("model").alias("model")).where("_n = 1"))
    return (one.groupBy("repo_id", F.col("scope").alias("symbol"), F.col("target").alias("var"))
            .agg(F.max_by("model", F.struct("path", "seq")).alias("model")))


def propagate_bindings(bindings: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bindings carried over resolved calls into the callee's parameters, call by call to the end.

    What a call hands over replaces what the parameter was bound to. A round takes only names whose
    binding just changed; a (symbol, name, model) that was there before is not taken up again, so
    cycles of calls come to rest.
    """
    params = symbols.select("repo_id", F.col("name").alias("target"), F.filter("args", lambda a: ~a.isin("self", "instance")).alias("_params"))
    passed = (calls.where("outcome = 'resolved' AND target IS NOT NULL").select(
        "repo_id", F.col("caller").alias("symbol"), "target", "path", "line", "dotted", F.posexplode("args").alias("i", "a")).where("a.kind = 'name'"))
    passed = passed.join(params, ["repo_id", "target"]).where(F.col("i") < F.size("_params")).select(
        "repo_id", "symbol", F.col("a.value").alias("var"), "target", F.get("_params", F.col("i")).alias("param"), "path", "line", "dotted")
    passed = cut(passed.distinct())
    key = ["repo_id", "symbol", "var"]
    table = cut(bindings.select(*key, "model"))
    seen = changed = table
    while True:
        reached = passed.join(changed.select(*key), key).select("repo_id", F.col("target").alias("symbol"), F.col("param").alias("var")).distinct()
        sent = passed.join(table, key).select("repo_id", F.col("target").alias("symbol"), F.col("param").alias("var"), "model", F.struct("path", "line", "dotted").alias("at"))
        sent = sent.join(reached, key, "left_semi").groupBy(*key).agg(F.max_by("model", "at").alias("model"))
        changed = cut(sent.join(seen, [*key, "model"], "left_anti"))
        if changed.isEmpty():
            return table
        seen = cut(seen.unionByName(changed))
        table = cut(table.join(changed.select(*key), key, "left_anti").unionByName(changed))


def constant_table(code: Code) -> DataFrame:
    """repo_id, module, name, value, file, line: module-level constants, the last one standing."""
    a = code.assigns.where("scope IS NULL AND NOT contains(target, '.')").where(
        F.col("value_kind").isin("literal", "fstring") | ((F.col("value_kind") == "sequence") & (F.size("keys") > 0)))
    value = F.when(F.col("value_kind") == "sequence", F.array_join("keys", "|")).otherwise(F.col("value"))
    last = F.max_by(F.struct(value.alias("value"), F.col("path").alias("file"), "line"), "seq").alias("c")
    return a.groupBy("repo_id", "module", F.col("target").alias("name")).agg(last).select("repo_id", "module", "name", "c.*")


def resolve_constants(uses: DataFrame, code: Code) -> DataFrame:
    """Adds const_value, const_file, const_line for the name in `written`, read from `module`.

    A qualified name is read in the module it names; a bare name here first, then in the
    module it is imported from.
    """
    uses = lookup(uses.withColumn("head", head_of("written")).withColumn("scope", F.lit(None).cast("string")), code.imports)
    owner = F.when(F.col("bind_kind") == "module", F.col("bind_dotted")).when(F.col("bind_kind").isNotNull(), owner_path("bind_dotted"))
    mods = code.modules.select("repo_id", F.col("module").alias("_owner"), F.lit(True).alias("_known")).distinct()
    uses = uses.withColumn("_owner", owner).join(mods, ["repo_id", "_owner"], "left").withColumn("_owner", F.when(F.col("_known"), F.col("_owner")))
    consts = code.constants.select("repo_id", "module", F.col("name").alias("_tail"), F.struct("value", "file", "line").alias("_c"))
    uses = uses.withColumn("_tail", tail_of("written"))
    uses = uses.join(consts.withColumnRenamed("_c", "_here"), ["repo_id", "module", "_tail"], "left")
    there = consts.select("repo_id", F.col("module").alias("_owner"), "_tail", F.col("_c").alias("_there"))
    uses = uses.join(there, ["repo_id", "_owner", "_tail"], "left")
    qualified = F.col("written").contains(".")
    pick = (F.when(qualified & F.col("_owner").isNotNull(), F.col("_there")).when(qualified, F.col("_here")).otherwise(F.coalesce("_here", "_there")))
    return uses.withColumn("_k", pick).withColumns({"const_value": F.col("_k.value"), "const_file": F.col("_k.file"), "const_line": F.col("_k.line")}).drop(
        "_k", "_here", "_there", "_owner", "_known", "_tail", "bind_kind", "bind_dotted", "head", "scope")


def model_of(uses: DataFrame, code: Code, bindings: DataFrame | None = None) -> DataFrame:
    """Adds `model`: the class a written name stands for inside `caller`.

    A bound variable first, then `self` in a method, then an imported or local class. `uses`:
    repo_id, module, caller, owner, written.
    """
    bindings = code.bindings if bindings is None else bindings
    asked = uses.select("repo_id", "module", "caller", "owner", head_of("written").alias("head")).where("head <> ''").distinct()
    asked = lookup(asked.withColumn("scope", F.lit(None).cast("string")), code.imports)
    var = bindings.select("repo_id", F.col("symbol").alias("caller"), F.col("var").alias("head"), F.col("model").alias("_v"))
    names = code.classes.select("repo_id", F.col("name").alias("_n")).distinct()
    asked = asked.withColumn("_d", F.coalesce("bind_dotted", "head")).withColumn("_l", join_name(F.col("module"), F.col("head")))
    asked = asked.join(var, ["repo_id", "caller", "head"], "left")
    asked = asked.join(names.select("repo_id", F.col("_n").alias("_d"), F.lit(True).alias("_hd")), ["repo_id", "_d"], "left")
    asked = asked.join(names.select("repo_id", F.col("_n").alias("_l"), F.lit(True).alias("_hl")), ["repo_id", "_l"], "left")
    model = F.coalesce("_v", F.when(F.col("head").isin("self", "cls"), F.col("owner")), F.when(F.col("_hd"), F.col("_d")), F.when(F.col("_hl"), F.col("_l")))
    found = asked.select("repo_id", "caller", "module", "head", model.alias("model")).where("model IS NOT NULL")
    return uses.withColumn("head", head_of("written")).join(found, ["repo_id", "caller", "module", "head"], "left").drop("head")


def references(code: Code) -> DataFrame:
    """Callables named as arguments: repo_id, caller, target, file, line. Never edges."""
    module_level = F.col("caller") == join_name(F.col("module"), F.lit(MODULE_CALLER))
    refs = code.name_refs.withColumn("scope", F.when(~module_level, F.col("caller"))).withColumn("head", F.col("name"))
    refs = lookup(refs, code.imports).withColumn("_local", join_name(F.col("module"), F.col("name")))
    names = code.symbols.select("repo_id", F.col("name").alias("_n"), F.lit(True).alias("_k"))
    refs = refs.join(names.select("repo_id", F.col("_n").alias("bind_dotted"), F.col("_k").alias("_bound")), ["repo_id", "bind_dotted"], "left")
    refs = refs.join(names.select("repo_id", F.col("_n").alias("_local"), F.col("_k").alias("_here")), ["repo_id", "_local"], "left")
    shorts = code.symbols.groupBy("repo_id", F.col("short").alias("name")).agg(F.count("*").alias("_n"), F.min("name").alias("_sole")).select("repo_id", F.col("name"), "_n", "_sole")
    refs = refs.join(shorts, ["repo_id", "name"], "left")
    target = F.coalesce(F.when((F.col("bind_kind") == "symbol") & F.col("_bound"), F.col("bind_dotted")), F.when(F.col("_here"), F.col("_local")),
                        F.when(F.col("_n") == 1, F.col("_sole")))
    return refs.select("repo_id", "caller", target.alias("target"), F.col("path").alias("file"), "line").where("target IS NOT NULL").distinct()


def unmodelled(symbols: DataFrame, r: Rules) -> DataFrame:
    """Symbols wrapped by a decorator the rules do not model."""
    each = symbols.select("repo_id", F.col("name").alias("symbol"), "file", "line", F.explode("decorators").alias("d"))
    return each.where(~F.col("d.name").isin(r.words("modelled_decorators"))).select("repo_id", "symbol", "file", "line").distinct()


# --- all of it -------------------------------------------------------------------------------------------

def resolve(facts: dict[str, DataFrame], files: DataFrame, r: Rules | None = None) -> Code:
    """From raw facts to resolved tables; what later stages share is written once."""
    r = r or default_rules()
    defs = facts["symbol"].select("repo_id", "module", "path", "seq", "name", "short", "kind", "owner", "line", "end_line", "nested",
                                  F.col("names").alias("args"), "decorators")
    cols = ["module", "path", "short", "kind", "owner", "line", "end_line", "nested", "args", "decorators"]
    symbols = defs.groupBy("repo_id", "name").agg(F.max_by(F.struct(*cols), F.struct("path", "seq")).alias("s"), F.count("*").alias("n_defs"))
    symbols = stage(symbols.select("repo_id", "name", "s.*", "n_defs").withColumnRenamed("path", "file"))
    cdefs = facts["class"].select("repo_id", "module", "path", "seq", "name", "short", "line", "end_line", "names", "decorators", "raw_kw")
    ccols = ["module", "path", "short", "line", "end_line", "names", "decorators", "raw_kw"]
    classes = cdefs.groupBy("repo_id", "name").agg(F.max_by(F.struct(*ccols), F.struct("path", "seq")).alias("c"), F.count("*").alias("n_defs"))
    classes = stage(classes.select("repo_id", "name", "c.*", "n_defs").withColumnRenamed("path", "file"))
    modules = facts["module"].select("repo_id", "module", "path")
    imports = stage(import_table(facts["import"], symbols, classes, modules))
    code = Code(
        modules=modules, files=files, symbols=symbols, classes=classes, imports=imports,
        class_assigns=facts["class_assign"].select("repo_id", "owner", "seq", "line", F.col("name").alias("target"), F.col("kind").alias("value_kind"),
                                                   F.col("text").alias("value"), F.col("names").alias("refs"), "keys"),
        fields=facts["field"].select("repo_id", "path", "owner", "seq", "parent", F.col("name").alias("target"), F.col("text").alias("call"), "line",
                                     "args", "kw", F.col("names").alias("raw"), "raw_kw"),
        assigns=facts["assign"].select("repo_id", "path", "module", "scope", "seq", "line", F.col("name").alias("target"), F.col("kind").alias("value_kind"),
                                       F.col("text").alias("value"), F.col("names").alias("refs"), "keys"),
        name_refs=facts["name_ref"].select("repo_id", "path", "module", F.col("scope").alias("caller"), "name", "line"),
        raw_calls=facts["call"].select("repo_id", F.concat_ws("#", "path", "seq").alias("call_id"), "path", "module", F.col("scope").alias("caller"),
                                       F.col("kind").alias("form"), "name", "receiver", F.col("text").alias("dotted"), "args", "kw", "line"))
    code.extra["stars"] = facts["import"].where("kind = 'star'").select("repo_id", "module").distinct()
    code.extra["redefined"] = (symbols.where("n_defs > 1").select("repo_id", "name").unionByName(classes.where("n_defs > 1").select("repo_id", "name")).distinct())
    code.extra["errors"] = facts["error"].select("repo_id", F.col("path").alias("file"), F.col("text").alias("error"))
    code.bases = stage(class_bases(classes, imports))
    code.mro = stage(linearise(classes, code.bases))
    code.calls = stage(resolve_calls(code))
    code.bindings = stage(bind_models(code))
    code.constants = stage(constant_table(code))
    return code
