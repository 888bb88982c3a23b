"""Reachability over a typed multigraph whose searches carry a delete mode.

The graph is two tables. A search is a loop of joins: one round extends every frontier of
every entry point of every repository at once, and each round's new states are written to
the checkpoint folder, so no plan grows with depth and a lost executor costs one re-read.

Edges: repo_id, src, dst, kind, file, line, rule, ambiguous, modes (array), sets_mode.
An edge with `hub` true points at a name rather than a node; `hubs` (repo_id, hub, dst)
lists the nodes behind the name. That keeps a call with many candidates one row, so calls
times candidates is never written out.
"""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datarights.session import bucketed, cut, stage

MODES = ["none", "model_delete", "queryset_delete", "db_cascade", "session_delete", "bulk_dml", "raw_sql"]
#: Edge kinds a search may follow before any primitive has set a mode.
ADMISSIBLE_IN_NONE = ["call", "entry", "SE10", "SE11", "SE12"]

EDGE_SCHEMA = ("repo_id string, src string, dst string, kind string, file string, line int, rule string, "
               "ambiguous boolean, modes array<string>, sets_mode string, hub boolean, note string")
STATE = ["repo_id", "entry", "node", "mode", "passed"]
ORDER = ["parent_rank", "dst", "kind", "file", "line", "rule"]


def all_modes():
    return F.array(*[F.lit(m) for m in MODES])


def mode_array(modes: list[str]):
    return F.array(*[F.lit(m) for m in modes])


def _extend(frontier: DataFrame, edges: DataFrame, hubs: DataFrame | None, targets: DataFrame | None) -> DataFrame:
    """Candidate next states of one round, the best incoming edge kept for each."""
    step = (frontier.select("repo_id", "entry", F.col("node").alias("src"), "mode", "passed",
                            F.col("rank").alias("parent_rank"))
            .join(edges, ["repo_id", "src"])
            .where(F.array_contains("modes", F.col("mode")))
            .where((F.col("mode") != "none") | F.col("kind").isin(ADMISSIBLE_IN_NONE))
            .withColumn("next_mode", F.coalesce("sets_mode", "mode"))
            .withColumn("parent", F.struct(F.col("src").alias("node"), "mode", "passed")))
    cols = ["repo_id", "entry", "dst", "next_mode", "passed", "parent_rank", "parent", "kind", "file", "line",
            "rule", "ambiguous", "note"]
    if hubs is None:
        step = step.select(*cols)
    else:
        # One row per (search, name) before the name is opened: the best call into it wins
        # for every node behind it, because those edges differ in nothing but the node.
        named = (step.where("hub").groupBy("repo_id", "entry", F.col("dst").alias("name"), "next_mode", "passed")
                 .agg(F.min(F.struct("parent_rank", "kind", "file", "line", "rule", "ambiguous", "note", "parent"))
                      .alias("e")))
        opened = (named.join(hubs.select("repo_id", F.col("hub").alias("name"), "dst"), ["repo_id", "name"])
                  .select("repo_id", "entry", "dst", "next_mode", "passed", "e.parent_rank", "e.parent", "e.kind",
                          "e.file", "e.line", "e.rule", "e.ambiguous", "e.note"))
        step = step.where("NOT hub").select(*cols).unionByName(opened)
    if targets is not None:
        hit = targets.select("repo_id", F.col("node").alias("dst"), F.lit(True).alias("_hit")).distinct()
        step = (step.join(hit, ["repo_id", "dst"], "left")
                .withColumn("passed", F.col("passed") | F.coalesce("_hit", F.lit(False))).drop("_hit"))
    best = F.min(F.struct(*ORDER, "ambiguous", "note", "parent")).alias("e")
    return (step.groupBy("repo_id", "entry", F.col("dst").alias("node"), F.col("next_mode").alias("mode"), "passed")
            .agg(best))


def reach(edges: DataFrame, starts: DataFrame, *, hubs: DataFrame | None = None, resolved_only: bool = False,
          blocked: DataFrame | None = None, must_pass: DataFrame | None = None,
          compact_every: int = 8) -> DataFrame:
    """Every (entry, node, mode) a search reaches, with depth and the edge that first got there.

    `starts`: repo_id, entry, node, mode. `blocked`: (repo_id, node) no search may
    enter, or (repo_id, entry, node) for one search. `must_pass`: (repo_id, node) of which a path has to visit one; states before that
    carry `passed` false. The first arrival wins, in the order of (parent, target, kind, file,
    line, rule), so equal inputs always give equal paths.
    """
    if "hub" not in edges.columns:
        edges = edges.withColumn("hub", F.lit(False))
    if "note" not in edges.columns:
        edges = edges.withColumn("note", F.lit(None).cast("string"))
    if resolved_only:
        edges, hubs = edges.where("NOT ambiguous AND NOT hub"), None
    edges = edges.repartition("repo_id", "src").persist()
    try:
        return _rounds(edges, starts, hubs, blocked, must_pass, compact_every)
    finally:
        edges.unpersist()


def _rounds(edges: DataFrame, starts: DataFrame, hubs: DataFrame | None, blocked: DataFrame | None, must_pass: DataFrame | None, compact_every: int) -> DataFrame:
    none = [F.lit(None).cast("string").alias(c) for c in ("kind", "file")]
    first = starts.select("repo_id", "entry", "node", "mode").distinct()
    if must_pass is None:
        first = first.withColumn("passed", F.lit(True))
    else:
        hit = must_pass.select("repo_id", "node", F.lit(True).alias("_hit")).distinct()
        first = (first.join(hit, ["repo_id", "node"], "left")
                 .withColumn("passed", F.coalesce("_hit", F.lit(False))).drop("_hit"))
    frontier = cut(first.orderBy("repo_id", "entry", "node").select(
        *STATE, F.lit(0).alias("depth"), F.monotonically_increasing_id().alias("rank"),
        F.lit(None).cast("struct<node:string,mode:string,passed:boolean>").alias("parent"),
        *none, F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("rule"),
        F.lit(False).alias("ambiguous"), F.lit(None).cast("string").alias("note")))
    visited, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        found = _extend(frontier, edges, hubs, must_pass)
        if blocked is not None:
            found = found.join(blocked, [c for c in ("repo_id", "entry", "node") if c in blocked.columns], "left_anti")
        fresh = found.join(visited.select(*STATE), STATE, "left_anti")
        # A range sort plus a position-based id orders a round of any size without
        # gathering one search in one task; only the order of the ids is used.
        frontier = cut(fresh.orderBy(*[F.col(f"e.{c}") for c in ORDER], "mode").select(
            *STATE, F.lit(depth).alias("depth"), F.monotonically_increasing_id().alias("rank"),
            "e.parent", "e.kind", "e.file", "e.line", "e.rule", "e.ambiguous", "e.note"))
        visited = visited.unionByName(frontier)
        if depth % compact_every == 0:
            visited = cut(visited)
    return visited


def _mode_bit(mode) -> Column:
    """The bit of a mode; a mode that is none of `MODES` is an error, as it would be lost."""
    known = F.coalesce(*[F.when(mode == m, F.lit(1 << i).cast("bigint")) for i, m in enumerate(MODES)])
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown mode "), mode)).cast("bigint"))


def reach_states(edges: DataFrame, starts: DataFrame, *, hubs: DataFrame | None = None, resolved_only: bool = False,
                 blocked: DataFrame | None = None, must_pass: DataFrame | None = None, compact_every: int = 8) -> DataFrame:
    """repo_id, entry, node, mode, passed, depth: the states and depths of `reach`, without the edges that led there.

    Where no path is shown, a search of a node is one row: its modes, before and after a node of `must_pass`, are
    bits of a number. So an edge is followed once for all states that come by in a round, candidates are
    added up before they are shuffled, and nothing is sorted but keys. Edges and rounds are written tables, whose
    shuffle files go at once. Arguments are those of `reach`.
    """
    n, width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(MODES)
    if "hub" not in edges.columns:
        edges = edges.withColumn("hub", F.lit(False))
    if resolved_only:
        edges, hubs = edges.where("NOT ambiguous AND NOT hub"), None
    elif hubs is None:
        edges = edges.withColumn("hub", F.lit(False))
    allowed = F.aggregate(F.transform("modes", _mode_bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    searched = F.when(F.col("kind").isin(ADMISSIBLE_IN_NONE), allowed).otherwise(allowed.bitwiseAND(F.lit(~(1 << MODES.index("none")))))
    sets = F.when(F.col("sets_mode").isNotNull(), _mode_bit(F.col("sets_mode")))
    steps = edges.select("repo_id", "src", "dst", "hub", sets.alias("_sets"), searched.alias("_allowed")).where("_allowed <> 0")
    keys = ["repo_id", "entry", "node"]
    hit = None if must_pass is None else must_pass.select("repo_id", "node", F.lit(True).alias("_hit")).distinct()
    bits = F.col("bits")

    def passed(found: DataFrame) -> DataFrame:
        if hit is None:
            return found
        over = F.shiftleft(bits, width).bitwiseOR(bits).bitwiseAND(F.lit(((1 << width) - 1) << width))
        return found.join(hit, ["repo_id", "node"], "left").withColumn("bits", F.when(F.col("_hit"), over).otherwise(bits)).drop("_hit")

    def moved(part: Column) -> Column:
        through = part.bitwiseAND(F.col("_allowed"))
        return F.when(through == 0, F.lit(0).cast("bigint")).otherwise(F.coalesce("_sets", through))

    with bucketed(steps, n, ["repo_id", "src"]) as table, ExitStack() as held:
        # added up and sorted within buckets, so that no round deals or sorts the edges anew
        links = table.groupBy("repo_id", "src", "dst", "hub", "_sets").agg(F.bit_or("_allowed").alias("_allowed")).sortWithinPartitions("repo_id", "src").persist()
        held.callback(links.unpersist)
        begin = F.bit_or(_mode_bit(F.col("mode")) if must_pass is not None else F.shiftleft(_mode_bit(F.col("mode")), width)).alias("bits")
        frontier = stage(passed(starts.groupBy(*keys).agg(begin)).withColumn("depth", F.lit(0)))
        visited, depth = frontier, 0
        while not frontier.isEmpty():
            depth += 1
            low, high = bits.bitwiseAND(F.lit((1 << width) - 1)), F.shiftright(bits, width)
            found = (frontier.select("repo_id", "entry", F.col("node").alias("src"), "bits").join(links, ["repo_id", "src"])
                     .select("repo_id", "entry", F.col("dst").alias("node"), "hub", moved(low).bitwiseOR(F.shiftleft(moved(high), width)).alias("bits")).where("bits <> 0"))
            if hubs is not None:
                named = found.where("hub").groupBy("repo_id", "entry", F.col("node").alias("hub")).agg(F.bit_or("bits").alias("bits"))
                opened = named.join(hubs.select("repo_id", "hub", F.col("dst").alias("node")), ["repo_id", "hub"])
                found = found.where("NOT hub").select(*keys, "bits").unionByName(opened.select(*keys, "bits"))
            if blocked is not None:
                found = found.groupBy(*keys).agg(F.bit_or("bits").alias("bits")).join(blocked, [c for c in keys if c in blocked.columns], "left_anti")
            found = passed(found.groupBy(*keys).agg(F.bit_or("bits").alias("bits")))
            seen = visited.groupBy(*keys).agg(F.bit_or("bits").alias("_seen"))
            fresh = found.join(seen, keys, "left").withColumn("bits", bits.bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("bigint"))))).where("bits <> 0")
            frontier = stage(fresh.select(*keys, "bits", F.lit(depth).alias("depth")))
            visited = visited.unionByName(frontier)
            if depth % compact_every == 0:
                visited = stage(visited)
    states = F.array(*[F.when(bits.bitwiseAND(F.lit(1 << (i + width * p))) != 0, F.struct(F.lit(m).alias("mode"), F.lit(bool(p)).alias("passed"))) for p in (0, 1) for i, m in enumerate(MODES)])
    return visited.select(*keys, F.inline(F.array_compact(states)), "depth").select(*STATE, "depth")


def first_paths(reached: DataFrame) -> DataFrame:
    """The state a node is credited with: its first arrival on any admissible path."""
    cols = [c for c in reached.columns if c not in ("repo_id", "entry", "node")]
    picked = F.min_by(F.struct(*cols), F.struct("depth", "rank")).alias("s")
    return (reached.where("passed").groupBy("repo_id", "entry", "node").agg(picked)
            .select("repo_id", "entry", "node", "s.*"))


def reach_two_pass(edges: DataFrame, starts: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Nodes reached over resolved edges, and those reached only through an ambiguous one."""
    least = lambda states, name: states.groupBy("repo_id", "entry", "node").agg(F.min("depth").alias(name))
    sure = least(reach_states(edges, starts, resolved_only=True), "sure_depth")
    loose = least(reach_states(edges, starts, hubs=hubs), "loose_depth")
    return (sure.join(loose, ["repo_id", "entry", "node"], "full_outer")
            .withColumn("only_ambiguous", F.col("sure_depth").isNull()))


def paths(reached: DataFrame, targets: DataFrame) -> DataFrame:
    """The cited steps from the entry to each target, rebuilt from parent pointers.

    `targets`: repo_id, entry, node. One row per step: repo_id, entry, target, step (1-based),
    src, dst, kind, file, line, rule, ambiguous, note.
    """
    states = cut(reached.select("repo_id", "entry", "node", "mode", "passed", "depth", "parent", "kind", "file",
                                "line", "rule", "ambiguous", "note"))
    winners = first_paths(reached).join(targets.select("repo_id", "entry", "node").distinct(),
                                        ["repo_id", "entry", "node"], "left_semi")
    at = cut(winners.select("repo_id", "entry", F.col("node").alias("target"), "node", "mode", "passed", "depth"))
    deepest = at.agg(F.max("depth")).first()[0] or 0
    out = None
    for _ in range(deepest):
        here = at.join(states.drop("depth"), ["repo_id", "entry", "node", "mode", "passed"]).where("parent IS NOT NULL")
        step = here.select("repo_id", "entry", "target", F.col("depth").alias("step"), F.col("parent.node").alias("src"),
                           F.col("node").alias("dst"), "kind", "file", "line", "rule", "ambiguous", "note")
        out = step if out is None else out.unionByName(step)
        at = cut(here.where("depth > 1").select(
            "repo_id", "entry", "target", F.col("parent.node").alias("node"), F.col("parent.mode").alias("mode"),
            F.col("parent.passed").alias("passed"), (F.col("depth") - 1).alias("depth")))
        if at.isEmpty():
            break
    if out is None:
        out = states.where("false").select("repo_id", "entry", F.col("node").alias("target"), F.col("depth").alias("step"),
                                           F.col("node").alias("src"), F.col("node").alias("dst"), "kind", "file",
                                           "line", "rule", "ambiguous", "note")
    return out


def closure(links: DataFrame, seeds: DataFrame, compact_every: int = 8) -> DataFrame:
    """Plain transitive closure. `links`: repo_id, src, dst; `seeds`: repo_id, entry, node.

    Returns repo_id, entry, node, depth; the seeds are depth 0.
    """
    links = links.select("repo_id", "src", "dst").distinct().repartition("repo_id", "src").persist()
    try:
        frontier = cut(seeds.select("repo_id", "entry", "node").distinct().withColumn("depth", F.lit(0)))
        visited, depth = frontier, 0
        while not frontier.isEmpty():
            depth += 1
            found = (frontier.select("repo_id", "entry", F.col("node").alias("src")).join(links, ["repo_id", "src"])
                     .select("repo_id", "entry", F.col("dst").alias("node")).distinct())
            frontier = cut(found.join(visited, ["repo_id", "entry", "node"], "left_anti").withColumn("depth", F.lit(depth)))
            visited = visited.unionByName(frontier)
            if depth % compact_every == 0:
                visited = cut(visited)
    finally:
        links.unpersist()
    return visited


def package_seeds(modules: DataFrame, packages: DataFrame) -> DataFrame:
    """`<package>.models` and `<package>.apps` of installed packages.

    Where no module matches a package exactly, modules that end in `.<package>` count instead
    (a `src/` layout); one level below the package and no deeper.
    `modules`: repo_id, module. `packages`: repo_id, package.
    """
    last = F.substring_index("module", ".", -1)
    head = F.when(F.instr("module", ".") > 0,
                  F.expr("substring(module, 1, length(module) - length(substring_index(module, '.', -1)) - 1)")).otherwise("")
    cand = modules.where(last.isin("models", "apps")).select("repo_id", "module", head.alias("package"))
    packages = packages.select("repo_id", "package").distinct()
    exact = cand.join(packages, ["repo_id", "package"], "left_semi")
    open_packages = packages.join(exact.select("repo_id", "package").distinct(), ["repo_id", "package"], "left_anti")
    # every proper dotted suffix of the head, so that "ends with" is an equality join
    parts = F.split("package", r"\.")
    suffixes = F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    loose = (cand.select("repo_id", "module", F.explode(suffixes).alias("package"))
             .join(open_packages, ["repo_id", "package"], "left_semi"))
    return exact.select("repo_id", "module").unionByName(loose.select("repo_id", "module")).distinct()
