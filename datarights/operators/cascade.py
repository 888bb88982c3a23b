"""Row-level erasure: follow declared relations through warehouse tables.

Given the rows of the subjects to erase, say for every store how many rows a delete would
erase, set to null, keep because a child protects its parent, or leave pointing at them.
Only key columns are read; keys move between stores as joins and never reach the driver.

Stores go in groups: those that point at each other in a circle, or a store that points at itself,
are one group. Between groups a pass is one join per relation. Inside a group it is a search that only
follows the rows found last, whose keys are written after each round.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.session import stage

CASCADES = {"CASCADE", "DB_CASCADE"}
HOLDS = {"PROTECT", "RESTRICT"}
NULLS = {"SET_NULL", "SET_DEFAULT", "DB_SET_NULL", "DB_SET_DEFAULT", "SET"}


@dataclass(frozen=True)
class Relation:
    parent: str
    child: str
    parent_key: str
    child_key: str
    token: str


def _reach(root: str, relations: list[Relation]) -> set[str]:
    found, open_ = {root}, {root}
    while open_:
        open_ = {r.child for r in relations if r.parent in open_} - found
        found |= open_
    return found


def store_groups(root: str, relations: list[Relation]) -> list[list[str]]:
    """Stores below the root in groups that point at each other, each group after all that it points at."""
    stores = _reach(root, relations)
    below = {s: _reach(s, relations) for s in stores}
    groups = {frozenset(o for o in stores if o in below[s] and s in below[o]) for s in stores}
    out: list[list[str]] = []
    while groups:
        done = {s for g in out for s in g}
        ready = min((g for g in groups if all(r.parent in done or r.parent in g for r in relations if r.child in g and r.parent in stores)), key=sorted)
        out.append(sorted(ready))
        groups.remove(ready)
    return out


def _circular(group: list[str], relations: list[Relation]) -> bool:
    return len(group) > 1 or any(r.parent == r.child == group[0] for r in relations)


def delete_order(root: str, relations: list[Relation]) -> list[str]:
    """Stores from the root down, each after all its parents; there is none where stores point at each other in a circle."""
    groups = store_groups(root, relations)
    if any(_circular(g, relations) for g in groups):
        raise ValueError("relations form a cycle; break it before asking for a delete order")
    return [s for g in groups for s in g]


def _keys(df: DataFrame, column: str, *flags: str) -> DataFrame:
    """Distinct non-null keys with each flag true if any row of the key has it."""
    named = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k"))
    if not flags:
        return named.agg(F.lit(1).alias("_one")).drop("_one")
    return named.agg(*[F.max(f).alias(f"_{f}") for f in flags])


def _mark(child: DataFrame, column: str, keys: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Left join the parent's key flags onto the child rows under new names."""
    keys = keys.select("_k", *[F.col(a).alias(b) for a, b in renames.items()])
    out = child.join(keys, child[column] == keys["_k"], "left").drop("_k")
    return out.withColumns({b: F.coalesce(F.col(b), F.lit(False)) for b in renames.values()})


def _any(columns: list[str]):
    return reduce(lambda a, b: a | b, [F.col(c) for c in columns]) if columns else F.lit(False)


def _follow(rows: dict[str, DataFrame], start: dict[str, DataFrame], moves: list[tuple[str, str, str, str]], pack: int = 16) -> dict[str, DataFrame]:
    """Ids of all rows reached from `start` by moves (from store, its key, to store, its key), start rows included.

    Each round looks for rows that the last round's keys point to and that were not found before. Found ids
    are written each round, and packed from time to time so that a long chain keeps a short plan.
    """
    sources = {s: sorted({k for src, k, _, _ in moves if src == s}) for s in rows}
    last = {s: stage(start[s].select("_id", *sources[s])) for s in rows}
    found = {s: [last[s].select("_id")] for s in rows}
    while open_ := {s for s, d in last.items() if any(m[0] == s for m in moves) and not d.isEmpty()}:
        fresh = {}
        for s in rows:
            into = [m for m in moves if m[2] == s and m[0] in open_]
            hits = [rows[s].join(_keys(last[src], key), rows[s][to] == F.col("_k"), "left_semi").select("_id", *sources[s]) for src, key, _, to in into]
            if not hits:
                continue
            known = reduce(DataFrame.unionByName, found[s])
            once = hits[0] if len(hits) == 1 else reduce(DataFrame.unionByName, hits).dropDuplicates(["_id"])
            fresh[s] = stage(once.join(known, "_id", "left_anti"))
        for s in fresh:
            found[s].append(fresh[s].select("_id"))
            if len(found[s]) > pack:
                found[s] = [stage(reduce(DataFrame.unionByName, found[s]))]
        last = fresh
    return {s: reduce(DataFrame.unionByName, found[s]) for s in rows}


def _flag(frame: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    marked = frame.drop(name).join(ids.select("_id", F.lit(True).alias(name)), "_id", "left")
    return marked.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def erase_cascade(tables: dict[str, DataFrame], relations: list[Relation], root: str,
                  is_subject) -> DataFrame:
    """store, rows_erased, rows_nulled, rows_blocked, rows_left.

    `is_subject` is a predicate over the root table. A row is *blocked* where a cascade covers
    it but a protecting child (or a blocked descendant) keeps it, or its parent, in place; a row
    is *left* where it stays and still points at a row of the subject. Relations may form circles,
    and a store may point at itself: a row is covered, blocked or erased where some way leads there.
    """
    groups = store_groups(root, relations)
    order = [s for g in groups for s in g]
    group_of = {s: i for i, g in enumerate(groups) for s in g}
    circular = {s: _circular(g, relations) for g in groups for s in g}
    down = {s: [r for r in relations if r.parent == s and r.child in order] for s in order}
    up = {s: [r for r in relations if r.child == s and r.parent in order] for s in order}
    inside = [r for r in relations if r.parent in order and r.child in order and group_of[r.parent] == group_of[r.child]]
    frames: dict[str, DataFrame] = {}
    for store in order:
        needed = sorted({r.parent_key for r in down[store]} | {r.child_key for r in up[store]})
        subject = F.coalesce(is_subject, F.lit(False)) if store == root else F.lit(False)
        frame = tables[store].withColumn("subject", subject).select(*needed, "subject")
        frames[store] = stage(frame.withColumn("_id", F.monotonically_increasing_id())) if circular[store] else frame

    def moves(group: list[str], upward: bool = False) -> list[tuple[str, str, str, str]]:
        own = [r for r in inside if r.parent in group and r.token in CASCADES]
        return [(r.child, r.child_key, r.parent, r.parent_key) if upward else (r.parent, r.parent_key, r.child, r.child_key) for r in own]

    # Down: which rows a cascade covers. `ref_i` says relation i points at a covered row.
    for group in groups:
        for store in group:
            frame, cascades = frames[store], ["subject"]
            for i, rel in enumerate(up[store]):
                if rel in inside:
                    continue
                keys = _keys(frames[rel.parent].where("cand"), rel.parent_key).withColumn("_cand", F.lit(True))
                frame = _mark(frame, rel.child_key, keys, {"_cand": f"ref_{i}"})
                if rel.token in CASCADES:
                    cascades.append(f"ref_{i}")
            frame = frame.withColumn("cand", _any(cascades))
            frames[store] = stage(frame) if down[store] or circular[store] else frame
        if circular[group[0]]:
            covered = _follow({s: frames[s] for s in group}, {s: frames[s].where("cand") for s in group}, moves(group))
            full = {s: stage(_flag(frames[s], covered[s], "cand")) for s in group}
            for store in group:
                frame = full[store]
                for i, rel in enumerate(up[store]):
                    if rel in inside:
                        keys = _keys(full[rel.parent].where("cand"), rel.parent_key).withColumn("_cand", F.lit(True))
                        frame = _mark(frame, rel.child_key, keys, {"_cand": f"ref_{i}"})
                frames[store] = stage(frame)

    # Up: rows a protecting or blocked child keeps in place.
    for group in reversed(groups):
        held_up = {}
        for store in group:
            frame, flags = frames[store], []
            for i, rel in enumerate(down[store]):
                child = frames[rel.child]
                if rel.token in CASCADES:
                    if not down[rel.child] or rel in inside:
                        continue
                    child = child.where("blocked")
                elif rel.token == "RESTRICT":
                    child = child.where("NOT cand")
                elif rel.token != "PROTECT":
                    continue
                held = _keys(child, rel.child_key).withColumn("_held", F.lit(True))
                frame = _mark(frame, rel.parent_key, held, {"_held": f"held_{i}"})
                flags.append(f"held_{i}")
            frame = frame.withColumn("blocked", F.col("cand") & _any(flags)).drop(*flags)
            held_up[store] = stage(frame) if flags else frame
        frames.update(held_up)
        if circular[group[0]]:
            kept = _follow({s: frames[s].where("cand") for s in group}, {s: frames[s].where("blocked") for s in group}, moves(group, upward=True))
            frames.update({s: stage(_flag(frames[s], kept[s], "blocked")) for s in group})

    # Down again: what is really erased, and what that does to the rows beside the cascade.
    parts = []
    for group in groups:
        for store in group:
            frame, gone = frames[store], ["subject"]
            for i, rel in enumerate(up[store]):
                if rel.token in CASCADES and rel not in inside:
                    keys = _keys(frames[rel.parent].where("erased"), rel.parent_key).withColumn("_gone", F.lit(True))
                    frame = _mark(frame, rel.child_key, keys, {"_gone": f"gone_{i}"})
                    gone.append(f"gone_{i}")
            frame = frame.withColumn("erased", _any(gone) & ~F.col("blocked")).drop(*gone)
            frames[store] = stage(frame) if down[store] or circular[store] else frame
        if circular[group[0]]:
            free = {s: frames[s].where("cand AND NOT blocked") for s in group}
            gone = _follow(free, {s: frames[s].where("erased") for s in group}, moves(group))
            frames.update({s: stage(_flag(frames[s], gone[s], "erased")) for s in group})

    def total(test):
        return F.coalesce(F.sum(test.cast("bigint")), F.lit(0).cast("bigint"))
    for store in order:
        frame, cleared = frames[store], []
        for i, rel in enumerate(up[store]):
            if rel.token in NULLS:
                keys = _keys(frames[rel.parent].where("erased"), rel.parent_key).withColumn("_gone", F.lit(True))
                frame = _mark(frame, rel.child_key, keys, {"_gone": f"clear_{i}"})
                cleared.append(f"clear_{i}")
        refs = [f"ref_{i}" for i in range(len(up[store]))]
        frame = frame.withColumn("nulled", _any(cleared) & ~F.col("erased"))
        frame = frame.withColumn("left", _any(refs) & ~F.col("cand") & ~F.col("nulled"))
        parts.append(frame.agg(
            total(F.col("erased")).alias("rows_erased"), total(F.col("nulled")).alias("rows_nulled"),
            total(F.col("cand") & ~F.col("erased")).alias("rows_blocked"), total(F.col("left")).alias("rows_left"),
        ).select(F.lit(store).alias("store"), "*"))
    return reduce(DataFrame.unionByName, parts)


def blocked_parents(parent: DataFrame, parent_key: str, child: DataFrame, child_key: str) -> DataFrame:
    """Parent rows a protecting child still points at: they cannot be deleted first."""
    keys = child.select(F.col(child_key).alias("_k")).distinct()
    return parent.join(keys, parent[parent_key] == keys["_k"], "left_semi")
