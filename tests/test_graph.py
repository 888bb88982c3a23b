"""The reach operator against a plain breadth-first search, and its small print."""

import random
import time
from collections import deque

from pyspark.sql import functions as F

from conftest import rows
from datarights.operators.graph import ADMISSIBLE_IN_NONE, EDGE_SCHEMA, MODES, closure, first_paths, mode_array, package_seeds, paths, reach, reach_states, reach_two_pass
from datarights.plans.graph_queries import part_supplier_edges
from test_session import shuffle_files

START = "repo_id string, entry string, node string, mode string"


def edge(src, dst, kind="call", line=1, ambiguous=False, modes=None, sets=None, hub=False, file="f", rule="r", repo="r"):
    return (repo, src, dst, kind, file, line, rule, ambiguous, modes or MODES, sets, hub, "")


def brute(edges, start):
    """First arrivals in the order of (queue, target, kind, file, line, rule)."""
    out = {(start, "none"): (0, [])}
    queue = deque([(start, "none")])
    while queue:
        node, mode = queue.popleft()
        depth, path = out[(node, mode)]
        for e in sorted((e for e in edges if e[1] == node), key=lambda e: (e[2], e[3], e[4], e[5], e[6])):
            if mode not in e[8] or (mode == "none" and e[3] not in ADMISSIBLE_IN_NONE):
                continue
            nxt = (e[2], e[9] or mode)
            if nxt not in out:
                out[nxt] = (depth + 1, [*path, (e[1], e[2], e[3], e[5])])
                queue.append(nxt)
    return out


def test_random_graphs_match_brute_force(spark):
    rng = random.Random(7)
    kinds = ["call", "SE1", "SE12", "SE8", "SE7"]
    edges, starts, want_depth, want_paths = [], [], set(), {}
    for g in range(6):
        repo, mine = f"g{g}", []
        for _ in range(40):
            kind = rng.choice(kinds)
            modes = MODES if kind in ("call", "SE12", "SE7") else rng.sample(MODES[1:], 2)
            mine.append(edge(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", kind, rng.randrange(5), modes=modes,
                             sets=rng.choice(MODES[1:]) if kind == "SE12" else None, repo=repo))
        mine = list({e[:7]: e for e in mine}.values())
        edges += mine
        for s in ("n0", "n5"):
            starts.append((repo, f"entry:{s}", s, "none"))
            found = brute(mine, s)
            want_depth |= {(repo, f"entry:{s}", node, mode, depth) for (node, mode), (depth, _p) in found.items()}
            for (node, _m), (depth, path) in sorted(found.items(), key=lambda x: x[1][0]):
                if (repo, f"entry:{s}", node) not in want_paths or len(want_paths[(repo, f"entry:{s}", node)]) > depth:
                    want_paths[(repo, f"entry:{s}", node)] = path
    df, st = spark.createDataFrame(edges, EDGE_SCHEMA), spark.createDataFrame(starts, START)
    got = reach(df, st, compact_every=3)
    assert set(rows(got, "repo_id", "entry", "node", "mode", "depth")) == want_depth
    steps = rows(paths(got, first_paths(got)), "repo_id", "entry", "target", "step", "src", "dst", "kind", "line")
    rebuilt = {}
    for repo, entry_, target, _step, *cells in sorted(steps):
        rebuilt.setdefault((repo, entry_, target), []).append(tuple(cells))
    # equal length everywhere; equal steps wherever only one mode arrives that early
    assert {k: len(v) for k, v in rebuilt.items()} == {k: len(v) for k, v in want_paths.items() if v}
    assert all(p[0][0] == k[1].removeprefix("entry:") and p[-1][1] == k[2] for k, p in rebuilt.items())


def test_hubs_equal_written_out_edges(spark):
    members = [("r", "hub:save", f"m{i}") for i in range(4)]
    hubbed = [edge("a", "hub:save", ambiguous=True, hub=True, line=3), edge("b", "hub:save", ambiguous=True, hub=True, line=1), edge("s", "a"), edge("s", "b"), edge("m2", "t")]
    flat = [e for e in hubbed if not e[10]] + [edge(src, f"m{i}", ambiguous=True, line=line) for src, line in (("a", 3), ("b", 1)) for i in range(4)]
    st = spark.createDataFrame([("r", "e", "s", "none")], START)
    cols = ("node", "mode", "depth", "file", "line", "ambiguous")
    hub_df = spark.createDataFrame(members, "repo_id string, hub string, dst string")
    one = rows(first_paths(reach(spark.createDataFrame(hubbed, EDGE_SCHEMA), st, hubs=hub_df)), *cols)
    assert one == rows(first_paths(reach(spark.createDataFrame(flat, EDGE_SCHEMA), st)), *cols)
    both = reach_two_pass(spark.createDataFrame(hubbed, EDGE_SCHEMA), st, hub_df)
    assert rows(both.where("only_ambiguous"), "node") == [("m0",), ("m1",), ("m2",), ("m3",), ("t",)]


def test_blocked_and_must_pass(spark):
    edges = spark.createDataFrame([edge("s", "x"), edge("x", "t"), edge("s", "y"), edge("y", "u"), edge("u", "t")], EDGE_SCHEMA)
    st = spark.createDataFrame([("r", "e", "s", "none")], START)
    block = spark.createDataFrame([("r", "e", "x")], "repo_id string, entry string, node string")
    assert rows(first_paths(reach(edges, st, blocked=block)), "node", "depth") == [("s", 0), ("t", 3), ("u", 2), ("y", 1)]
    via = spark.createDataFrame([("r", "u")], "repo_id string, node string")
    assert rows(first_paths(reach(edges, st, must_pass=via)), "node", "depth") == [("t", 3), ("u", 2)]


def test_states_equal_those_of_the_search_with_paths(spark):
    """Blocked nodes, nodes to pass, hubs and parallel edges (F2)."""
    rng = random.Random(11)
    edges = [edge(f"n{rng.randrange(15)}", f"n{rng.randrange(15)}", kind, rng.randrange(4), ambiguous=rng.random() < 0.2, modes=MODES if kind != "SE1" else rng.sample(MODES, 3),
                  sets=rng.choice(MODES[1:]) if kind == "SE12" else None, repo=f"g{g}") for g in range(3) for kind in rng.choices(["call", "SE1", "SE12", "SE8"], k=45)]
    edges += [edge("n0", "hub:h", ambiguous=True, hub=True, repo="g0"), edge("n3", "hub:h", ambiguous=True, hub=True, repo="g1")]
    df = spark.createDataFrame(edges, EDGE_SCHEMA)
    st = spark.createDataFrame([(f"g{g}", e, n, m) for g in range(3) for e, n, m in (("a", "n0", "none"), ("a", "n4", MODES[2]), ("b", "n5", "none"))], START)
    hubs = spark.createDataFrame([(f"g{g}", "hub:h", f"n{i}") for g in range(2) for i in (6, 7, 8)], "repo_id string, hub string, dst string")
    via = spark.createDataFrame([(f"g{g}", n) for g in range(3) for n in ("n2", "n4")], "repo_id string, node string")
    block = spark.createDataFrame([("g0", "a", "n1"), ("g1", "b", "n3")], "repo_id string, entry string, node string")
    for more in ({}, {"hubs": hubs}, {"must_pass": via}, {"blocked": block, "hubs": hubs, "must_pass": via}, {"resolved_only": True}):
        want = reach(df, st, compact_every=3, **more).select("repo_id", "entry", "node", "mode", "passed", "depth")
        assert rows(reach_states(df, st, compact_every=3, **more)) == rows(want), more


def test_closure_and_package_seeds(spark):
    links = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("q", "a", "z")], "repo_id string, src string, dst string")
    seeds = spark.createDataFrame([("r", "x", "a")], "repo_id string, entry string, node string")
    assert rows(closure(links, seeds), "node", "depth") == [("a", 0), ("b", 1), ("c", 2)]
    mods = spark.createDataFrame([("r", m) for m in ("blog.models", "vendor.blog.models", "src.shop.apps", "blog.sub.models")], "repo_id string, module string")
    packs = spark.createDataFrame([("r", "blog"), ("r", "shop")], "repo_id string, package string")
    assert rows(package_seeds(mods, packs), "module") == [("blog.models",), ("src.shop.apps",)]


def test_cascade_rejects_cycles():
    import pytest

    from datarights.operators.cascade import Relation, delete_order

    with pytest.raises(ValueError):
        delete_order("a", [Relation("a", "b", "k", "k", "CASCADE"), Relation("b", "a", "k", "k", "CASCADE")])


def test_cascade_restrict_and_block(spark):
    from datarights.operators.cascade import Relation, erase_cascade

    user = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    post = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "id int, user_id int")
    note = spark.createDataFrame([(100, 10), (101, 11), (102, None)], "id int, post_id int")
    rel = [Relation("user", "post", "id", "user_id", "CASCADE"), Relation("post", "note", "id", "post_id", "RESTRICT")]
    got = rows(erase_cascade({"user": user, "post": post, "note": note}, rel, "user", F.col("id") < 3))
    assert got == [("note", 0, 0, 0, 2), ("post", 0, 0, 2, 0), ("user", 0, 0, 2, 0)]


def plain_cascade(tables, relations, root, subject):
    """Flags of every row by rules applied until nothing changes."""
    flags = {s: [dict(cand=s == root and subject(r), blocked=False, erased=False) for r in rows_] for s, rows_ in tables.items()}

    def pairs(token=None):
        for r in relations:
            if token is None or r.token == token:
                for i, p in enumerate(tables[r.parent]):
                    for j, c in enumerate(tables[r.child]):
                        if p[r.parent_key] is not None and p[r.parent_key] == c[r.child_key]:
                            yield r, flags[r.parent][i], flags[r.child][j]

    def settle(step):
        while step():
            pass

    def spread(test, name, upward=False):
        def once():
            changed = False
            for r, p, c in pairs("CASCADE"):
                a, b = (c, p) if upward else (p, c)
                if a[name] and not b[name] and test(b):
                    b[name] = changed = True
            return changed
        settle(once)

    spread(lambda b: True, "cand")
    for token in ("PROTECT", "RESTRICT"):
        for r, p, c in pairs(token):
            if p["cand"] and (token == "PROTECT" or not c["cand"]):
                p["blocked"] = True
    spread(lambda b: b["cand"], "blocked", upward=True)
    for f, r in zip(flags[root], tables[root]):
        f["erased"] = subject(r) and not f["blocked"]
    spread(lambda b: b["cand"] and not b["blocked"], "erased")
    out = []
    for s in tables:
        nulled, points = set(), set()
        for r, p, c in pairs():
            if r.child == s:
                j = next(k for k, f in enumerate(flags[s]) if f is c)
                points |= {j} if p["cand"] else set()
                nulled |= {j} if r.token == "SET_NULL" and p["erased"] and not c["erased"] else set()
        f = flags[s]
        out.append((s, sum(x["erased"] for x in f), len(nulled), sum(x["cand"] and not x["erased"] for x in f), sum(j in points and not f[j]["cand"] and j not in nulled for j in range(len(f)))))
    return sorted(out)


def test_cascade_over_circles(spark):
    import random

    from datarights.operators.cascade import Relation, erase_cascade

    for seed in range(3):
        rng = random.Random(seed)
        pick = lambda n: rng.choice([None, *range(n)])
        tables = {"a": [{"id": i, "b": pick(9), "up": pick(12)} for i in range(12)], "b": [{"id": i, "a": pick(12), "c": pick(6)} for i in range(9)],
                  "c": [{"id": i, "b": pick(9)} for i in range(6)], "d": [{"a": pick(12), "b": pick(9)} for _ in range(8)]}
        relations = [Relation("a", "a", "id", "up", rng.choice(["CASCADE", "SET_NULL"])), Relation("a", "b", "id", "a", "CASCADE"), Relation("b", "a", "id", "b", rng.choice(["CASCADE", "RESTRICT"])),
                     Relation("b", "c", "id", "b", "CASCADE"), Relation("a", "d", "id", "a", "SET_NULL"), Relation("b", "d", "id", "b", rng.choice(["PROTECT", "DO_NOTHING"]))]
        frames = {s: spark.createDataFrame([tuple(r.values()) for r in rows_], ", ".join(f"{k} int" for k in rows_[0])) for s, rows_ in tables.items()}
        assert rows(erase_cascade(frames, relations, "a", F.col("id") < 3)) == plain_cascade(tables, relations, "a", lambda r: r["id"] < 3)


def test_search_of_states_leaves_no_shuffle_files(spark):
    """Edges and rounds are written tables: what dealt them out is gone when the search ends, as is the edges' table."""
    edges = spark.range(400).select(F.lit("r").alias("repo_id"), F.concat(F.lit("n"), (F.col("id") % 40).cast("string")).alias("src"), F.concat(F.lit("n"), ((F.col("id") * 7 + 1) % 40).cast("string")).alias("dst"),
                                    F.lit("call").alias("kind"), F.lit(False).alias("ambiguous"), mode_array(MODES).alias("modes"), F.lit(None).cast("string").alias("sets_mode"))
    starts = spark.createDataFrame([("r", "e", "n0", "none")], "repo_id string, entry string, node string, mode string")
    before = shuffle_files(spark)
    found = reach_states(edges, starts)
    until = time.time() + 20  # they are removed beside the next job
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert not [x.name for x in spark.catalog.listTables() if x.name.startswith("bucketed_")]
    assert rows(found, "node", "depth") == [("n0", 0), ("n1", 1), ("n17", 3), ("n8", 2)]


def test_edges_of_odd_lines(spark, tmp_path):
    """Every edge once, whatever lines repeat or lack, and without both keys there and back are one edge."""
    lines = [(1, 2, "A", "O"), (1, 2, "A", "F"), (1, 2, "A", "O"), (1, 2, "N", None), (1, 2, None, "O"), (1, 2, "X", "O"), (None, 2, "R", "F"), (1, None, "R", "O"), (None, None, "A", "O"), (None, None, "N", "O")]
    spark.createDataFrame(lines, "l_partkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    every, want = tuple(MODES), set()
    for p, s, flag, status in lines:
        part, supp = None if p is None else f"p{p}", None if s is None else f"s{s}"
        want.add((supp, part, {"A": "call", "R": "SE12"}.get(flag, "SE1"), ("model_delete", "queryset_delete") if flag == "N" else every, "model_delete" if flag == "R" else None))
        want.add((part, supp, "call" if status == "O" else "SE8", every if status == "O" else ("model_delete",), None))
    got = [(r["src"], r["dst"], r["kind"], tuple(r["modes"]), r["sets_mode"]) for r in part_supplier_edges(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
