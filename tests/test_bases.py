"""Ancestors of classes: one row each, however many ways lead there."""

from datarights.operators import resolve
from datarights.operators.resolve import linearise

BASES = "repo_id string, cls string, ord int, sub int, base string, via string"


def run(spark, bases):
    names = sorted({b[0] for b in bases} | {b[3] for b in bases if b[3]})
    classes = spark.createDataFrame([("r", n) for n in names], "repo_id string, name string")
    found = linearise(classes, spark.createDataFrame([("r", *b) for b in bases], BASES))
    return {(r.cls, r.ancestor): r for r in found.collect()}


def test_stacked_diamonds(spark):
    """Twenty diamonds on each other have a million ways from top to bottom."""
    bases = [(f"d{i:02}", o, 0, f"{side}{i:02}", "local") for i in range(20) for o, side in enumerate("lr")]
    bases += [(f"{side}{i:02}", 0, 0, f"d{i + 1:02}", "imported" if side == "r" else "short") for i in range(20) for side in "lr"]
    got = run(spark, bases)
    assert len([k for k in got if k[0] == "d00"]) == 61
    bottom = got["d00", "d20"]
    assert bottom.path.count("/") == 40 and "-l05/" in bottom.path and "-r05/" not in bottom.path
    assert bottom.named and "-r05/" in bottom.named_path and not bottom.imported


def test_circles_and_order(spark):
    bases = [("a", 0, 0, "b", "imported"), ("a", 1, 0, "c", "imported"), ("b", 0, 0, "a", "imported"), ("b", 1, 0, "c", "short"), ("c", 0, 0, None, "imported")]
    got = run(spark, bases)
    assert set(got) == {("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "a"), ("b", "c"), ("c", "c")}
    assert got["a", "a"].path == "" and got["a", "c"].path == "0000000000-0000000000-b/0000000001-0000000000-c/"  # depth first: by b, left of c
    assert got["a", "c"].imported and got["a", "c"].named_path == "0000000001-0000000000-c/"


def test_each_way_is_written_once(spark):
    """Classes are settled once, after their bases, and their ways written as ranks; only classes that reach a circle go by rounds."""
    from pathlib import Path
    from urllib.parse import urlparse

    from datarights.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    before = set(folder.glob("ways-*"))
    bases = [("d", 0, 0, "m", "short"), ("d", 0, 1, "n", "imported"), ("d", 1, 0, "t", "imported"), ("m", 0, 0, "t", "imported"), ("n", 0, 0, "t", "imported"), ("t", 0, 0, "o", "local")]
    bases += [("x", 0, 0, "y", "imported"), ("y", 0, 0, "x", "imported"), ("y", 1, 0, "o", "imported")]
    got = run(spark, bases)
    (ways,) = set(folder.glob("ways-*")) - before
    assert sum(spark.read.parquet(str(level)).count() for level in ways.iterdir()) == len([k for k in got if k[0] not in "xy"]) == 14
    step = lambda o, s, b: f"{o:010d}-{s:010d}-{b}/"
    top = got["d", "o"]
    assert (top.path, top.named_path, top.imported) == (step(0, 0, "m") + step(0, 0, "t") + step(0, 0, "o"), step(0, 1, "n") + step(0, 0, "t") + step(0, 0, "o"), False)
    assert got["d", "t"].imported and got["d", "d"].path == "" and got["d", "m"].named_path is None and not got["d", "m"].named
    assert got["x", "o"].path == step(0, 0, "y") + step(1, 0, "o") and got["y", "o"].path == step(1, 0, "o")


def test_depths_leave_no_shuffle_files(spark, monkeypatch):
    """What a depth shuffled is gone when its ways are written; the last shuffle is that of the result."""
    seen, removed = [], resolve.shuffles_removed

    def watched(session):
        seen.append(session)
        return removed(session)
    monkeypatch.setattr(resolve, "shuffles_removed", watched)
    got = run(spark, [("d", 0, 0, "m", "imported"), ("m", 0, 0, "t", "imported"), ("t", 0, 0, "o", "local")])
    assert len(seen) == 4  # one job for each depth
    assert len(got) == 10
