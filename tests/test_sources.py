import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from datarights.functions import text as t
from datarights.sources import catalog, corpus, rules as rl, traces


@pytest.fixture()
def tree(tmp_path):
    def put(path, data):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data if isinstance(data, bytes) else data.encode())
    put("r1/app/models.py", "x = 1\r\ny = 2\n")
    put("r1/app/tests/test_a.py", "#")
    put("r1/app/tests/settings.py", "A = 1\n")
    put("r1/app/test_b.py", "#")
    put("r1/proj/settings/base.py", "B = 1\n")
    put("r1/big.py", b"#" * (1048576 + 1))
    put("r1/latin.py", b"\xff\xfe\x00")
    put("r1/infra/main.tf", "a\n")
    put("r1/a/b/c/d/e/deep.tf", "a\n")
    put("r2/app/__init__.py", "")
    return str(tmp_path)


def test_scan_and_quarantine(spark, tree):
    files = corpus.scan_corpus(spark, tree)
    assert rows(files.groupBy("repo_id").count()) == [("r1", 9)]  # the empty file of r2 is not listed
    assert rows(corpus.with_package_markers(files).where("n_bytes = 0"), "path") == [
        ("app/__init__.py",), ("app/tests/__init__.py",), ("proj/__init__.py",), ("proj/settings/__init__.py",)]
    marked = corpus.classify_paths(files.where("path LIKE '%.py'"))
    assert rows(marked.where("skip_reason IS NOT NULL"), "path", "skip_reason") == [
        ("app/test_b.py", "file:test_*.py"), ("app/tests/settings.py", "dir:tests"), ("app/tests/test_a.py", "dir:tests")]
    assert rows(corpus.skip_tally(marked)) == [("r1", "dir:tests", 1), ("r1", "file:test_*.py", 1)]
    assert rows(corpus.split_readable(marked.where("skip_reason IS NULL"))[1], "path") == [("latin.py",)]  # no limit unless asked for
    small = corpus.scan_corpus(spark, tree, max_bytes=1 << 20)
    assert rows(corpus.scan_oversized(spark, tree, max_bytes=1 << 20), "repo_id", "path", "error") == [("r1", "big.py", "TooLarge")]
    assert ("big.py",) not in rows(small, "path") and small.count() == 8
    ok, bad = corpus.split_readable(marked.where("skip_reason IS NULL"), max_bytes=1 << 20)
    assert rows(bad, "path", "error") == [("big.py", "TooLarge"), ("latin.py", "UnicodeDecodeError")]
    assert rows(ok, "repo_id", "path") == [("r1", "app/models.py"), ("r1", "proj/settings/base.py")]
    assert rows(corpus.lines(ok, ["repo_id", "path"]), "path", "line", "text") == [("app/models.py", 1, "x = 1"), ("app/models.py", 2, "y = 2"), ("proj/settings/base.py", 1, "B = 1")]
    assert rows(corpus.scan_config(files), "path") == [("a/b/c/d/e/deep.tf",), ("infra/main.tf",)]
    assert rows(corpus.scan_config(files, max_depth=4), "path") == [("infra/main.tf",)]
    assert rows(corpus.scan_corpus(spark, tree, "*.tf"), "path") == [("a/b/c/d/e/deep.tf",), ("infra/main.tf",)]


def test_fingerprint_changes_with_content(spark):
    def digest(text):
        df = spark.createDataFrame([("r", "a", text), ("r", "b", "same")], "repo_id string, path string, content string")
        return corpus.fingerprint(df, ["repo_id"]).first().digest
    assert digest("x") == digest("x") != digest("y")


def test_traces_and_identity(spark, tmp_path):
    d = tmp_path / "advanced"
    d.mkdir()
    (d / "S01-s2.jsonl").write_text('{"type": "run_start"}\nnot json\n[1]\n\n{"type": "step", "step": 1}\n{"type": "st')
    strict = traces.read_traces(spark, str(tmp_path), "strict")
    assert rows(strict, "line", "problem") == [(1, None), (2, "does not parse"), (3, "not an object"), (4, "does not parse"), (5, None), (6, "does not parse")]
    good = traces.with_run_identity(traces.read_traces(spark, str(tmp_path)))
    assert rows(good, "arm", "case", "seed", "line", "type") == [("advanced", "S01", 2, 1, "run_start"), ("advanced", "S01", 2, 5, "step")]
    deep = spark.createDataFrame([("file:/x/baseline/S07/s3/brain/submissions.jsonl",)], "file string")
    assert rows(traces.with_run_identity(deep), "arm", "case", "seed") == [("baseline", "S07", 3)]


def test_submissions_and_canonical_json(spark, tmp_path):
    (tmp_path / "submissions.jsonl").write_text(json.dumps({"attempt": 1, "record": {"b": 1, "a": [2]}, "feedback": {"accepted": False}}) + "\n" + '{"attempt": 2, "rec')
    got = traces.read_submissions(spark, str(tmp_path))
    assert rows(got, "attempt", "record") == [(1, '{"a":[2],"b":1}')]
    df = spark.createDataFrame([('{"b":1,"a":{"d":2,"c":3}}', '{"a": {"c": 3, "d": 2}, "b": 1}')], "x string, y string")
    assert df.where(traces.canonical_json("x") == traces.canonical_json("y")).count() == 1


def test_rules_are_validated(spark, tmp_path):
    assert len(rl.rules().digest) == 64
    tables = rl.load_rules(spark)
    assert tables["cascade_tokens"].count() == 2
    assert rl.rules().extended("cascade_tokens", ["drop"]).words("cascade_tokens") == ["delete", "all", "drop"]
    for name in rl.FILES:
        (tmp_path / f"{name}.yaml").write_text("version: 2\n")
    with pytest.raises(rl.RuleError):
        rl.rules(str(tmp_path))
    for name in rl.FILES:
        (tmp_path / f"{name}.yaml").write_text("version: 1\ntables: {x: {rule: '', words: []}}\n")
    rl.rules.cache_clear()
    with pytest.raises(rl.RuleError):
        rl.rules(str(tmp_path))


def test_call_patterns(spark):
    data = [("user.delete", "delete", ".delete", True), ("db.session.delete", "delete", "session.delete", True), ("user.delete", "delete", "session.delete", False),
            ("M.objects.filter().delete", "delete", "objects.filter.delete", True), ("purge", "purge", "purge", True), ("x.y", "y", "purge", False)]
    df = spark.createDataFrame(data, "dotted string, name string, pattern string, want boolean")
    assert df.where(t.call_matches(F.col("dotted"), F.col("name"), F.col("pattern")) != F.col("want")).count() == 0


def test_norm_is_idempotent_and_named(spark):
    data = [("Companies", "company"), ("addresses", "address"), ("status", "status"), ("user_s", "user"), ("  Boxes! ", "box"), ("ties", "tie"), ("bus", "bus"), ("batches", "batch")]
    df = spark.createDataFrame(data, "x string, want string").withColumn("n", t.norm("x"))
    assert rows(df.where("n <> want"), "x", "n") == []
    assert df.where(t.norm("n") != F.col("n")).count() == 0
    assert all(t.py_norm(a) == b for a, b in data)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", "user"), ("r2", "log")], "repo_id string, store string")
    catalog.write_inventory(df, str(tmp_path / "inv"))
    catalog.write_inventory(df.limit(1), str(tmp_path / "inv"), draft=True)
    back = spark.read.parquet(str(tmp_path / "inv"))
    assert rows(back.where("state = 'accepted'"), "repo_id", "store") == [("r1", "user"), ("r2", "log")] and back.where("state = 'draft'").count() == 1
    lines = spark.createDataFrame([("r1", 2, "b"), ("r1", 1, "a")], "repo_id string, ord int, text string")
    catalog.write_report(lines, str(tmp_path / "rep"))
    assert [r.value for r in spark.read.text(str(tmp_path / "rep")).collect()] == ["r1\ta", "r1\tb"]
