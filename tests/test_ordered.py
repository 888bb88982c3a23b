import random

from pyspark.sql import functions as F

from conftest import rows
from datarights.operators.ordered import in_order, line_bucket, placed
from datarights.sources.traces import numbered_lines


def test_running_columns_match_brute_force(spark):
    rng = random.Random(3)
    data = [(k, i, rng.randrange(10), rng.choice([None, rng.randrange(100)])) for k in "ab" for i in sorted(rng.sample(range(60), 25))]
    df = spark.createDataFrame(data, "k string, i int, v int, t int")
    got = in_order(df, ["k"], ["i"], line_bucket("i", 7), number="n", sums={"s": F.col("v")}, previous={"p": "v"}, upcoming={"u": F.col("t")})
    want = []
    for key in "ab":
        mine = sorted(r for r in data if r[0] == key)
        for j, r in enumerate(mine):
            later = [x[3] for x in mine[j:] if x[3] is not None]
            want.append((*r, j + 1, sum(x[2] for x in mine[:j + 1]), mine[j - 1][2] if j else None, min(later) if later else None))
    assert rows(got, "k", "i", "v", "t", "n", "s", "p", "u") == sorted(want, key=repr)


def test_placed_numbers_everything(spark):
    df = spark.createDataFrame([(x % 3, (x * 37) % 101) for x in range(101)], "k int, x int")
    assert rows(placed(df, [], ["x"], number="n"), "x", "n") == sorted(((x, x + 1) for x in range(101)), key=repr)
    per = placed(df, ["k"], ["x"], number="n", sums={"s": F.lit(1)})
    assert per.where("n <> s").count() == 0 and per.agg(F.max("n")).first()[0] == 34


def test_latest_value_across_buckets(spark):
    df = spark.createDataFrame([(k, i, i if i in marks else None) for k, marks in (("a", {3, 4, 29}), ("b", {0, 11})) for i in range(40)], "k string, i int, t int")
    got = in_order(df, ["k"], ["i"], line_bucket("i", 7), latest={"l": F.col("t")})
    want = [(k, i, max((m for m in marks if m <= i), default=None)) for k, marks in (("a", {3, 4, 29}), ("b", {0, 11})) for i in range(40)]
    assert rows(got, "k", "i", "l") == sorted(want, key=repr)


def test_many_logs_in_one_file_across_splits(spark, tmp_path):
    """Each log counts from 1 after its header, also where a split ends inside it (F1)."""
    logs = {f"r{j}/log": [f"line {j} {i}" for i in range(j * 300)] for j in range(6)}
    body = ["loose"] + [t for name, lines in logs.items() for t in (f"==> {name} <==", *lines)]
    (tmp_path / "bundle.jsonl").write_text("\n".join(body) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = rows(numbered_lines(spark, str(tmp_path), header=r"^==> (.+) <==$"), "file", "line", "text")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(name, i + 1, t) for name, lines in logs.items() for i, t in enumerate(lines)]
    assert [r for r in got if r[2] != "loose"] == sorted(want, key=repr)
    assert [(r[0].rsplit("/", 1)[1], r[1]) for r in got if r[2] == "loose"] == [("bundle.jsonl", 1)]
