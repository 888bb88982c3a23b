"""Models handed from call to call."""

from conftest import rows

from datarights.operators.resolve import propagate_bindings


def handed(spark, links, starts):
    symbols = sorted({s for link in links for s in link[:2]})
    calls = spark.createDataFrame([("r", "resolved", b, a, "m.py", i, f"{b}()", [("name", "x")]) for i, (a, b) in enumerate(links)],
                                  "repo_id string, outcome string, target string, caller string, path string, line int, dotted string, args array<struct<kind:string,value:string>>")
    defined = spark.createDataFrame([("r", s, ["x"]) for s in symbols], "repo_id string, name string, args array<string>")
    bound = spark.createDataFrame([("r", s, "x", m) for s, m in starts], "repo_id string, symbol string, var string, model string")
    return rows(propagate_bindings(bound, calls, defined), "symbol", "model")


def test_chain_of_eight_calls(spark):
    links = [(f"f{i}", f"f{i + 1}") for i in range(8)]
    assert handed(spark, links[::-1], [("f0", "User")]) == [(f"f{i}", "User") for i in range(9)]


def test_cycles_come_to_rest(spark):
    got = dict(handed(spark, [("a", "b"), ("b", "c"), ("c", "a")], [("a", "User"), ("b", "Order")]))
    assert got.keys() == {"a", "b", "c"} and set(got.values()) <= {"User", "Order"}
