
from pyspark.sql import functions as F

from conftest import rows
from datarights.operators import claims as cl, report, runlog as rl, scoring as sc
from datarights.session import stage
from datarights.sources import corpus as co

CITE = "struct<file:string,line:int,symbol:string>"
ERASURE = f"struct<verdict:string,evidence:array<{CITE}>,timer_days:int,note:string>"
RECORD = (f"record_id string, data_subjects array<struct<label:string,file:string,line:int>>, entry_points array<struct<name:string,file:string,line:int>>, "
          f"stores array<struct<name:string,kind:string,declared_at:{CITE},subject_link:{CITE},fields:array<struct<name:string,file:string,line:int,note:string,erasure:{ERASURE}>>,erasure:{ERASURE},note:string>>, "
          "retention array<struct<store:string,days:int,criteria:string,file:string,line:int>>")


def store(name, kind, verdict, fields=(("email", None),), evidence=(("a.py", 1, "x"),), timer=None, note=None, at=("m.py", 3, "s")):
    fs = [(f, "a.py", 2, None, e) for f, e in fields]
    return (name, kind, at, None, fs, (verdict, list(evidence), timer, None), note)


def records(spark):
    good = ("good", [("x", "a.py", 1)], [("delete_user", "v.py", 3)], [store("users", "relational", "erased"), store("dump", "backup", "no_schedule_evidenced", evidence=())], [("user", 3, None, "a.py", 1)])
    bad = ("bad", [("x", "/abs.py", 0)], [], [
        store("users", "relational", "erased", evidence=(), timer=3), store("User", "relational", "erased_after_timer", fields=()),
        store("b", "backup", "erased", fields=(("phone", ("erased", [], None, None)), ("phones", None))), store("c", "cache", "governed_by_retention", note="this is compliant", at=("../x.py", 1, "s"))],
        [("ghost", None, None, None, None), ("c", -1, None, "a.py", 1)])
    return spark.createDataFrame([good, bad], RECORD)


def test_invariants(spark):
    found = cl.check_invariants(records(spark))
    assert found.where("record_id = 'good'").count() == 0
    got = set(rows(found.where("record_id = 'bad'"), "pointer", "problem"))
    for want in (("/stores/0/erasure", "evidence needed"), ("/stores/0/erasure", "timer not allowed"), ("/stores/1/erasure", "timer needed"), ("/stores/1", "store without fields"),
                 ("/stores/1/name", "duplicate store name"), ("/stores/0/erasure/verdict", "no entry points, so the verdict is no_entry_point"), ("/stores/2/erasure", "backup verdict needed"),
                 ("/stores/2/fields/0/erasure/verdict", "override repeats the store"), ("/stores/3/erasure", "backup verdict not allowed"), ("/stores/3/note", "legal conclusion"),
                 ("/stores/3/declared_at", "path is not relative"), ("/data_subjects/0", "path is not relative"), ("/data_subjects/0", "lines are 1-based"), ("/retention/0", "names no store"),
                 ("/retention/0", "days or criteria needed"), ("/retention/0", "file and line needed"), ("/retention/1", "negative days")):
        assert want in got, want


def test_tuples_and_rekey(spark):
    claims = sc.claim_fields(records(spark).where("record_id = 'bad'").select("record_id", "stores"))
    truth = spark.createDataFrame([("bad", "user", "u.py", 1), ("bad", "avatar.image", "m.py", 3)], "record_id string, name string, file string, line int")
    keyed = sc.rekey(claims, truth, ["record_id"], ["shop"])
    assert ("b", "avatar_image") in rows(keyed, "store_name", "store")  # first unknown claim declared on the file store's line
    assert ("c", "c") in rows(keyed, "store_name", "store")
    tuples = sc.extract_tuples(keyed, ["record_id"])
    assert rows(tuples.where("store = 'avatar_image'"), "field", "reaches", "invalid", "copies") == [("phone", False, True, 2)]


def test_compare_order(spark):
    data = [(0, "s", "relational", "erased", ["a:1"], "erased", ["a:1"], "agrees"), (1, "s", "relational", "erased", ["z:9"], "erased", ["a:1"], "off_path"), (2, "s", "relational", "erased", [], "unverified", [], "unresolved"),
            (3, "s", "relational", "anonymised", [], "not_erased", [], "false_safe"), (4, "s", "relational", "erased_after_timer", [], "erased", [], "timer_not_needed"),
            (5, "s", "relational", "not_erased", [], "anonymised", [], "more_careful"), (6, "s", "relational", "not_erased", [], "unverified", [], "cannot_tell"), (7, "s", "backup", "erased", [], "erased", [], "wrong_kind")]
    df = spark.createDataFrame(data, "id int, store_id string, kind string, claimed string, cited array<string>, found string, allowed array<string>, want string").withColumn("field", F.lit(None).cast("string"))
    v = df.select("id", "store_id", "found", F.lit("relational").alias("found_kind"), "allowed")
    out = cl.compare_claims(df.drop("found", "allowed"), v, ["id", "store_id"])
    assert rows(out.where("rule <> want"), "id", "rule") == []
    noted = cl.wrong_kind_notes(df.drop("found", "allowed"), v, ["id", "store_id"])
    assert rows(noted, "id", "found_kind") == [(7, "relational")]
    lone = cl.compare_claims(df.drop("found", "allowed"), v.where("id < 0"), ["id", "store_id"])
    assert set(rows(lone.where("id < 7").select("rule").distinct())) == {("uncorroborated",), ("uncorroborated_safe",)}


def test_matching_is_one_to_one(spark):
    claims = [(0, "admin_users"), (1, "users"), (2, "user"), (3, "pics"), (4, "avatars")]
    c = spark.createDataFrame([("r", p, n, "m.py" if p == 3 else None, 9 if p == 3 else None) for p, n in claims], "r string, claim_pos int, name string, file string, line int")
    s = spark.createDataFrame([("r", "user", "user", "shop.models.User", "relational", "m.py", 1), ("r", "user.avatar", "user.avatar", "shop.models.User", "object_storage", "m.py", 9)],
                              "r string, store_id string, name string, model string, kind string, file string, line int")
    assert rows(cl.match_claims(c, s, ["r"]), "claim_pos", "store_id") == [(1, "user"), (3, "user.avatar")]


def test_history_and_reverify(spark):
    rej = spark.createDataFrame([("r", 1, "rejected_claim", "user"), ("r", 1, "missing_store", "log"), ("r", 2, "missing_store", "gone")], "r string, attempt int, kind string, store string")
    acc = spark.createDataFrame([("r", "user", "not_erased"), ("r", "log", "erased")], "r string, store string, verdict string")
    assert rows(cl.resolved_history(rej, acc, ["r"]), "store", "revised_to", "added_on_attempt") == [("gone", None, None), ("log", None, 2), ("user", "not_erased", None)]
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, answer string, f1 double")
    b = spark.createDataFrame([(1, "x", 1.5), (3, "z", 0.0)], "k int, answer string, f1 double")
    assert rows(cl.reverify(a, b, ["k"], ["answer", "f1"]), "k", "what") == [(1, "f1"), (2, "not recomputed"), (3, "not stored")]


def test_start_and_gate(spark):
    start = "run_id string, arm string, case string, seed int, mode string, model string, overridden array<string>, path_arm string, path_case string, path_seed string"
    df = spark.createDataFrame([("a", "x", "S1", 1, "live", "m", [], "x", "S1", "1"), ("b", "x", "S1", 2, "odd", "n", ["NOPE"], "y", "S2", "1"), ("c", "x", "S1", 1, "live", "m", None, "x", "S1", "1")], start)
    assert rows(rl.check_start(df, "m", ["TOOLS"])) == [("b", "arm"), ("b", "case"), ("b", "mode"), ("b", "model"), ("b", "override name"), ("b", "seed"), ("c", "overridden")]
    points = spark.createDataFrame([("a", "harness", "low", "human", {"s": "internal"}), ("b", "me", "high", "human", {"s": "friend", "t": "internal"}), ("c", "harness", "low", "simulated", {"s": "internal"})],
                                   "run_id string, caller string, risk string, by string, completions map<string,string>")
    runs = spark.createDataFrame([("a", "advanced", "accepted", "low"), ("b", "baseline", "accepted", "low"), ("c", "advanced", "accepted", "low"), ("d", "advanced", "accepted", "low")], "run_id string, arm string, stop string, rating string")
    stores = spark.createDataFrame([(r, "s") for r in "abcd"], "run_id string, name string")
    assert rows(rl.check_gate(points, runs, stores)) == [("b", "baseline carries a checkpoint"), ("b", "caller"), ("b", "kind outside the enum"), ("b", "risk differs"), ("b", "store not in the record"),
                                                        ("c", "completions on a simulated gate"), ("d", "needs one checkpoint")]


def test_report_tables(spark):
    stores = spark.createDataFrame([("r", "users", "relational", "erased", None, None, "a", 1), ("r", "stripe", "third_party", "external_manual", None, None, "b", 2)],
                                   "r string, store string, kind string, verdict string, timer_days int, recipient_kind string, file string, line int")
    fields = spark.createDataFrame([("r", "users", "email", "contact", "anonymised", "a", 2)], "r string, store string, field string, category string, verdict string, file string, line int")
    keep = spark.createDataFrame([("r", "User", "contact", 30, "after closing", "a", 3)], "r string, store string, category string, days int, criteria string, file string, line int")
    ev = spark.createDataFrame([("r", "users", None, "v.py", 4), ("r", "users", "email", "v.py", 5)], "r string, store string, field string, file string, line int")
    out = report.report_tables(stores, fields, keep, ev, ["r"])
    assert rows(out["retention"], "store", "limit") == [("stripe", "NO TIMER EVIDENCED"), ("users", "30 days after closing")]
    assert rows(out["recipients"], "store", "recipient_kind", "open") == [("stripe", "unknown", True)]
    assert rows(out["erasure"], "store", "field", "verdict", "cites", "ord") == [("stripe", None, "external_manual", None, 2), ("users", "email", "anonymised", ["v.py:5"], 9), ("users", None, "erased", ["v.py:4"], 7)]
    assert out["open_cells"].count() == 3


def test_lines_of_alike_files_are_not_sent_whole(spark):
    """Twelve thousand alike files are some kilobytes on disk; their lines, joined to the cited ones, are not broadcast."""
    text = "\n".join(f"x{i} = 'pad'" for i in range(20))
    files = stage(spark.range(12_000).select(F.col("id").cast("string").alias("file"), F.lit(text).alias("text")))
    cites = stage(files.select("file", F.lit(3).alias("line"), F.when(F.col("file") == "7", "gone").otherwise("x2").alias("symbol"), F.lit(True).alias("has_symbol"),
                               F.lit(False).alias("scanned_only"), F.col("file").cast("bigint").alias("cite_id")))
    read = files.join(cites.select("file").distinct(), ["file"], "left_semi")
    spans = spark.createDataFrame([], "file string, start int, end int")
    checked = cl.check_citations(cites, read.select("file", F.lit(20).alias("n_lines"), F.lit(True).alias("scanned")), co.lines(read, ["file"]), spans, [])
    plan = checked._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(p) - len(p.lstrip(" :+-")) for p in plan]
    for i in (i for i, p in enumerate(plan) if "BroadcastExchange" in p):
        below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
        assert not any("Generate posexplode" in p for p in plan[i:below]), plan[i]
    assert any("Generate posexplode" in p for p in plan)
    assert rows(checked.where("problem IS NOT NULL"), "file", "problem") == [("7", "symbol_absent")]
