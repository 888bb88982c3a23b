"""The whole check: records of several repositories against their files, in one run."""

import textwrap

import pytest

from datarights.operators.check import RECORD, check_claims, fold_feedback, parse_records, record_citations

MODELS = """from django.db import models
class User(models.Model):
    email = models.EmailField()
class Parcel(models.Model):
    owner = models.ForeignKey(User, on_delete=models.CASCADE)
    notes = models.TextField()
"""
VIEWS = """from app.models import User
from web import app
@app.route("/users/<pk>", methods=["DELETE"])
def delete_user(request, pk):
    user = User(pk=pk)
    user.delete()
"""
SERVICES = """import redis
r = redis.Redis()
def put(user):
    r.set(f"session:{user.id}", user.email)
"""
FILES = {
    "shop": {"app/models.py": MODELS, "app/views.py": VIEWS, "app/services.py": SERVICES, "app/tests/models.py": MODELS},
    "hidden": {"app/models.py": MODELS, "app/views.py": textwrap.dedent("""
        from app.models import User
        def blank(pk):
            user = User(pk=pk)
            user.delete()
        """)},
    "other": {"app/models.py": "def x(:\n"},
}


def cite(file, line, symbol=None):
    return (file, line, symbol)


def store(name, kind, verdict, field, evidence=(), at=None, overrides=None):
    block = (verdict, list(evidence), None, None)
    fields = [(field[0], field[1], field[2], None, (overrides, list(evidence), None, None) if overrides else None)]
    return (name, kind, at, None, None, block, fields)


EMAIL, NOTES, SESSION = ("email", "app/models.py", 3), ("notes", "app/models.py", 6), ("email", "app/services.py", 4)
DELETE = cite("app/views.py", 6, "delete")
USER_AT, PARCEL_AT = cite("app/models.py", 2, "User"), cite("app/models.py", 4, "Parcel")
ENTRY = ("delete_user", "route", "app/views.py", 4)


def record(stores, entries=(ENTRY,), retention=()):
    return ([], list(entries), stores, list(retention), None)


RECORDS = {
    ("honest", "shop"): record([store("user", "relational", "erased", EMAIL, [DELETE], USER_AT), store("parcels", "relational", "erased", NOTES, [cite("app/models.py", 5, "CASCADE")], PARCEL_AT),
                                store("session", "cache", "not_erased", SESSION)]),
    ("hopeful", "shop"): record([store("session", "cache", "erased", SESSION, [cite("app/services.py", 4, "set")]), store("User", "relational", "erased", EMAIL, [cite("app/services.py", 1, "redis")], USER_AT),
                                 store("warehouse", "relational", "erased", ("email", "app/tests/models.py", 3), [cite("app/models.py", 40, "y"), cite("gone.py", 1, "x")])],
                                entries=[("put", "route", "app/services.py", 3)], retention=[("warehouse", 3, None, "app/models.py", 99)]),
    ("careful", "shop"): record([store("user", "cache", "not_erased", EMAIL, at=USER_AT), store("parcel", "relational", "erased", NOTES, [cite("app/models.py", 5, "CASCADE")], PARCEL_AT),
                                 store("session", "cache", "not_erased", SESSION, overrides="external_manual"), store("ledger", "relational", "not_erased", EMAIL)]),
    ("broken", "shop"): record([("user", "relational", USER_AT, None, None, ("not_erased", [], None, None), [])]),
    ("capped", "hidden"): record([store("user", "relational", "erased", EMAIL, [cite("app/views.py", 5, "delete")], USER_AT), store("parcel", "relational", "erased", NOTES, [cite("app/models.py", 5, "CASCADE")], PARCEL_AT)],
                                 entries=[("blank", "route", "app/views.py", 3)]),
    ("silent", "hidden"): record([store("user", "relational", "no_entry_point", EMAIL, at=USER_AT)], entries=[]),
    ("lost", "nowhere"): record([store("user", "relational", "erased", EMAIL, [DELETE], USER_AT)]),
}


@pytest.fixture(scope="module")
def feedback(spark):
    files = spark.createDataFrame([(r, p, t) for r, fs in FILES.items() for p, t in fs.items()], "repo_id string, path string, text string")
    records = spark.createDataFrame([(i, repo, *parts) for (i, repo), parts in RECORDS.items()], f"record_id string, repo_id string, {RECORD}")
    return {r.record_id: r for r in check_claims(files, records).collect()}


def items(rows, *fields):
    return [tuple(r[f] for f in fields) for r in rows]


def test_acceptance(feedback):
    assert {k: r.accepted for k, r in feedback.items()} == {"honest": True, "hopeful": False, "careful": True, "broken": False, "capped": False, "silent": False, "lost": False}


def test_an_honest_record_has_no_item(feedback):
    r = feedback["honest"]
    assert not any(r[c] for c in r.asDict() if c not in ("record_id", "repo_id", "accepted"))


def test_claims_without_evidence(feedback):
    r = feedback["hopeful"]
    assert items(r.rejected_claims, "store", "claim", "reason", "expected") == [
        ("User", "erasure.verdict=erased", "off_path", "cite_on_path"), ("session", "erasure.verdict=erased", "false_safe", "verdict:not_erased"), ("warehouse", "erasure.verdict=erased", "uncorroborated", "unverified")]
    user, session = r.rejected_claims[:2]
    assert [(c.file, c.line, c.symbol) for c in user.path] == [("app/views.py", 4, "delete_user"), ("app/views.py", 6, "user")] and session.path == []
    assert items(r.missing_stores, "store", "kind", "evidence") == [("parcel", "relational", "app/models.py:4 writes notes")]
    assert items(r.missing_entry_points, "file", "line", "name", "kind") == [("app/views.py", 4, "delete_user", "route")]
    assert items(r.bad_citations, "file", "line", "symbol", "problem", "expected") == [
        ("app/models.py", 40, "y", "past_end", "cite_symbol"), ("app/models.py", 99, "", "past_end", "cite_line"),
        ("app/tests/models.py", 3, "email", "not_scanned", "cite_scanned"), ("gone.py", 1, "x", "no_file", "cite_scanned")]


def test_more_careful_records_are_told_and_accepted(feedback):
    r = feedback["careful"]
    assert items(r.conservative_divergences, "store", "claim", "found", "file", "line") == [("user", "erasure.verdict=not_erased", "erased", "app/views.py", 6)]
    assert items(r.unverified, "store", "claim", "reason", "detail") == [
        ("ledger", "erasure.verdict=not_erased", "uncorroborated_safe", None), ("user", "kind=cache", "other_kind", "relational")]


def test_errors_of_the_record_come_alone(feedback):
    r = feedback["broken"]
    assert "store without fields" in {e.problem for e in r.schema_errors} and not r.rejected_claims and not r.missing_stores and not r.missing_entry_points


def test_views_of_one_repository(feedback):
    """A declared start counts for its own record only, and no more than an unregistered one does."""
    assert items(feedback["capped"].rejected_claims, "store", "reason", "detail") == [("parcel", "unresolved", "declared, not registered"), ("user", "unresolved", "declared, not registered")]
    assert not feedback["silent"].rejected_claims and [m.store for m in feedback["silent"].missing_stores] == ["parcel"]


def test_a_repository_without_files(feedback):
    r = feedback["lost"]
    assert items(r.rejected_claims, "store", "reason") == [("user", "uncorroborated")] and {b.problem for b in r.bad_citations} == {"no_file"} and len(r.bad_citations) == 4


def test_citations_are_read_once(spark):
    rows = spark.createDataFrame([("r", "x", '{"stores": [{"name": "a", "declared_at": {"file": "m.py", "line": 1, "symbol": "a"}, "fields": [{"name": "f", "file": "m.py", "line": 2}, {"name": "f", "file": "m.py", "line": 2}]}],'
                                   '"hints": {"security_evidence": [{"file": "Dockerfile", "line": 1}]}}'), ("bad", "x", "{no"), ("none", "x", None)], "record_id string, repo_id string, record string")
    got = {(c.file, c.line, c.symbol, c.scanned_only) for c in record_citations(parse_records(rows)).collect()}
    assert got == {("m.py", 1, "a", True), ("m.py", 2, "f", True), ("Dockerfile", 1, None, False)}


def test_records_without_items_are_accepted(spark):
    from datarights.operators.check import _tagged
    from pyspark.sql import functions as F

    records = spark.createDataFrame([("a", "x"), ("b", "x")], "record_id string, repo_id string")
    two = _tagged(records.where("record_id = 'b'"), "unverified", store=F.lit("s"), claim=F.lit("c"))
    got = {r.record_id: (r.accepted, len(r.unverified), len(r.bad_citations)) for r in fold_feedback(records, two).collect()}
    assert got == {"a": (True, 0, 0), "b": (True, 1, 0)}


def test_known_answers_are_taken_over(spark):
    """Nothing is scanned for a submission whose answer is in the ledger; a changed file or record has another name."""
    from pyspark.sql import functions as F

    from datarights.operators.reverify import ANSWER, answer_names, recheck, rescore, reverify_submissions

    files = spark.createDataFrame([("r1", "a.py", "x = 1"), ("r2", "a.py", "x = 1")], "repo_id string, path string, text string")
    asked = spark.createDataFrame([("s1", "r1", "{}"), ("s2", "r2", "{}"), ("s3", "gone", "{}")], "record_id string, repo_id string, record string")
    names = {r.record_id: r.answer for r in answer_names(files, asked).collect()}
    moved = files.withColumn("text", F.when(F.col("repo_id") == "r2", "y = 1").otherwise(F.col("text")))
    again = {r.record_id: r.answer for r in answer_names(moved, asked).collect()}
    assert names["s1"] == again["s1"] and names["s2"] != again["s2"] and names["s3"] == again["s3"]
    ledger = answer_names(files, asked).select("answer", *[F.lit("true" if c == "accepted" else "[]").alias(c) for c in ANSWER])
    answers, kept, worked = recheck(files, asked, ledger)
    assert answers.count() == 3 and worked.isEmpty() and kept.count() == 2  # equal records about equal files are one answer
    recorded = asked.select("*", *[F.lit("false" if c == "accepted" else "[]").alias(c) for c in ANSWER]).unionByName(
        asked.limit(1).select(F.lit("s4").alias("record_id"), "repo_id", F.lit("[]").alias("record"), *[F.lit("[]").alias(c) for c in ANSWER]))
    found, _, worked = reverify_submissions(files, recorded, ledger)
    assert sorted((r.record_id, r.what, r.was, r.now) for r in found.collect()) == [("s1", "accepted", "false", "true"), ("s2", "accepted", "false", "true"), ("s3", "accepted", "false", "true"), ("s4", "no record", None, None)]
    scores = spark.createDataFrame([("s1", 0.5, 1), ("s2", 1.0, 0)], "record_id string, f1 double, false_safe int")
    diffs = rescore(scores, scores.withColumn("f1", F.lit(1.0)).where("record_id = 's1'"), ["record_id"], ["f1", "false_safe"])
    assert sorted((r.record_id, r.what) for r in diffs.collect()) == [("s1", "f1"), ("s2", "not recomputed")]


def test_equal_repositories_are_all_told(spark, monkeypatch):
    """Two equal repositories have one answer that is worked out once, and both are told as new (F5)."""
    from pyspark.sql import functions as F

    from datarights.operators import reverify as rv

    files = spark.createDataFrame([("r1", "a.py", "x = 1"), ("r2", "a.py", "x = 1"), ("r3", "a.py", "x = 2")], "repo_id string, path string, text string")
    asked = spark.createDataFrame([("s1", "r1", "{}"), ("s2", "r2", "{}"), ("s3", "r3", "{}")], "record_id string, repo_id string, record string")
    given = []

    def answer(_files, records, *_more):
        given.extend(r.record_id for r in records.select("record_id").collect())
        return records.select("record_id", F.lit(True).alias("accepted"), *[F.array(F.lit("x")).alias(c) for c in rv.LISTS])

    monkeypatch.setattr(rv, "check_claims", answer)
    known = rv.answer_names(files, asked.where("record_id = 's3'")).select("answer", *[F.lit("true").alias(c) for c in rv.ANSWER])
    answers, ledger, worked = rv.recheck(files, asked, known)
    assert sorted(given) == ["s1"] and ledger.count() == 2
    assert sorted(r.record_id for r in answers.collect()) == ["s1", "s2", "s3"]
    assert sorted(r.repo_id for r in worked.collect()) == ["r1", "r2"]
