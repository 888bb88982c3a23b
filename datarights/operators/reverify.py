"""Answers once given, asked again: does the check still say what was recorded?

An answer depends on the files of its repository, the rules and the record, so their digest names it. A
ledger keeps answers by name. Asked again, a submission whose name is known takes its answer over by a
join, and only repositories with a new name are scanned: one changed file costs one repository.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.operators.check import LISTS, check_claims, parse_records
from datarights.operators.claims import reverify
from datarights.session import stage
from datarights.sources import corpus as co
from datarights.sources.rules import Rules, rules as default_rules

ANSWER = ["accepted", *LISTS]


def answer_names(files: DataFrame, submissions: DataFrame, r: Rules | None = None) -> DataFrame:
    """record_id, repo_id, answer: the digest of all that the answer to a submission depends on.

    `submissions`: record_id, repo_id, record (JSON). A repository without files has a name, too."""
    r = r or default_rules()
    known = hashlib.sha256(repr(r).encode()).hexdigest()
    prints = co.fingerprint(files, ["repo_id"], content="text")
    digest = next(c for c in prints.columns if c != "repo_id")
    return submissions.join(prints, "repo_id", "left").select(
        "record_id", "repo_id", F.sha2(F.concat_ws("|", F.coalesce(digest, F.lit("no files")), F.lit(known), F.coalesce("record", F.lit(""))), 256).alias("answer"))


def canonical(feedback: DataFrame) -> list:
    """The answer's parts as text, equal for equal answers; lists are in their order already."""
    return [F.col("accepted").cast("string").alias("accepted"), *[F.to_json(c).alias(c) for c in LISTS]]


def recheck(files: DataFrame, submissions: DataFrame, ledger: DataFrame | None = None, r: Rules | None = None, integrity: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers for all submissions; the ledger with what was worked out now; the repositories whose answer was not known.

    `ledger`: answer and the answer's parts, from an earlier call or null. Equal records about equal
    repositories have one name and are worked out once; all these repositories are told."""
    ledger = None if ledger is None else ledger.dropDuplicates(["answer"])
    named = stage(answer_names(files, submissions, r))
    fresh = named if ledger is None else named.join(ledger, "answer", "left_anti")
    first = stage(fresh.groupBy("answer").agg(F.min(F.struct("repo_id", "record_id")).alias("_f")).select("answer", "_f.*"))
    parts = ["answer", *ANSWER]
    if first.isEmpty():
        known = ledger if ledger is not None else first.select("answer", *[F.lit("").alias(c) for c in ANSWER])
    else:
        records = parse_records(submissions.join(first.select("record_id"), "record_id", "left_semi"))
        made = check_claims(files, records, r, integrity)
        made = stage(made.select("record_id", *canonical(made)).join(first.select("record_id", "answer"), "record_id").select(*parts))
        known = made if ledger is None else stage(ledger.select(*parts).unionByName(made))
    return named.join(known, "answer").select("record_id", "repo_id", *ANSWER), known, fresh.select("repo_id").distinct()


def reverify_submissions(files: DataFrame, submissions: DataFrame, ledger: DataFrame | None = None, r: Rules | None = None, integrity: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Differences (record_id, what, was, now) between recorded answers and those of today, the ledger, and the repositories whose answer was not known.

    `submissions`: record_id, repo_id, record (JSON) and the recorded answer's parts, null where none was
    recorded. A record that is no JSON object is a difference of its own, `no record`, and not asked."""
    given = F.coalesce(F.col("record").rlike(r"^\s*\{"), F.lit(False)) & F.from_json("record", "map<string, string>").isNotNull()
    marked = stage(submissions.withColumn("_given", given))
    asked = marked.where("_given").drop("_given")
    answers, ledger, worked = recheck(files, asked, ledger, r, integrity)
    stored = asked.where("accepted IS NOT NULL").select("record_id", *ANSWER)
    found = reverify(stored, answers.select("record_id", *ANSWER), ["record_id"], ANSWER)
    none = marked.where("NOT _given").select("record_id", F.lit("no record").alias("what"), F.lit(None).cast("string").alias("was"), F.lit(None).cast("string").alias("now"))
    return found.unionByName(none), ledger, worked


def rescore(committed: DataFrame, scored: DataFrame, run: list[str], values: list[str]) -> DataFrame:
    """Scores worked out again beside those committed: run, what, was, now for every difference. A delivered run without committed scores is one."""
    return reverify(committed, scored, run, values)
