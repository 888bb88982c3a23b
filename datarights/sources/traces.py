"""JSON-lines sources: run logs and submissions, with the identity their paths carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datarights.operators.ordered import in_order, line_bucket

SUBMISSION = "attempt int, record string, feedback string"


def numbered_lines(spark: SparkSession, path: str, pattern: str | None = None, header: str | None = None) -> DataFrame:
    """file, line, text of every line of the files under `path`, numbered within its file.

    Files are read in splits like any other. A row knows the split that it stands in and its place in the
    task's reading order, so lines are numbered inside each split and a split starts where the lines of
    the splits before it end: no file is one row or one task. Lines end with a line feed only.

    `header`: files may hold many logs, so that many small logs are no files of their own. A line that this
    pattern matches names, by its first group, the log that follows; `file` is that name (it has to be the
    log's own), lines count from 1 after it, and it is no line itself. Lines before any header keep their file.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    raw = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_read"), F.col("value").alias("text"))
    lines = in_order(rows, ["file"], ["_read"], F.col("_start"), number="line").select("file", "line", "text")
    if header is None:
        return lines
    named = F.when(F.col("text").rlike(header), F.struct(F.regexp_extract("text", header, 1).alias("name"), F.col("line").alias("at")))
    logs = in_order(lines, ["file"], ["line"], line_bucket("line"), latest={"_log": named})
    return logs.where((F.col("_log.at") != F.col("line")) | F.col("_log").isNull()).select(
        F.coalesce("_log.name", "file").alias("file"), (F.col("line") - F.coalesce("_log.at", F.lit(0))).alias("line"), "text")


def read_traces(spark: SparkSession, path: str, mode: str = "drop", header: str | None = None) -> DataFrame:
    """One row per log line: file, line, text, obj (VARIANT), type, problem.

    `drop` keeps the good lines only; `strict` keeps every line with what is wrong with it.
    `header` is that of `numbered_lines`.
    """
    rows = numbered_lines(spark, path, header=header).select("file", "line", "text", F.try_parse_json("text").alias("obj"))
    is_object = F.schema_of_variant("obj").startswith("OBJECT")
    problem = F.when(F.col("obj").isNull(), "does not parse").when(~is_object, "not an object")
    rows = rows.withColumn("problem", problem).withColumn("type", F.when(problem.isNull(), F.try_variant_get("obj", "$.type", "string")))
    return rows.where("problem IS NULL").drop("problem") if mode == "drop" else rows


def read_submissions(spark: SparkSession, path: str, mode: str = "drop") -> DataFrame:
    """Submissions of each run: file, line, attempt, `record` and `feedback` as JSON text.

    `drop` leaves broken lines out. `strict` keeps them with their `problem`: a line written by half is a
    failure of its log, and only lines of white space are no submissions."""
    lines = read_traces(spark, path, "strict")
    lines = lines.where("problem IS NULL") if mode == "drop" else lines.where(F.col("text").rlike(r"\S"))
    out = lines.select(
        "file", "line", F.try_variant_get("obj", "$.attempt", "int").alias("attempt"), F.to_json(F.try_variant_get("obj", "$.record", "variant")).alias("record"),
        F.to_json(F.try_variant_get("obj", "$.feedback", "variant")).alias("feedback"), "problem")
    return out.drop("problem") if mode == "drop" else out


def identity_of(path: Column) -> Column:
    """arm, case and seed from `.../<arm>/<case>/s<seed>/...` or `.../<arm>/<case>-s<seed>.jsonl`."""
    flat = r"([^/]+)/([A-Za-z0-9_]+)-s(\d+)\.[^/]*$"
    deep = r"([^/]+)/([^/]+)/s(\d+)(?:/.*)?$"
    return F.struct(*[
        F.when(path.rlike(flat), F.regexp_extract(path, flat, i)).otherwise(F.regexp_extract(path, deep, i)).alias(n)
        for i, n in ((1, "arm"), (2, "case"), (3, "seed"))])


def with_run_identity(df: DataFrame, file: str = "file") -> DataFrame:
    return df.withColumn("_id", identity_of(F.col(file))).select(
        "*", F.col("_id.arm").alias("arm"), F.col("_id.case").alias("case"),
        F.col("_id.seed").try_cast("int").alias("seed")).drop("_id")


def canonical_json(text: Column | str) -> Column:
    """A JSON answer with its keys in order, so that key order is no difference."""
    text = F.col(text) if isinstance(text, str) else text
    return F.to_json(F.try_parse_json(text))
