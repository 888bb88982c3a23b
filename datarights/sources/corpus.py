"""A corpus of source files: scan, skip list, quarantine, lines, listings and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datarights.sources.rules import Rules, rules as default_rules


def _scan(spark: SparkSession, root: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = root.rstrip("/").removeprefix("file:")
    rel = F.regexp_extract("path", r"^(?:[a-z0-9]+:/*)?/?\Q" + base.lstrip("/") + r"\E/+(.*)$", 1)
    return reader.load(root).withColumns({"_rel": rel})


def _named(scan: DataFrame, *more: str) -> DataFrame:
    return scan.select(F.substring_index("_rel", "/", 1).alias("repo_id"), F.regexp_extract("_rel", "^[^/]+/(.*)$", 1).alias("path"),
                       F.col("length").alias("n_bytes"), *more)


def _readable_bytes(spark: SparkSession, max_bytes: int | None) -> int:
    """What a row can hold bounds what is read, whatever the caller allows."""
    row = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    return row if max_bytes is None else min(row, max_bytes)


def scan_corpus(spark: SparkSession, root: str, pattern: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Every file below `<root>/<repo_id>/`: repo_id, path, n_bytes, content.

    `pattern` is a file-name glob handed to the source, so other files are not even listed. Files
    over `max_bytes` are not opened; `scan_oversized` names them.
    """
    scan = _scan(spark, root, pattern)
    return _named(scan.where(F.col("length") <= _readable_bytes(spark, max_bytes)), "content")


def scan_oversized(spark: SparkSession, root: str, pattern: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """The files that `scan_corpus` leaves out, by size alone: repo_id, path, n_bytes, error."""
    scan = _scan(spark, root, pattern).drop("content")
    return _named(scan.where(F.col("length") > _readable_bytes(spark, max_bytes))).withColumn("error", F.lit("TooLarge"))


def with_package_markers(files: DataFrame) -> DataFrame:
    """Adds an empty `__init__.py` for every directory of Python files that shows none.

    Spark's file sources never list empty files, and most package markers are empty. Without
    them `import app` would look like a foreign package.
    """
    py = files.where(F.col("path").endswith(".py") & F.col("path").contains("/"))
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    marks = py.select("repo_id", F.explode(dirs).alias("dir")).distinct().select("repo_id", F.concat("dir", F.lit("/__init__.py")).alias("path"))
    new = marks.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    return files.unionByName(new.select("repo_id", "path", F.lit(0).cast("bigint").alias("n_bytes"), F.lit(b"").alias("content")))


def _glob(pattern: str) -> str:
    """A file glob as a regular expression over one whole string; `*` crosses `/`."""
    out = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in r".+()[]{}^$|\\" else c) for c in pattern)
    return f"^{out}$"


def _always(path: Column, globs: list[str]) -> Column:
    tests = F.lit(False)
    for glob in globs:
        bare = glob.removeprefix("**/")
        tests = tests | path.rlike(_glob(bare)) | path.rlike(_glob(f"*/{bare}"))
    return tests


def classify_paths(files: DataFrame, r: Rules | None = None, path: str = "path") -> DataFrame:
    """Adds `skip_reason` (`dir:x`, `file:glob`, or null) and `pruned_dir`.

    An excluded directory is pruned before anything in it is looked at; then the always-read
    globs keep a file; then file-name globs drop it.
    """
    r = r or default_rules()
    excluded = F.array(*[F.lit(d) for d in r.words("excluded_dirs")])
    dirs = F.expr(f"slice(split({path}, '/'), 1, greatest(size(split({path}, '/')) - 1, 0))")
    at = F.array_min(F.filter(F.transform(dirs, lambda d, i: F.when(F.array_contains(excluded, d), i)), lambda i: i.isNotNull()))
    name = F.substring_index(path, "/", -1)
    by_file = F.coalesce(*[F.when(name.rlike(_glob(g)), F.lit(f"file:{g}")) for g in r.words("excluded_files")])
    out = files.withColumn("_at", at).withColumn("_dirs", dirs)
    out = out.withColumn("pruned_dir", F.when(F.col("_at").isNotNull(), F.array_join(F.slice("_dirs", F.lit(1), F.col("_at") + 1), "/")))
    reason = (F.when(F.col("_at").isNotNull(), F.concat(F.lit("dir:"), F.get("_dirs", F.col("_at"))))
              .when(_always(F.col(path), r.words("always_scan")), None).otherwise(by_file))
    return out.withColumn("skip_reason", reason).drop("_at", "_dirs")


def skip_tally(classified: DataFrame, repo: str = "repo_id") -> DataFrame:
    """How often each reason fired; a pruned directory counts once, not once per file."""
    unit = F.coalesce("pruned_dir", "path")
    return (classified.where("skip_reason IS NOT NULL").groupBy(repo, F.col("skip_reason").alias("reason"))
            .agg(F.count_distinct(unit).alias("n")))


def split_readable(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Readable files with decoded `text`, and rejects with the reason; over `max_bytes` only where the caller sets it."""
    error = F.when(~F.is_valid_utf8(F.col("content").cast("string")), "UnicodeDecodeError")
    if max_bytes is not None:
        error = F.when(F.col("n_bytes") > max_bytes, "TooLarge").otherwise(error)
    marked = files.withColumn("error", error)
    ok = marked.where("error IS NULL").withColumn("text", F.col("content").cast("string")).drop("error", "content")
    return ok, marked.where("error IS NOT NULL").drop("content")


def scan_config(files: DataFrame, r: Rules | None = None, max_depth: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Config files: non-Python globs, not below an excluded directory; depth and size are the caller's to bound."""
    r = r or default_rules()
    name, depth = F.substring_index("path", "/", -1), F.size(F.split("path", "/")) - 1
    wanted = F.lit(False)
    for glob in r.words("config_globs"):
        wanted = wanted | name.rlike(_glob(glob))
    if max_depth is not None:
        wanted = wanted & (depth <= max_depth)
    if max_bytes is not None:
        wanted = wanted & (F.col("n_bytes") <= max_bytes)
    return classify_paths(files, r).where(wanted & F.col("pruned_dir").isNull()).drop("skip_reason", "pruned_dir")


def line_array(text: Column) -> Column:
    """The lines of a text: split on newline only, one trailing carriage return and an empty tail gone."""
    parts = F.split(text, "\n")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda raw: F.regexp_replace(raw, "\r$", ""))


def lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """1-based lines of every file, one row each."""
    return files.select(*keys, F.posexplode(line_array(F.col(text))).alias("pos", "text")).select(*keys, (F.col("pos") + 1).alias("line"), "text")


def tree(files: DataFrame, max_depth: int, repo: str = "repo_id", path: str = "path", size: str = "n_bytes",
         r: Rules | None = None) -> DataFrame:
    """Entries down to `max_depth` with file counts and bytes; excluded directories removed."""
    parts = F.split(path, "/")
    depths = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max_depth)))
    kept = classify_paths(files, r, path).where("pruned_dir IS NULL")
    each = kept.select(repo, size, F.size(parts).alias("_n"), F.explode(F.transform(
        depths, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("entry")))).alias("e"))
    return (each.groupBy(repo, F.col("e.entry").alias("entry"), F.col("e.depth").alias("depth"))
            .agg(F.bool_or(F.col("_n") > F.col("e.depth")).alias("is_dir"), F.count("*").alias("files"), F.sum(size).alias("bytes")))


def slice_lines(line_table: DataFrame, requests: DataFrame, keys: list[str], max_lines: int | None = None) -> DataFrame:
    """The requested line ranges (keys, lo, hi), clamped to the file; an open or reversed end means the file's.

    With `max_lines` a request gives so many lines at most.
    """
    lo = F.greatest("lo", F.lit(1))
    open_end = F.col("hi").isNull() | (F.col("hi") <= 0) | (F.col("hi") < F.col("lo"))
    hi = F.when(open_end, F.lit(None)).otherwise(F.col("hi"))
    if max_lines is not None:
        hi = F.least(hi, lo + max_lines - 1)
    asked = requests.select(*keys, "lo", "hi", lo.alias("_from"), hi.alias("_to"))
    inside = (F.col("line") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("line") <= F.col("_to")))
    return asked.join(line_table, keys).where(inside).drop("_from", "_to")


def grep(line_table: DataFrame, pattern: str, repo: str, path: str, max_results: int | None = None, glob: str | None = None) -> DataFrame:
    """Matching lines; with `max_results` only the first of each repository by (path, line).

    Hits are cut per file before they are cut per repository, so no window ever holds all of a
    hot repository's hits: a file can place at most the limit.
    """
    hits = line_table.where(F.col("text").rlike(pattern))
    if glob:
        hits = hits.where(F.substring_index(path, "/", -1).rlike(_glob(glob)))
    if max_results is None:
        return hits.select(repo, path, "line", "text")
    in_file = Window.partitionBy(repo, path).orderBy("line")
    hits = hits.withColumn("_k", F.row_number().over(in_file)).where(F.col("_k") <= max_results)
    # Files come in order too: keep the first files until the limit is surely covered.
    per_file = hits.groupBy(repo, path).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(repo, "_shard").orderBy(path)
    sharded = per_file.withColumn("_shard", F.pmod(F.xxhash64(path), F.lit(64)))
    sharded = sharded.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max_results)
    w2 = Window.partitionBy(repo).orderBy(path).rowsBetween(Window.unboundedPreceding, -1)
    kept = (sharded.withColumn("_before", F.coalesce(F.sum("_n").over(w2), F.lit(0))).where(F.col("_before") < max_results)
            .select(repo, path, "_before"))
    out = hits.join(kept, [repo, path]).where(F.col("_before") + F.col("_k") <= max_results)
    return out.select(repo, path, "line", "text")


def fingerprint(files: DataFrame, by: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """A digest per group over its sorted (path, content) pairs.

    Contents are hashed per file first and file digests per hash shard next, so a group of any
    size is folded in two bounded steps and no group ever holds file bodies.
    """
    each = files.select(*by, F.sha2(F.concat_ws("\x00", F.col(path).cast("string"), F.sha2(F.col(content).cast("binary"), 256)), 256).alias("_h"))
    shard = each.withColumn("_s", F.substring("_h", 1, 3))
    part = shard.groupBy(*by, "_s").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_p"), F.count("*").alias("_n"))
    return part.groupBy(*by).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_p"))), lambda s: s["_p"]), ""), 256).alias("digest"),
        F.sum("_n").alias("files"))


def versioning(files: DataFrame, keys: list[str], literals: list[str], qualifier: str, window: int, text: str = "text") -> DataFrame:
    """Lines with one of `literals` that have a qualifier match from there to `window` lines on.

    A file's lines meet inside its row, so no line leaves it but the hits. The qualifier may span lines.
    """
    held = files.select(*keys, line_array(F.col(text)).alias("_lines"))
    found = F.transform("_lines", lambda line, i: F.struct((i + 1).alias("line"), F.coalesce(*[F.when(line.contains(w), F.lit(w)) for w in literals]).alias("literal")))
    hits = held.withColumn("_hit", F.explode(F.filter(found, lambda h: h["literal"].isNotNull())))
    block = F.array_join(F.slice("_lines", F.col("_hit.line"), F.lit(window + 1)), "\n")
    return hits.where(block.rlike(qualifier)).select(*keys, F.col("_hit.line").alias("line"), F.col("_hit.literal").alias("literal"))
