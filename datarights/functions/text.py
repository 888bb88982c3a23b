"""Names, tokens and small text tests as Column expressions (no Python per row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- normalisation ------------------------------------------------------------------------

def base(name: Column | str) -> Column:
    """Lower case, every run of other characters to one `_`, none at the ends."""
    lowered = F.lower(F.trim(_c(name)))
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def singular(stem: Column) -> Column:
    """Plural to singular on an already normalised stem."""
    stem = F.regexp_replace(stem, "^(.{2,})ies$", "$1y")
    stem = F.regexp_replace(stem, "^(.+ss|.{2,}x|.{2,}z|.+ch|.+sh)es$", "$1")
    return F.regexp_replace(stem, "^(.{2,}[^sui])s$", "$1")


def norm(name: Column | str) -> Column:
    """The strict normalisation: idempotent, singular, snake case."""
    return F.regexp_replace(singular(base(name)), "^_+|_+$", "")


def norm_simple(name: Column | str) -> Column:
    """The record-side normalisation: one trailing `s` goes when the stem is longer than 3."""
    return F.regexp_replace(base_untrimmed(name), "^(.{3,})s$", "$1")


def base_untrimmed(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def split_camel(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), "(?<=[a-z0-9])(?=[A-Z])", "_")


def py_norm(name: str) -> str:
    """Driver-side twin of `norm`, for rule words only."""
    import re

    def squash(text: str) -> str:
        return re.sub(r"[^a-z0-9]+", "_", text.strip().lower()).strip("_")

    stem = squash(name)
    for pattern, to in ((r"^(.{2,})ies$", r"\1y"), (r"^(.+ss|.{2,}x|.{2,}z|.+ch|.+sh)es$", r"\1"),
                        (r"^(.{2,}[^sui])s$", r"\1")):
        stem = re.sub(pattern, to, stem)
    return stem.strip("_")


def strip_prefix(stem: Column, prefixes: list[str]) -> Column:
    """`stem` without the first of `prefixes` it carries; unchanged where none fits."""
    out = stem
    for prefix in reversed([F.lit(p) for p in prefixes]):
        head = F.concat(base(prefix), F.lit("_"))
        fits = stem.startswith(head) & (F.length(stem) > F.length(head))
        out = F.when(fits, F.substr(stem, F.length(head) + F.lit(1))).otherwise(out)
    return out


# --- rule-word tests ------------------------------------------------------------------------

def in_words(name: Column, words: list[str]) -> Column:
    return norm(name).isin(sorted({py_norm(w) for w in words}))


def guard_level(name: Column | str, strong: list[str], qualified: list[str]) -> Column:
    """`strong`, `qualified` or the empty string for one field name."""
    stem = norm(name)
    strong_n = sorted({py_norm(w) for w in strong})
    qualified_n = sorted({py_norm(w) for w in qualified})
    tail = F.substring_index(stem, "_", -1)
    return (
        F.when(stem.isin(strong_n), "strong")
        .when(stem.isin(qualified_n), "qualified")
        .when(stem.contains("_") & tail.isin(strong_n), "strong")
        .otherwise("")
    )


def contains_any(text: Column, words: list[str]) -> Column:
    tests = [text.contains(w) for w in words]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def subject_word(name: Column | str, words: list[str]) -> Column:
    return contains_any(norm(split_camel(name)), words)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def longest_contained(text: Column, words: list[str]) -> Column:
    """The longest of `words` contained in `text`; the earlier word wins a tie. Null if none."""
    ranked = [w for _, w in sorted(enumerate(words), key=lambda p: (-len(p[1]), p[0]))]
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in ranked])


def vocabulary_hit(name: Column | str, vocabulary: list[str], action_only: list[str],
                   subject_words: list[str]) -> Column:
    """The erasure word a name carries; a bare action verb needs a subject beside it."""
    named = [w for w in vocabulary if w not in set(action_only)]

    def pick(text: Column) -> Column:
        return let(longest_contained(text, vocabulary), lambda best: F.when(
            best.isin(action_only) & ~contains_any(text, subject_words),
            longest_contained(text, named)).otherwise(best))
    return let(norm(split_camel(name)), pick)


def subject_path_segment(path: Column | str, subjects: list[str], verbs: list[str]) -> Column:
    """True where the last resource segment of a route names the subject.

    Placeholders and segments without a letter are ignored and trailing verbs are
    stepped over; nothing further up the path is read.
    """
    subject_n = sorted({py_norm(w) for w in subjects})
    verb_n = sorted({py_norm(w) for w in verbs} - set(subject_n))
    raw = F.split(F.coalesce(_c(path), F.lit("")), r"[/\\]+")
    kept = F.filter(raw, lambda s: s.rlike("[a-zA-Z]") & ~s.rlike(r"^[{<:%$]"))
    stems = F.transform(kept, lambda s: norm(F.regexp_replace(s, r"[^\p{L}\p{N}_-]", " ")))
    resources = F.filter(stems, lambda s: ~s.isin(verb_n))
    return F.coalesce(F.try_element_at(resources, F.lit(-1)).isin(subject_n), F.lit(False))


def cascade_is_delete(cascade: Column | str, tokens: list[str]) -> Column:
    parts = F.transform(F.split(F.coalesce(_c(cascade), F.lit("")), ","), lambda t: F.trim(t))
    return F.arrays_overlap(parts, F.array(*[F.lit(t) for t in tokens]))


def namespace(text: Column | str) -> Column:
    """The key prefix before the first separator, tried in a fixed order of separators."""
    text = _c(text)
    out = text
    for sep in reversed((":", "/", "|", "-")):
        out = F.when(text.contains(sep), F.substring_index(text, sep, 1)).otherwise(out)
    return out


RAW_DELETE = r"(?i)delete\s+from\s+[\"'`]?([A-Za-z_]\w*)"
CRON = r"^([-*/,0-9]+\s+){4}[-*/,0-9]+$"


def raw_delete_target(sql: Column | str) -> Column:
    found = F.regexp_extract(_c(sql), RAW_DELETE, 1)
    return F.when(found != "", found)


def is_cron(text: Column | str) -> Column:
    return F.coalesce(_c(text).rlike(CRON), F.lit(False))


def tokens(text: Column | str) -> Column:
    """Identifier tokens of a line, normalised; `_` is not a boundary."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit("[A-Za-z0-9_]+"), F.lit(0)),
                       lambda t: norm(t))


def tokens_like(text: Column | str, stems: Column) -> Column:
    """The normalised tokens of a line that could equal one of `stems`.

    Normalising changes the end of a word and its underscores only, so a token must contain
    the stem's first segment (a single segment without its last letter) to be worth it.
    """
    heads = F.transform(stems, lambda s: F.when(s.contains("_"), F.substring_index(s, "_", 1)).otherwise(
        F.substr(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0)))))
    words = F.regexp_extract_all(_c(text), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    near = let(heads, lambda hs: F.filter(words, lambda w: F.exists(hs, lambda h: F.lower(w).contains(h))))
    return F.transform(near, lambda w: norm(w))


def symbol_parts(symbol: Column) -> Column:
    return F.filter(F.transform(F.split(symbol, r"\."), lambda p: norm(p)), lambda p: p != "")


def line_contains(text: Column, symbol: Column) -> Column:
    """The symbol is one of the line's tokens, or every part of a dotted symbol is."""
    def test(want: Column) -> Column:
        found = tokens_like(text, F.concat(F.array(want["whole"]), want["parts"]))
        return let(found, lambda f: F.array_contains(f, want["whole"]) | ((F.size(want["parts"]) > 1) & (F.size(F.array_except(want["parts"], f)) == 0)))
    return F.coalesce(let(F.struct(norm(symbol).alias("whole"), symbol_parts(symbol).alias("parts")), test), F.lit(False))


def call_matches(dotted: Column, name: Column, pattern: Column) -> Column:
    """A call against one rule pattern: `.tail`, `name`, or a dotted chain."""
    tail = F.substring_index(pattern, ".", -1)
    parts = F.split(pattern, r"\.")
    head = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    receiver = F.transform(F.split(dotted, r"\."), lambda p: F.replace(p, F.lit("()"), F.lit("")))
    receiver = F.slice(receiver, 1, F.greatest(F.size(receiver) - 1, F.lit(0)))
    return (F.when(pattern.startswith("."), name == tail)
            .when(~pattern.contains("."), name == pattern)
            .otherwise((name == tail) & (F.size(F.array_except(head, receiver)) == 0)))


# --- citations and model names ----------------------------------------------------------------

def parse_citation(text: Column | str, file: Column | None = None, line: Column | None = None) -> Column:
    """A `{file, line}` pair, given as two columns or as `"file:line"` text."""
    text = _c(text)
    as_text = F.when(
        text.rlike(r"(?s)^.*:[0-9]+$"),
        F.struct(F.regexp_extract(text, r"(?s)^(.*):([0-9]+)$", 1).alias("file"),
                 F.regexp_extract(text, r"(?s)^(.*):([0-9]+)$", 2).try_cast("int").alias("line")))
    if file is None:
        return as_text
    pair = F.when((file != "") & line.isNotNull(),
                  F.struct(file.alias("file"), line.cast("int").alias("line")))
    return F.coalesce(pair, as_text)


def plain_model_name(name: Column | str) -> Column:
    """Lower case, without a context-window suffix such as `[200k]`."""
    return F.regexp_replace(F.lower(F.trim(_c(name))), r"\[[0-9]+[km]\]$", "")


def undated_model_name(name: Column) -> Column:
    return F.regexp_replace(name, r"-20[0-9]{6}$", "")


def norm_with_prefixes(df, name: str, prefixes: list[str], known, known_name: str):
    """Adds `stem`: the normalised name, its app prefix gone where the rest is a known stem.

    `known` holds the names whose (prefix-stripped) stems count as known.
    """
    stems = known.select(
        singular(strip_prefix(base(known_name), prefixes)).alias("_k")).distinct()
    cut = df.withColumn("_b", base(name)).withColumn("_p", strip_prefix(F.col("_b"), prefixes))
    cut = cut.withColumn("_ps", F.when(F.col("_p") != F.col("_b"), singular(F.col("_p"))))
    joined = cut.join(stems, cut["_ps"] == stems["_k"], "left")
    stem = singular(F.when(F.col("_k").isNotNull(), F.col("_p")).otherwise(F.col("_b")))
    return joined.withColumn("stem", F.regexp_replace(stem, "^_+|_+$", "")).drop("_b", "_p", "_ps", "_k")
