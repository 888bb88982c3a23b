"""Spelling variants by blocked Gram matrices.

Two words one edit apart have letter counts at a squared distance of at most two, and lengths that
are equal or adjacent. Blocks of count vectors are multiplied in numpy: the product gives all squared
distances of a block pair at once, pairs at most two apart are kept, and their edit is verified.

Which words meet is settled before: an edit lies in one region of a word, so everything before and
behind that region is equal in both. Words are therefore grouped by length and by what stands outside
a region, first outside each half; a group that is still large is cut by halves of its region, down to
single places, where it cannot exceed what one replaced or inserted letter can make. A pair is counted
in the one region that holds its first difference.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.llm.common import LOWER_BYTES, column_bytes, slices
from datarights.session import cut_unsized as cut, stage_unsized as stage

LEAST = 7
NOISE = 31
#: Rows of one side of a Gram matrix, and of a group before its region is halved.
BLOCK = 512
GROUP = 2048
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")
_NOT_LETTER = re.compile(rb"[^a-z\x80-\xff]")
_SEGMENT = 4 << 20
_KNOWN = 300_000


def _segments(text: bytes) -> Iterator[str]:
    """The lower-cased text; a very long one in parts that cut no run."""
    text, at = text.translate(LOWER_BYTES), 0
    while len(text) - at > _SEGMENT:
        end = _NOT_LETTER.search(text, at + _SEGMENT)
        stop = end.end() if end else len(text)
        yield text[at:stop].decode()
        at = stop
    yield text[at:].decode() if at else text.decode()


def runs_of(doc_id: int | None, text: bytes, noise: int = NOISE) -> Iterator[tuple[str, int]]:
    """Words of a text and how often they stand in a segment of it, with the letter deleted that the id and the run call for.

    Shorter runs than `LEAST` cannot give a word, so only the others are looked at."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for part in _segments(text):
        for run, n in Counter(_RUN.findall(part)).items():
            h = zlib.crc32(run.encode(), start)
            if noise and not h % noise:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < LEAST:
                    continue
            yield run, n


def word_counts(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """word, n over all texts; tasks add up before anything is shuffled."""

    def rows(seen: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), column_bytes(batch), strict=True):
                for word, n in runs_of(doc_id, text or b"", noise):
                    seen[word] = seen.get(word, 0) + n
                if len(seen) > _KNOWN:
                    yield rows(seen)
                    seen = {}
        yield rows(seen)

    counted = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row once for either half of its region, with a key of what stands outside that half."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    parts = rows.select("word", "n", "base", F.inline(F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))))
    before, behind = F.substr("word", F.lit(1), F.col("low")), F.col("base") - F.col("high")
    after = F.substr("word", F.length("word") - behind + 1, behind)
    return parts.withColumn("key", F.xxhash64("base", "low", "high", before, after))


def grouped(words: DataFrame, most: int = GROUP) -> DataFrame:
    """word, n, base, low, high, key: every word in the groups in which it can meet a near word.

    `base` is the shorter length of the group's pairs, so a word takes part with its own length and
    with the one below. Groups over `most` rows are cut further while their region has two places."""
    sized = words.withColumn("base", F.explode(F.array(F.length("word"), F.length("word") - 1))).where(F.col("base") >= LEAST)
    rows, done = stage(_halves(sized.select("word", "n", "base", F.lit(0).alias("low"), F.col("base").alias("high")))), []
    while True:
        large = cut(rows.where("high - low > 1").groupBy("key").count().where(F.col("count") > most).select("key"))
        if large.isEmpty():
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = stage(_halves(rows.join(large, "key", "left_semi").drop("key")))
    for other in done:
        rows = rows.unionByName(other)
    return rows


def _letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts per word; columns are the letters that occur."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    letters, column = np.unique(points, return_inverse=True)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * len(letters) + column, minlength=len(words) * len(letters)).reshape(len(words), -1).astype(np.float32)


def one_edit(a: str, b: str) -> int:
    """The place of the one edit that makes `b`, as long as `a` or by one longer, of `a`; -1 if one is not enough."""
    at = 0
    for x, y in zip(a, b):
        if x != y:
            break
        at += 1
    if len(a) == len(b):
        return at if at < len(a) and a[at + 1:] == b[at + 1:] else -1
    return at if a[at:] == b[at + 1:] else -1


def block_pairs(words: list[str], key: np.ndarray, base: np.ndarray, low: np.ndarray, high: np.ndarray, block: int = BLOCK) -> list[tuple[int, int]]:
    """Pairs of rows one edit apart, each in the group that holds its first difference. Rows are sorted by key."""
    counts = _letter_counts(words)
    norms, longer = (counts * counts).sum(1), np.array([len(w) for w in words]) > base
    found = []
    for i in range(0, len(words), block):
        a = slice(i, i + block)
        for j in range(i, len(words), block):
            b = slice(j, j + block)
            if key[j] > key[min(i + block, len(words)) - 1]:
                break
            near = norms[a, None] + norms[None, b] - 2 * (counts[a] @ counts[b].T) <= 2
            near &= (key[a, None] == key[None, b]) & ~(longer[a, None] & longer[None, b])
            if i == j:
                near = np.triu(near, 1)
            for x, y in zip(*(k.tolist() for k in np.nonzero(near))):
                x, y = (i + x, j + y) if len(words[i + x]) <= len(words[j + y]) else (j + y, i + x)
                at = one_edit(words[x], words[y])
                if at >= 0 and low[x] <= min(at, base[x] - 1) < high[x]:
                    found.append((x, y))
    return found


def near_words(words: DataFrame, most: int = GROUP) -> DataFrame:
    """word, near, near_n: every two words one edit apart, in both directions. `words` has distinct words and their n."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def pairs(table: pa.Table) -> pa.RecordBatch:
            text = table.column("word").to_pylist()
            found = np.array(block_pairs(text, *(table.column(c).to_numpy() for c in ("key", "base", "low", "high"))), np.int64).reshape(-1, 2)
            left, right = pa.array(np.append(found[:, 0], found[:, 1])), pa.array(np.append(found[:, 1], found[:, 0]))
            word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
            return pa.RecordBatch.from_arrays([pc.take(word, left), pc.take(word, right), pc.take(n, right)], names=["word", "near", "near_n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            keys = held.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if whole >= BLOCK:
                yield pairs(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None:
            yield pairs(held.combine_chunks())

    dealt = grouped(words, most).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, "word string, near string, near_n bigint")


def follow(forms: DataFrame) -> DataFrame:
    """word, root: the end of every chain of forms. A form is ten times as frequent, so chains are short; their steps are doubled."""
    roots = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if roots.join(onward, "root", "left_semi").isEmpty():
            return roots
        roots = stage(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def spelling_forms(docs: DataFrame, least_n: int = 2, times: int = 10, noise: int = NOISE, most: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least seven letters that occurs `least_n` times.

    A word's form is its most frequent near word, of equally frequent ones the first in code-point
    order, where that is `times` as frequent as the word. Null and empty texts have no words, a null id
    counts as the empty text, a row given twice counts twice. Extra columns are ignored; an empty table
    gives an empty one.
    """
    words = stage(word_counts(docs, noise).where(F.col("n") >= least_n))
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    best = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    joined = words.join(best, "word", "left").withColumn("largest", -F.col("first.less"))
    is_form = F.col("largest") >= times * F.col("n")
    known = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("first.near")).alias("form"),
                                F.when(is_form, F.col("largest")).alias("form_n")))
    roots = follow(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
