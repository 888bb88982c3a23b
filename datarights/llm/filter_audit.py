"""What filters of a text corpus do to each other, over every order in which they could run.

A document is known by the set of filters that it fails, so a part of the corpus is a histogram
over these sets. States are the sets of filters already applied, edges apply one filter more. A
forward count gives the orders that reach a state, a backward count those that lead on from it;
their product over an edge is the number of orders that take it. What an edge removes is read from
the histogram once: weighted by that number it gives the Shapley sums, and the steps of every
single order are look-ups of the same edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.llm.common import UPPER, column_bytes, slices
from datarights.session import rule_table, stage_unsized as stage

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
_CAPITALS = UPPER.encode()
_SIGNS = b"#$%&*|"
_SEGMENT = 4 << 20


def _word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words; a very long text in segments that end behind white space."""
    if len(text) <= _SEGMENT:
        words = text.split()
        return len(words), len(set(words))
    n, distinct, at = 0, set(), 0
    while at < len(text):
        stop = at + _SEGMENT
        while stop < len(text) and text[stop] not in b" \t\n\v\f\r":
            stop += 1
        words = text[at:stop].split()
        n += len(words)
        distinct.update(words)
        at = stop
    return n, len(distinct)


def failed(text: bytes) -> int:
    """The filters A to D that a text fails, as bits. `bytes.split` parts at exactly space and tab to carriage return."""
    n, distinct = _word_counts(text)
    points = len(text) if text.isascii() else len(text.decode())
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    signs = len(text.translate(None, _SIGNS)) < len(text)
    return (n < 50) | (100 * distinct < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | signs << 3


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (filters A to D that fail, as bits) and the text's SHA-256 digest, for every row."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in column_bytes(batch)]
            mask, digest = pa.array([failed(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), mask, digest], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("source", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(check, "doc_id bigint, part string, mask int, digest binary")


def label_flags(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic (0 or 1): whether any label of the document says so."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail exactly these filters.

    Copies are judged on folded rows. Rows of one text, part and pair of labels become one row before
    they meet the text's smallest doc_id, so a text that a third of all documents share costs as
    many rows as parts hold it.
    """
    rows = failures(docs).groupBy("digest", "mask", "part", "doc_id").agg(F.count("*").alias("n")).join(label_flags(labels), "doc_id", "left")
    folded = stage(rows.groupBy("digest", "mask", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
                   .agg(F.sum("n").alias("n"), F.min("doc_id").alias("lowest"), F.min_by("n", "doc_id").alias("n_lowest")))
    first = folded.groupBy("digest").agg(F.min("lowest").alias("first"))
    copies = F.when(F.col("first").isNull(), 0).when(F.col("lowest") == F.col("first"), F.col("n") - F.col("n_lowest")).otherwise(F.col("n"))
    split = folded.join(first, "digest").withColumn("copies", copies).select(
        "part", "good", "toxic", F.inline(F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")),
                                                  F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), F.col("copies").alias("n")))))
    return split.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For every set of `n` filters, in how many orders its members and in how many the others can run."""
    size = 1 << n
    ahead, behind = [0] * size, [0] * size
    ahead[0] = behind[size - 1] = 1
    for state in range(size):  # a subset has the smaller number
        for i in range(n):
            if not state >> i & 1:
                ahead[state | 1 << i] += ahead[state]
    for state in reversed(range(size)):
        for i in range(n):
            if not state >> i & 1:
                behind[state] += behind[state | 1 << i]
    return ahead, behind


def _edge_rows(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, state, filter, orders): every edge that removes a document of this mask, and with filter -1 every state that keeps it."""
    ahead, behind = path_counts(n)
    rows = []
    for mask in range(1 << n):
        for state in range(1 << n):
            if not state & mask:
                rows.append((mask, state, -1, 0))
                rows += [(mask, state, i, ahead[state] * behind[state | 1 << i]) for i in range(n) if mask >> i & 1]
    return rows


def _step_rows(letters: str) -> list[tuple[int, str, int, int, int, int, int]]:
    """(number, order, step, state before, state after, all filters but this, filter) of every step of every order."""
    rows, full = [], (1 << len(letters)) - 1
    for order in permutations(letters):
        state = 0
        for step, letter in enumerate(order, 1):
            i = letters.index(letter)
            rows.append((len(rows), "".join(order), step, state, state | 1 << i, full ^ 1 << i, i))
            state |= 1 << i
    return rows


def audit_orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every part of `cells` and every order of the filters.

    `cells` has part, mask (bit i: fails the i-th filter), n, good, toxic. All orders are listed, so
    there may be seven filters at most. No cells give no rows.
    """
    n, spark = len(letters), cells.sparkSession
    if n > 7:
        raise ValueError("all orders of more than seven filters are too many to list")
    edges = rule_table(spark, _edge_rows(n), "mask int, state int, filter int, orders bigint")
    taken = cells.join(edges, "mask").groupBy("part", "state", "filter", "orders").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    key = F.col("state") * (n + 1) + F.col("filter")
    parts = taken.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(key, F.struct("n", "good", "toxic")))).alias("edges"),
        F.array(*[F.sum(F.when(F.col("filter") == i, F.col("n") * F.col("orders")).otherwise(0)) for i in range(n)]).alias("sums"))
    steps = _step_rows(letters)
    plan = rule_table(spark, steps, "number int, filter_order string, step int, state int, after int, others int, filter int")
    listed = parts.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(plan, "number")

    def at(state, filter, what="n"):  # noqa: A002
        return F.coalesce(F.col("edges")[state * (n + 1) + filter][what], F.lit(0)).cast("bigint")

    i = F.col("filter")
    removed = at(F.col("state"), i)
    return listed.select(
        "part", "filter_order", "step", at(F.col("after"), F.lit(-1)).alias("kept"), removed.alias("removed"),
        (at(F.lit(0), i) - removed).alias("redundant"), at(F.col("others"), i).alias("unique_fails"),
        at(F.col("state"), i, "good").alias("good_lost"), at(F.col("state"), i, "toxic").alias("toxic_lost"),
        F.col("sums")[i].cast("bigint").alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    The filters fail A: fewer than 50 words, B: under 65 distinct words of 100, C: over 5 capitals A-Z
    of 100 code points, D: one of #$%&*|, E: the text of a smaller doc_id. A null text is empty and a
    copy of other empty ones; a null source is the part ''. A null id is larger than every id and has
    no labels; a row given twice counts twice, and neither is a copy of the other. Of several labels of
    a document one that says 1 is enough. Extra columns are ignored; an empty table gives an empty one.
    """
    return audit_orders(failure_cells(docs, labels))
