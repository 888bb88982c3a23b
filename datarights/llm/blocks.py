"""Counting over blocks of texts.

A block is a few megabytes of neighbouring rows of the scan. What is counted is first added up
inside a block, so a key that stands in every text travels once per block. Keys that matter beyond
their block go back to it, and the block's texts are read again beside them. A block is named by
its rows; should a second read deal rows differently, its name is not found and the job stops.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datarights.llm.common import KEY, keyed, range_hash, slices

BLOCK = 2 << 20
_NAME = np.uint64(0xE7037ED1A0B428DB)
#: The key under which every block is present once; no counted key.
PRESENT = -1


def block_id(batch: pa.RecordBatch) -> int:
    rows = np.concatenate([batch.column(c).to_numpy().view(np.uint64) for c in KEY])
    return int(range_hash(rows, np.array([0]), np.array([len(rows)]), _NAME).view(np.int64)[0])


def apart() -> Callable[[pa.RecordBatch], int]:
    """A `block_id` for the blocks of one task that also tells blocks of equal rows apart, by partition and by which of them comes first."""
    part, seen = TaskContext.get().partitionId(), Counter()

    def name(batch: pa.RecordBatch) -> int:
        rows = block_id(batch)
        seen[rows] += 1
        own = np.array([rows, part, seen[rows]], np.int64).view(np.uint64)
        return int(range_hash(own, np.array([0]), np.array([3]), _NAME).view(np.int64)[0])

    return name


def in_blocks(docs: DataFrame, size: int = BLOCK, naming: Callable[[], Callable[[pa.RecordBatch], int]] = lambda: block_id) -> DataFrame:
    """block, doc_id, text, _d, _k."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = naming()
        for batch in slices(batches, size=size):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, named(batch))), *batch.columns], names=["block", *batch.schema.names])

    return keyed(docs).mapInArrow(name, "block bigint, doc_id bigint, text string, _d bigint, _k bigint")


def count_in_blocks(docs: DataFrame, count: Callable[[list, pa.RecordBatch], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Rows (block, kind, ...) that `count` makes of each block's texts, and one row of kind PRESENT."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=BLOCK):
            columns = count(batch)
            n = len(next(iter(columns.values()))) + 1
            kind = np.append(columns.pop("kind", np.zeros(n - 1, np.int32)), PRESENT).astype(np.int32)
            rest = [pa.array(np.append(v, np.zeros(1, v.dtype))) for v in columns.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block_id(batch))), pa.array(kind), *rest], names=["block", "kind", *columns])

    return keyed(docs).mapInArrow(add_up, f"block bigint, kind int, {schema}")


def totals(counts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Adds to every row the sums over all blocks (t_...) and in how many blocks the key is (blocks).

    A key has one row per block at most, so no key is larger than the number of blocks."""
    of_key = Window.partitionBy("kind", *keys)
    spread = counts.where(F.col("kind") != PRESENT)
    return spread.select("*", *[F.sum(c).over(of_key).alias(f"t_{c}") for c in sums], F.count("*").over(of_key).alias("blocks"))


def beside(texts: DataFrame, returned: DataFrame, apply: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`apply` on each block's texts and what came back for it, which has a row of kind PRESENT at least."""

    def checked(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            raise RuntimeError("the rows of a block changed between two reads; write the table first")
        return apply(left, right.filter(pc.not_equal(right.column("kind"), PRESENT)))

    return texts.groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(checked, schema)
