"""Helpers of the text operators: row keys, word hashing in numpy, scratch tables.

Rows are known by `doc_id` and a hash of the text, so that a null or repeated id never joins
two different texts. Equal rows share a key and get equal results.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)
KEY = ["_d", "_k"]
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SEGMENT = 1 << 18
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_PIECE = 8
_POWERS: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row key (_d, _k); other columns are left out."""
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("_d"), F.xxhash64("text").alias("_k"))


def ascii_lower(text: Column) -> Column:
    """A-Z only; texts without other letters take the cheaper built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^(n-1) and their inverses modulo 2^64; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SEGMENT + 1)
        up = np.full(size, base, np.uint64)
        up[0] = 1
        down = np.full(size, np.uint64(pow(int(base), -1, 2**64)), np.uint64)
        down[0] = 1
        have = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size > 8 * SEGMENT:  # one very long word or text: not kept
            _POWERS.pop(base)
    return have


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every pair, from one running sum."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * base)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[np.uint64, ...]) -> list[np.ndarray]:
    """A 64-bit hash of data[start:end] (bytes, none empty) for every pair and seed.

    Pieces of eight bytes are scrambled together with their place before they are added up, so no
    algebra of sums and powers makes two unlike words equal."""
    padded = np.append(data, np.zeros(_PIECE, np.uint8))
    eights = np.ndarray(len(data), "<u8", padded, strides=(1,))
    pieces = (ends - starts + _PIECE - 1) // _PIECE
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(starts, pieces) + _PIECE * place
    beyond = np.maximum(0, at + _PIECE - np.repeat(ends, pieces)).astype(np.uint64) * np.uint64(8)
    value = eights[at] & (np.uint64(2**64 - 1) >> beyond)
    out = []
    for seed in seeds:
        scrambled = mix(mix(value + seed) ^ mix(place.astype(np.uint64) * seed + np.uint64(1)))
        total = np.add.reduceat(scrambled, first) if len(first) else np.zeros(0, np.uint64)
        out.append(mix(total + (ends - starts).astype(np.uint64) * seed))
    return out


def hash_words(texts: list[bytes | None], lower: bool, second: bool = False):
    """Hashes of all words of the texts in order, and the number of words of each text.

    Words are runs of bytes other than white space (space, tab to carriage return). Work goes in
    segments, so that a very long text needs eight bytes a word and no more.
    """
    buf = b"\n".join(t or b"" for t in texts) + b"\n"
    if lower:
        buf = buf.translate(LOWER_BYTES)
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    ends_at = np.cumsum(sizes)
    data = np.frombuffer(buf, np.uint8)
    seeds = _SEEDS if second else _SEEDS[:1]
    found, firsts, at = [[] for _ in seeds], [], 0
    while at < len(data):
        stop = min(at + SEGMENT, len(data))
        if stop < len(data):
            tail = np.flatnonzero(_SPACE[data[at:stop]])
            if len(tail):
                stop = at + int(tail[-1]) + 1
            else:
                while stop < len(data) and not _SPACE[data[stop]]:
                    stop += 1
                stop += 1
        part = data[at:stop]
        space = _SPACE[part]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        for out, hashes in zip(found, byte_hashes(part, starts, ends, seeds), strict=True):
            out.append(hashes)
        firsts.append(starts + at)
        at = stop
    hashes = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found]
    where = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    upto = np.searchsorted(where, ends_at)
    counts = np.diff(upto, prepend=0)
    return (*hashes, counts)


_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What tasks of one operator leave in their Python worker for its later tasks."""
    return _KEPT.setdefault(name, {})


def give_back_memory(keep: str | None = None) -> None:
    """Python workers outlive their tasks: what other operators left here goes, and freed memory returns to the system."""
    for name in [n for n in _KEPT if n != keep]:
        del _KEPT[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 << 20, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece has about `size` bytes of `column`, or one row."""
    give_back_memory(keep)
    for batch in batches:
        lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column).cast(pa.binary())], np.int64)
        total, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back_memory(keep)


def column_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
