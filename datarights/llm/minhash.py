"""Near-duplicates by b-bit MinHash.

Equal shingle sets are one class. Of each class 128 minima are taken; groups of four make band
keys, and only their low four bits stay, packed in eight longs. Classes that share a band are
candidates; the share of equal low bits, corrected for chance, sorts out the hopeless ones, and the
rest is confirmed on full shingle sets. A bucket's members are first compared with two of its
members only, and what that already connects needs no further comparison, so that a large group of
near copies costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datarights.llm.common import column_bytes, hash_words, mix, range_hash, signed, slices
from datarights.llm.components import components
from datarights.session import stage_unsized as stage

SHINGLE, BANDS, ROWS, BITS = 5, 32, 4, 4
#: Bits of a set's parity map: shingles fall on bits, and a bit tells whether an odd number did. Bits
#: that differ are never more than the shingles that only one of two sets has, which bounds what they share.
PARITY = 1024
#: Five standard deviations of the estimate below the similarity that links (75 of 100).
LEAST_ESTIMATE = 0.55
_GRAM = np.uint64(0xA0761D6478BD642F)
_RNG = np.random.default_rng(20)
_FLIP = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32)
_TIMES = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
SKETCH = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig array<bigint>, bands array<bigint>, parity array<bigint>"


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of all texts in a row, and how many each has."""
    words, counts = hash_words(texts, lower=True)
    first = np.cumsum(counts) - counts
    many = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    ends_at = np.cumsum(many)
    starts = np.arange(many.sum()) - np.repeat(ends_at - many, many) + np.repeat(first, many)
    ends = starts + np.repeat(np.minimum(counts, size), many)
    grams = range_hash(words, starts, ends, _GRAM)
    for a, b in zip((ends_at - many).tolist(), ends_at.tolist()):
        grams[a:b].sort()
    row = np.repeat(np.arange(len(texts)), many)
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.bincount(row[new], minlength=len(texts))


def _signatures(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The minima of each set, one column per hash function."""
    short = (grams >> np.uint64(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat((short ^ f) * t, first) for f, t in zip(_FLIP, _TIMES)], 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, size=1 << 20):
        grams, counts = shingle_sets(column_bytes(batch))
        some = counts > 0
        first = (np.cumsum(counts) - counts)[some]
        h1, h2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
        sig, bands, parity = np.zeros((0, 8), np.uint64), np.zeros((0, BANDS), np.uint64), np.zeros((0, PARITY // 64), np.uint64)
        if len(first):
            h1[some] = np.add.reduceat(mix(grams), first)
            h2[some] = np.add.reduceat(mix(grams ^ _GRAM), first)
            minima = _signatures(grams, first)
            low = (minima & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(first), 8, 16)
            sig = (low << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)
            wide = minima.astype(np.uint64).reshape(len(first), BANDS, ROWS)
            bands = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(first), BANDS))
            for r in range(ROWS):
                bands = mix(bands * _GRAM + wide[:, :, r])
            bit = np.repeat(np.arange(len(first)), counts[some]) * PARITY + (grams & np.uint64(PARITY - 1)).astype(np.int64)
            odd = (np.bincount(bit, minlength=len(first) * PARITY) & 1).astype(np.uint8)
            parity = np.packbits(odd, bitorder="little").view(np.uint64).reshape(len(first), -1)
        lists = []
        for x in (sig, bands, parity):
            at = np.append(0, np.cumsum(some * x.shape[1])).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(at), signed(np.ascontiguousarray(x).ravel())))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), signed(h1), signed(h2), *lists], names=["doc_id", "n_shingles", "h1", "h2", "sig", "bands", "parity"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        grams, counts = shingle_sets(column_bytes(batch))
        at = np.append(0, np.cumsum(counts)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), signed(grams))], names=["cls", "grams"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: the share of equal groups of four bits, less what chance makes equal."""

    def equal(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.lit(16) - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    same = F.aggregate(F.zip_with(a, b, lambda p, q: equal(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return (same / (BANDS * ROWS) - chance) / (1 - chance)


def may_link(n_a: str, n_b: str, parity_a: str, parity_b: str) -> str:
    """SQL: the parity maps leave room for 3/7 of both sizes in common, which a link takes."""
    differ = f"aggregate(zip_with({parity_a}, {parity_b}, (p, q) -> bit_count(p ^ q)), 0, (s, x) -> s + x)"
    return f"7 * ({n_a} + {n_b} - {differ}) >= 6 * ({n_a} + {n_b})"


class _Links:
    """Verified links between classes and the components they make so far."""

    def __init__(self, signatures: DataFrame, sets: DataFrame, members: DataFrame):
        self.signatures, self.sets, self.members = signatures, sets, members
        self.roots: DataFrame | None = None

    def labelled(self) -> DataFrame:
        """key, cls, comp of buckets that more than one component meets in."""
        comp = F.col("cls")
        rows = self.members
        if self.roots is not None:
            rows, comp = rows.join(self.roots.select(F.col("node").alias("cls"), "root"), "cls", "left"), F.coalesce("root", "cls")
        rows = rows.select("key", "cls", comp.alias("comp"))
        rows = stage(rows)
        open_ = stage(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
        return stage(rows.join(open_, "key"))

    def compare(self, labelled: DataFrame, other: DataFrame, on: str, best: int | None = None) -> None:
        extra = [c for c in ("n", "parity") if c in labelled.columns]
        left = labelled.select(F.col("key"), F.col("cls").alias("a"), F.col("comp").alias("ca"), *(F.col(c).alias(f"{c}_a") for c in extra))
        right = other.select(F.col("key").alias("key_b"), F.col("cls").alias("b"), F.col("comp").alias("cb"), *(F.col(c).alias(f"{c}_b") for c in extra))
        self.add(left.join(right, F.expr(f"key = key_b AND {on}")).select("a", "b", "ca", "cb"), best)

    def add(self, pairs: DataFrame, best: int | None = None) -> None:
        """Confirms pairs (a, b, ca, cb: their components); with `best`, only the so many likeliest of each a."""
        pairs = pairs.distinct()
        for side in "ab":
            pairs = pairs.join(self.signatures.select(F.col("cls").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("sig").alias(f"s{side}"), F.col("parity").alias(f"p{side}")), side)
        pairs = pairs.where("100 * least(na, nb) >= 75 * greatest(na, nb)").where(may_link("na", "nb", "pa", "pb")).withColumn("e", estimate(F.col("sa"), F.col("sb"))).where(F.col("e") >= LEAST_ESTIMATE).select("a", "b", "ca", "cb", "e")
        if best:
            order = Window.partitionBy("a").orderBy(F.col("e").desc(), "b")
            pairs = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best)
        pairs = stage(pairs.select("a", "b", "ca", "cb"))
        for side in "ab":
            pairs = pairs.join(self.sets.select(F.col("cls").alias(side), F.col("grams").alias(f"g{side}")), side)
        both = F.size(F.array_intersect("ga", "gb"))
        met = pairs.where(100 * both >= 75 * (F.size("ga") + F.size("gb") - both)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        self.join(components(met))

    def join(self, new: DataFrame) -> None:
        if self.roots is not None:
            later = new.select(F.col("node").alias("root"), F.col("root").alias("new"))
            old = self.roots.join(later, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            new = old.unionByName(new.join(self.roots.select("node"), "node", "left_anti"))
        self.roots = stage(new)


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    Texts are linked at 75 of 100 of their distinct five-word shingles (A-Z lower-cased; a text of
    fewer words is one shingle). A null, empty or blank text has none and is linked with nothing.
    Rows that repeat a doc_id are one document, linked with whatever any of its texts is linked
    with. A null doc_id takes no part: its component is null and the row is kept. Extra columns
    are ignored.
    """
    sketched = stage(docs.select("doc_id", "text").mapInArrow(_sketch, SKETCH))
    real = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["n_shingles", "h1", "h2"]
    classes = stage(real.groupBy(*same).agg(F.min("doc_id").alias("cls")))
    signatures = stage(real.join(classes.withColumn("doc_id", F.col("cls")), ["doc_id", *same], "left_semi").withColumnRenamed("doc_id", "cls").dropDuplicates(["cls", "h1", "h2"]))
    rows = signatures.select("cls", F.explode("bands").alias("key"))
    shared = stage(rows.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key"))
    members = stage(rows.join(shared, "key").distinct())
    asked = members.select(F.col("cls").alias("doc_id")).distinct()
    sets = stage(docs.select("doc_id", "text").join(asked, "doc_id", "left_semi").mapInArrow(_full_sets, "cls bigint, grams array<bigint>").dropDuplicates(["cls", "grams"]))
    links = _Links(signatures.select("cls", "n_shingles", "sig", "parity"), sets, members)
    texts = stage(real.join(classes, same).select("doc_id", "cls").distinct())
    several = texts.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("doc_id", "a")
    links.join(components(texts.join(several, "doc_id").select("a", F.col("cls").alias("b"))))
    for hub in (F.min, F.max):
        labelled = links.labelled()
        hubs = stage(labelled.groupBy("key").agg(hub("cls").alias("cls")).join(labelled, ["key", "cls"]))
        links.compare(labelled, hubs, "ca <> cb", best=3)
    labelled = links.labelled().join(signatures.select("cls", F.col("n_shingles").alias("n"), "parity"), "cls")
    links.compare(labelled, labelled, f"a < b AND ca <> cb AND {may_link('n_a', 'n_b', 'parity_a', 'parity_b')}")
    named = stage(classes.join(links.roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select(*same, F.coalesce("root", "cls").alias("root")))
    out = sketched.select("doc_id", *same).join(named, same, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
