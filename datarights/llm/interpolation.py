"""Scores of a language model with deleted interpolation.

Bigram and unigram maximum-likelihood estimates and a uniform floor are mixed by weights that
depend on how often the context was seen. The weights come from expectation-maximisation on texts
set aside from the training texts, with the counts of the others.

Counting and looking up go by blocks of texts (blocks.py). A block adds up its own n-grams and sends
each range of hashed n-grams as one packed list; a range's task merges the lists of all blocks and
answers each block, in the order of its list, which n-grams other blocks have too and how often they
stand in all training texts. The rest a block knows by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.llm.blocks import apart, beside, in_blocks
from datarights.llm.common import column_bytes, hash_words, keyed, mix, slices
from datarights.session import stage_unsized as stage

BLOCK = 8 << 20
UNIGRAM, BIGRAM, STATS = 1, 2, 3
BUCKETS = 24
_END, _START, _TIMES = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D), np.uint64(0xA0761D6478BD642F)
_NONE = -9999


def folds(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Held out from training (crc32 of the id modulo 7 is 2), and set aside for the weights: a twentieth of the rest."""
    crc = np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], np.int64)
    held = crc % 7 == 2
    return held, ~held & (crc // 7 % 20 == 0)


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and the end of each text, the pairs with what stands before them, and tokens per text."""
    words, counts = hash_words(texts, lower=True)
    counts = counts + 1
    last = np.cumsum(counts) - 1
    one = np.full(counts.sum(), _END)
    inner = np.ones(len(one), bool)
    inner[last] = False
    one[inner] = words
    before = np.empty_like(one)
    before[1:] = one[:-1]
    before[last - counts + 1] = _START
    return one, mix(before * _TIMES + one), counts


class _Counts:
    """The n-grams of a block: sorted distinct keys, their counts, and for each token its key."""

    def __init__(self, grams: np.ndarray, train: np.ndarray, aside: np.ndarray):
        self.keys, self.of = np.unique(grams, return_inverse=True)
        self.train = np.bincount(self.of, train, len(self.keys)).astype(np.int64)
        self.aside = np.bincount(self.of, aside, len(self.keys)).astype(np.int64)

    def bounds(self, ranges: int) -> np.ndarray:
        edges = (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, edges), [len(self.keys)]]).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences of as many bytes as the largest takes."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    width, first = int(raw[0]), np.frombuffer(data[1:9], np.uint64)
    wide = np.zeros(((len(raw) - 9) // width, 8), np.uint8)
    wide[:, :width] = raw[9:].reshape(-1, width)
    return np.cumsum(np.concatenate([first, wide.view("<u8").ravel()]), dtype=np.uint64)


def _numbers(x: np.ndarray) -> bytes:
    """Counts as four bytes each, or as eight where one of them needs more; nothing for none."""
    if not len(x):
        return b""
    width = 4 if x.max(initial=0) < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _read_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64) if data else np.zeros(0, np.int64)


def _block_counts(ids: list, texts: list) -> tuple[_Counts, _Counts, np.ndarray, np.ndarray]:
    one, two, counts = tokens(texts)
    held, aside = folds(ids)
    train, aside = (np.repeat(x, counts).astype(float) for x in (~held, aside))
    return _Counts(one, train, aside), _Counts(two, train, aside), counts, held


def count_ngrams(docs: DataFrame, ranges: int) -> DataFrame:
    """One row for each block, kind and range of keys: the keys and their counts in training texts and in those set aside."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = apart()
        for batch in slices(batches, size=BLOCK):
            uni, bi, _, _ = _block_counts(batch.column("doc_id").to_pylist(), column_bytes(batch))
            rows = []
            for kind, c in ((UNIGRAM, uni), (BIGRAM, bi)):
                at = c.bounds(ranges)
                for r, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    if b > a:
                        rows.append((kind, r, pack_keys(c.keys[a:b]), _numbers(c.train[a:b]), _numbers(c.aside[a:b])))
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), named(batch))), *columns], names=["block", "kind", "range", "keys", "train", "aside"])

    return keyed(docs).mapInArrow(add_up, "block bigint, kind int, range int, keys binary, train binary, aside binary")


ANSWER = "block bigint, kind int, range int, mask binary, train binary, aside_train binary, aside binary, types bigint, total bigint, total_aside bigint"


def _merge(rows: pa.Table) -> pa.Table:
    """Answers for the blocks of one range: which keys other blocks have as well, and totals of those; totals of all keys set aside."""
    kind, rng = rows.column("kind")[0].as_py(), rows.column("range")[0].as_py()
    lists = [unpack_keys(k) for k in rows.column("keys").to_pylist()]
    train = np.concatenate([_read_numbers(x) for x in rows.column("train").to_pylist()])
    aside = np.concatenate([_read_numbers(x) for x in rows.column("aside").to_pylist()])
    _, of = np.unique(np.concatenate(lists), return_inverse=True)
    t_train, t_aside, blocks = np.bincount(of, train), np.bincount(of, aside), np.bincount(of)
    out, at = [], 0
    for block, keys in zip(rows.column("block").to_pylist(), lists):
        mine = of[at: at + len(keys)]
        shared = blocks[mine] > 1
        own = mine[aside[at: at + len(keys)] > 0]
        out.append((block, kind, rng, np.packbits(shared).tobytes(), _numbers(t_train[mine[shared]]), _numbers(t_train[own]), _numbers(t_aside[own]), None, None, None))
        at += len(keys)
    if kind == UNIGRAM:
        out.append((0, STATS, rng, None, None, None, None, int((t_train > 0).sum()), int(t_train.sum()), int(t_aside.sum())))
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 3]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in ANSWER.split(", ")])


def _probabilities(uni_c, ctx_c, bi_c, total, types):
    p1 = uni_c / max(1, total)
    p2 = np.where(ctx_c > 0, bi_c / np.maximum(1, ctx_c), 0.0)
    return p2, p1, np.full(len(p1), 1 / (types + 1))


def bucket_of(context_count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context_count + 1).astype(int), BUCKETS - 1)


def _context_counts(one: _Counts, counts: np.ndarray, of_unigram: np.ndarray) -> np.ndarray:
    """How often each token's context was seen: the word before it; a text's start as often as its end."""
    end = of_unigram[np.searchsorted(one.keys, _END)]
    before = np.empty(len(one.of))
    before[1:] = of_unigram[one.of[:-1]]
    before[np.cumsum(counts) - counts] = end
    return before


def _bin(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * 8), _NONE).astype(np.int64)


def fit_weights(bins: list[tuple[int, int, int, int]], floor: float, rounds: int = 40) -> np.ndarray:
    """Rows of three weights (bigram, unigram, floor) per bucket by EM on counts of (bucket, bigram bin, unigram bin, tokens).

    A bucket without data takes the weights of the one below it; without any context the bigram has no weight."""
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    data = np.array(bins, float).reshape(-1, 4)
    for b in range(BUCKETS):
        rows = data[data[:, 0] == b]
        w = weights[b - 1].copy() if b else np.array([0.0, 0.9, 0.1])
        if len(rows):
            p = np.stack([np.where(rows[:, k] > _NONE, 2.0 ** (rows[:, k] / 8), 0) for k in (1, 2)] + [np.full(len(rows), floor)], 1)
            w = np.array([0.4, 0.5, 0.1]) if b else w
            for _ in range(rounds):
                part = p * w
                part *= (rows[:, 3] / np.maximum(1e-300, part.sum(1)))[:, None]
                w = (part.sum(0) + 1e-3 * np.array([b > 0, 1, 1])) / (part.sum() + 1e-3 * (2 + (b > 0)))
        weights[b] = w
    return weights


def score_texts(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`.

    A null text has no words and scores its end. With no training text every count is 0 and the
    floor, one, scores 0. A repeated row counts again. Extra columns are ignored; an empty table
    gives an empty one. `ranges` is how many lists the n-grams are dealt to; unless given, one for
    every two megabytes of text, so that a list's size does not grow with the corpus.
    """
    ranges = ranges or max(64, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) >> 21)
    answers = stage(count_ngrams(docs, ranges).groupBy("kind", "range").applyInArrow(_merge, ANSWER))
    types, total, total_aside = (int(x or 0) for x in answers.where(F.col("kind") == STATS).agg(F.sum("types"), F.sum("total"), F.sum("total_aside")).first())
    answers = answers.where(F.col("kind") != STATS)

    def bins(texts: pa.Table, back: pa.Table) -> pa.Table:
        """Tokens set aside by context bucket and estimates from the other training texts."""
        one, two, counts, _ = _block_counts(texts.column("doc_id").to_pylist(), _texts(texts))
        left = []
        for kind, c in ((UNIGRAM, one), (BIGRAM, two)):
            rows = sorted((r, i) for i, (k, r) in enumerate(zip(back.column("kind").to_pylist(), back.column("range").to_pylist())) if k == kind)
            t, a = (np.concatenate([_read_numbers(back.column(x)[i].as_py()) for _, i in rows]) for x in ("aside_train", "aside"))
            if len(t) != len(c.keys):
                raise RuntimeError("the rows of a block changed between two reads; write the table first")
            left.append(t - a)
        context = _context_counts(one, counts, left[0])
        p2, p1, _ = _probabilities(left[0][one.of], context, left[1][two.of], total - total_aside, types)
        rows, n = np.unique(np.stack([bucket_of(context), _bin(p2), _bin(p1)], 1), axis=0, return_counts=True)
        return pa.Table.from_arrays([*(pa.array(rows[:, k]) for k in range(3)), pa.array(n)], names=["bucket", "p2", "p1", "n"])

    blocks = in_blocks(docs, BLOCK, apart)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    own = blocks.where((F.pmod(crc, F.lit(7)) != 2) & (F.pmod(F.floor(crc / 7), F.lit(20)) == 0))
    asked = answers.where(F.length("aside") > 0).select("block", "kind", "range", "aside_train", "aside")
    table = beside(own, asked, bins, "bucket bigint, p2 bigint, p1 bigint, n bigint").groupBy("bucket", "p2", "p1").agg(F.sum("n")).collect()  # bins, however many tokens
    weights = fit_weights([tuple(r) for r in table], 1 / (types + 1))

    def score(texts: pa.Table, back: pa.Table) -> pa.Table:
        one, two, counts, held = _block_counts(texts.column("doc_id").to_pylist(), _texts(texts))
        sums = []
        for kind, c in ((UNIGRAM, one), (BIGRAM, two)):
            known, at = c.train.copy(), c.bounds(ranges)
            answered = 0
            for k, r, mask, t in zip(*(back.column(x).to_pylist() for x in ("kind", "range", "mask", "train"))):
                if k == kind:
                    n = at[r + 1] - at[r]
                    answered += n
                    shared = np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool)
                    known[at[r]: at[r + 1]][shared] = _read_numbers(t)
            if answered != len(c.keys):
                raise RuntimeError("the rows of a block changed between two reads; write the table first")
            sums.append(known)
        c1 = sums[0][one.of]
        context = _context_counts(one, counts, sums[0])
        p2, p1, p0 = _probabilities(c1, context, sums[1][two.of], total, types)
        w = weights[bucket_of(context)]
        log_p = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
        base = np.log10((c1 + 1) / (total + types + 1))
        first = np.cumsum(counts) - counts
        out = [texts.column("doc_id"), pa.array(held), pa.array(counts), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), first)), pa.array(np.full(len(counts), total)),
               pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(log_p, first))]
        return pa.Table.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = answers.select("block", "kind", "range", "mask", "train")
    return beside(blocks, asked, score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _texts(table: pa.Table) -> list:
    return table.column("text").cast(pa.binary()).to_pylist()
