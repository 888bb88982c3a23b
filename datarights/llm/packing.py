"""Best-fit packing of token sequences by repeated length patterns.

Texts become token ids, pieces of at most `size` ids, and a histogram of piece lengths. The
histogram has at most `size` bins whatever the corpus, so the plan is made from it alone: patterns
of two and three lengths that fill a sequence are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what they leave is packed best-fit,
longest first. Pieces then find their place by their rank among the pieces of equal length.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datarights.llm.common import LOWER_BYTES, column_bytes, give_back_memory, kept, slices
from datarights.session import stage_unsized as stage

SIZE = 4096
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Stretches whose ids a Python worker keeps in each of two generations, some 0.2 KB each. More save time where memory is free.
KNOWN_WORDS = 800_000
_TOKENIZERS: dict[str, tuple] = {}
#: Where lower-casing A-Z first could change a token: a special token's name, or a letter with a combining mark.
_AS_IT_IS = re.compile(r"[A-Z][\u0300-\U0010ffff]")


def _encoder(path: str):
    """The tokenizer of a file and which ids end a word; one per Python worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(tokenizer.get_vocab_size(), bool)
        ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        _TOKENIZERS[path] = (tokenizer, ends)
    return _TOKENIZERS[path]


def _cut(code, at: np.ndarray, skip: int) -> Iterator[bytes]:
    """The ids between places, each place followed by `skip` ids that belong to nothing."""
    data, at = np.array(code.ids, "<u4").tobytes(), at.tolist()
    return (data[4 * a: 4 * b] for a, b in zip([0, *(c + skip for c in at)], at))


def _encode_words(tokenizer, word_end: np.ndarray, words: list[str], per_call: int = 1000) -> Iterator[tuple[str, bytes]]:
    """Ids of each stretch, many in one call: words of letters are told apart by the ids that end a word, others by a special token.

    A word that the tokenizer takes apart, as lower-casing a dotted capital I does, has several such ids and goes with the others."""
    letters = [w for w in words if w.isalpha() and (w.isascii() or unicodedata.normalize("NFC", w).lower().isalpha())] if word_end.any() else []
    known: set[str] = set()
    for i in range(0, len(letters), per_call):
        part = letters[i: i + per_call]
        code = tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
        at = np.flatnonzero(word_end[code.ids]) + 1
        if len(at) == len(part):  # a word has one at least, so each has one
            yield from zip(part, _cut(code, at, 0), strict=True)
            known.update(part)
    special = min(tokenizer.get_added_tokens_decoder().items(), default=None)
    plain = [w for w in words if w not in known and "<|" not in w] if special else []
    for i in range(0, len(plain), per_call):
        part = plain[i: i + per_call]
        code = tokenizer.encode_batch_fast([special[1].content.join(part)], add_special_tokens=False)[0]
        yield from zip(part, _cut(code, np.append(np.flatnonzero(np.array(code.ids) == special[0]), len(code.ids)), 1), strict=True)
    known.update(plain)
    rest = [w for w in words if w not in known]
    for word, code in zip(rest, tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
        yield word, np.array(code.ids, "<u4").tobytes()


def _stretches(text: bytes) -> list[str]:
    """Parts between blanks, lower-cased where that changes no id."""
    if (text.isascii() or not _AS_IT_IS.search(text.decode())) and b"<|" not in text:
        text = text.translate(LOWER_BYTES)
    return text.decode().replace("\n", " ").split(" ")


def _learn(tokenizer, word_end: np.ndarray, seen: dict[str, bytes], words: set[str]) -> None:
    """Adds the ids of new stretches. A last stop or comma after a letter or digit is a token of its own, so the rest is looked up without it."""
    signed = {w for w in words if w[-1:] in (".", ",") and w[-2:-1].isascii() and w[-2:-1].isalnum()}
    stems = {w[:-1] for w in signed} | (words - signed) | ({".", ","} if signed else set())
    seen.update(_encode_words(tokenizer, word_end, list(stems - seen.keys())))
    seen.update((w, seen[w[:-1]] + seen[w[-1]]) for w in signed)


class Seen:
    """Stretches already encoded in this worker, in two generations so that memory has a bound."""

    def __init__(self, most: int = KNOWN_WORDS):
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}


def token_bytes(texts: list[bytes | None], path: str, end_id: int, seen: Seen | None = None) -> Iterator[bytes]:
    """Ids of each text, then `end_id`, as little-endian unsigned 32-bit values.

    The tokenizer of the file lower-cases and never joins over white space, so stretches between
    blanks are encoded once and looked up afterwards.
    """
    (tokenizer, word_end), seen = _encoder(path), seen or Seen()
    split = [_stretches(t or b"") for t in texts]
    fresh = set().union(*split) - seen.new.keys()
    if len(seen.new) + len(fresh) > seen.most:
        seen.new, seen.old = {}, seen.new
        fresh = set().union(*split)
    known = fresh & seen.old.keys()
    seen.new.update((w, seen.old[w]) for w in known)
    _learn(tokenizer, word_end, seen.new, fresh - known)
    end = np.array([end_id], "<u4").tobytes()
    for words in split:
        yield b"".join(map(seen.new.__getitem__, words)) + end


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 1, known_words: int = KNOWN_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text's ids cut at `size`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = kept("tokens").setdefault(tokenizer_path, Seen(known_words))
        for batch in slices(batches, keep="tokens"):
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, data in zip(ids, token_bytes(column_bytes(batch), tokenizer_path, end_id, seen), strict=True):
                for piece, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at: at + 4 * size]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All rows of three indices into `lengths` (or -1) whose lengths fill `size` exactly."""
    at = np.full(size + 1, -1)
    at[lengths] = np.arange(len(lengths))
    other = size - lengths
    two = np.flatnonzero((other >= lengths) & (other > 0))
    two = two[at[other[two]] >= 0]
    found = [np.stack([two, at[other[two]], np.full(len(two), -1)], 1).astype(np.int32)]
    for i, a in enumerate(lengths[: np.searchsorted(lengths, size // 3, "right")]):
        b = np.arange(i, len(lengths))
        c = size - a - lengths[b]
        ok = c >= lengths[b]
        b, c = b[ok], c[ok]
        ok = at[c] >= 0
        found.append(np.stack([np.full(ok.sum(), i), b[ok], at[c[ok]]], 1).astype(np.int32))
    return np.concatenate(found)


def fit_patterns(rows: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 with the least |A x - counts|, A the patterns' length counts; multiplicative steps keep x non-negative."""
    n = len(counts)
    places = [np.where(column >= 0, column, n) for column in rows.T]  # an absent third length adds to a place of its own
    held = np.append(counts, 0.0)

    def of_patterns(values: np.ndarray) -> np.ndarray:
        return sum(values[p] for p in places)

    share = np.append(counts / np.maximum(1, sum(np.bincount(p, minlength=n + 1) for p in places)[:n]), np.inf)
    x = np.minimum.reduce([share[p] for p in places])
    target = of_patterns(held)
    for _ in range(rounds):
        made = sum(np.bincount(p, x, n + 1) for p in places)
        made[n] = 0
        x = x * target / np.maximum(1e-9, of_patterns(made))
    return x


def plan_packing(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) that use up the histogram exactly.

    All patterns of two and three lengths are fitted, `size` squared / 12 of them at most, whatever the
    number of documents; what rounding leaves goes to the best-fit step.
    """
    left = {n: c for n, c in histogram.items() if 0 < n < size and c}
    plan = [((size,), histogram[size])] if histogram.get(size) else []
    if left:
        lengths = np.array(sorted(left))
        counts = np.array([left[n] for n in lengths], float)
        rows = _patterns(lengths, size)
        if len(rows):
            x = fit_patterns(rows, counts)
            for k in np.argsort(-x, kind="stable"):
                if x[k] < 1:
                    break
                used = [int(lengths[i]) for i in rows[k] if i >= 0]
                times = min([int(x[k]), *(left[n] // used.count(n) for n in used)])
                if times:
                    plan.append((tuple(sorted(used, reverse=True)), times))
                    for n in used:
                        left[n] -= times
    return plan + _best_fit(left, size)


def _best_fit(left: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit over groups of equal sequences: longest lengths first, each into the fullest sequences with room."""
    room: dict[int, list[list]] = {}  # free places -> [(lengths), sequences]
    free: list[int] = []  # sorted keys of room

    def put(space: int, lengths: tuple[int, ...], times: int) -> None:
        if space not in room:
            room[space] = []
            insort(free, space)
        room[space].append([lengths, times])

    for n in sorted((n for n, c in left.items() if c), reverse=True):
        todo = left[n]
        while todo:
            k = bisect_left(free, n)
            if k == len(free):
                per = size // n  # the last sequence may hold fewer
                whole, rest = divmod(todo, per)
                if whole:
                    put(size - per * n, (n,) * per, whole)
                if rest:
                    put(size - rest * n, (n,) * rest, 1)
                break
            space = free[k]
            lengths, times = room[space].pop()
            if not room[space]:
                del room[space]
                free.pop(k)
            per = min(space // n, todo)
            into = min(times, todo // per)
            put(space - per * n, lengths + (n,) * per, into)
            if times > into:
                put(space, lengths, times - into)
            todo -= per * into
    return [(lengths, times) for groups in room.values() for lengths, times in groups]


def _places(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, last rank, per sequence, first sequence, offset), sorted by length and rank."""
    rows, used, base = [], {}, 0
    for lengths, times in plan:
        at = 0
        for n in dict.fromkeys(lengths):
            per = lengths.count(n)
            first = used.get(n, 0)
            rows.append((n, first, first + per * times, per, base, at))
            used[n] = first + per * times
            at += per * n
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def ranked(pieces: DataFrame, total: int, per_bucket: int = 4096) -> DataFrame:
    """Adds a rank from 0 among pieces of equal length; a length that many pieces have is counted in buckets."""
    buckets = max(64, -(-total // per_bucket))
    keys = ["length", "_bucket"]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    inside = Window.partitionBy(*keys).orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_n", F.row_number().over(inside) - 1)
    return numbered.join(offsets, keys).withColumn("rank", (F.col("_n") + F.col("_before")).cast("bigint")).drop("_n", "_before", "_bucket")


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 1, known_words: int = KNOWN_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    A null text is empty and becomes the end id alone. A repeated row is packed again. Null ids are
    carried. Extra columns are ignored, an empty table gives an empty one. Only texts of more than
    `size` ids are cut.
    """
    pieces = stage(token_pieces(docs, tokenizer_path, size, end_id, known_words))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    places = _places(plan_packing(histogram, size))
    key = places[:, 0] * (1 << 50) + places[:, 1]
    give_back_memory()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            n, first, _, per, base, offset = places[np.searchsorted(key, length * (1 << 50) + rank, "right") - 1].T
            slot = rank - first
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(base + slot // per), pa.array(offset + slot % per * n)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces, sum(histogram.values())).mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")
