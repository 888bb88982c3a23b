"""Removal of long repeats by recompression.

Texts are rewritten in rounds: runs of an equal symbol and then pairs of neighbouring symbols get
a name of their own. A name is a hash of what it replaces, so all tasks name alike, and what is
merged depends on the neighbours only: inside a stretch of words that stands in two places, the
symbols and their borders are the same in both, but for a margin at its ends. So every repeated
window has, in a known range, borders that both places share; the least of them by the hash of what
follows is its anchor. Anchors that stand once rule their windows out; the windows around the others
are counted exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.llm.blocks import beside, count_in_blocks, in_blocks, totals
from datarights.llm.common import KEY, column_bytes, hash_words, mix, range_hash, signed
from datarights.session import stage_unsized as stage

WINDOW = 35
#: Rounds and the most words that a symbol may have after each.
ROUNDS = (("runs", 4), ("pairs", 4))
_RUN, _PAIR, _NEXT, _PHRASE, _WHOLE = (np.uint64(x) for x in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25))
_NEVER = np.uint64(2**64 - 1)


def margins(window: int = WINDOW, rounds=ROUNDS) -> tuple[int, int, int]:
    """Words at a window's ends whose borders may differ, the range of words an anchor is sought in, and the words compared there.

    A border is decided by the symbols beside it, and for runs by what lies within the longest run
    and one symbol more; each round adds that much to the margin."""
    margin, longest = 0, 1
    for kind, most in rounds:
        margin += most + longest if kind == "runs" else longest
        longest = most
    seek = (window - 2 * margin) if window - 2 * margin > longest else 0
    seek = min(seek, 14)
    if seek < longest:
        raise ValueError("the window is too short for these rounds")
    return margin, seek, window - margin - seek + 1


def compress(words: np.ndarray, row: np.ndarray, rounds=ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Start and name of every symbol that is left after the rounds."""
    name, start, size = words.copy(), np.arange(len(words)), np.ones(len(words), np.int64)
    for turn, (kind, most) in enumerate(rounds):
        if len(name) < 2:
            break
        same_row = row[start[1:]] == row[start[:-1]]
        keep = np.ones(len(name), bool)
        if kind == "runs":
            first = np.append(True, ~((name[1:] == name[:-1]) & same_row))
            run = np.cumsum(first) - 1
            times = np.bincount(run)
            merged = (times > 1) & (times * size[first] <= most)
            at = np.flatnonzero(first)[merged]
            name[at] = mix(name[at] * _RUN + times[merged].astype(np.uint64))
            size[at] *= times[merged]
            keep = first | ~merged[run]
        else:
            left = (mix(name ^ np.uint64(turn + 1)) & np.uint64(1)) == 0
            at = np.flatnonzero(left[:-1] & ~left[1:] & same_row & (size[:-1] + size[1:] <= most))
            name[at] = mix(name[at] * _PAIR + mix(name[at + 1]))
            size[at] += size[at + 1]
            keep[at + 1] = False
        name, start, size = name[keep], start[keep], size[keep]
    return start, name


def windows_at(counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Starts of all windows, texts one after another."""
    many = np.maximum(0, counts - window + 1)
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(counts) - counts, many)


def anchors(words: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Place and phrase hash of the anchors of all windows."""
    margin, seek, phrase = margins(window)
    starts = windows_at(counts, window)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    border, _ = compress(words, row)
    order = np.full(len(words), _NEVER)
    border = border[border + 5 <= len(words)]
    order[border] = range_hash(words, border, border + 5, _NEXT) >> np.uint64(1)
    sought = np.lib.stride_tricks.sliding_window_view(order, seek)
    at = np.unique(starts + margin + sought[starts + margin].argmin(1))
    return at, range_hash(words, at, at + phrase, _PHRASE)


def _anchor_counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    words, counts = hash_words(column_bytes(batch), lower=False)
    key, n = np.unique(anchors(words, counts)[1].view(np.int64), return_counts=True)
    return {"anchor": key, "n": n}


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _suspects(texts: pa.Table, back: pa.Table) -> pa.Table:
    """Texts with windows around a shared anchor, as a mask over their windows; the others are done."""
    data = [t.as_buffer().to_pybytes() if t.is_valid else None for t in texts.column("text").cast(pa.binary())]
    words, counts = hash_words(data, lower=False)
    place, key = anchors(words, counts)
    place = place[np.isin(key.view(np.int64), back.column("anchor").to_numpy())]
    margin, seek, _ = margins()
    near = np.zeros(len(words) + 1, np.int64)  # a window starts from margin + seek - 1 to margin words before its anchor
    np.add.at(near, np.maximum(0, place - margin - seek + 1), 1)
    np.add.at(near, np.maximum(0, place - margin + 1), -1)
    near = np.cumsum(near)[:-1] > 0
    valid = np.zeros(len(words), bool)
    valid[windows_at(counts)] = True
    near &= valid
    masks, kept, text = [], [], []
    for t, a, n in zip(data, (np.cumsum(counts) - counts).tolist(), counts.tolist()):
        mask = near[a: a + n]
        if mask.any():
            masks.append(np.packbits(mask).tobytes()), kept.append(None), text.append(t)
        else:
            masks.append(None), kept.append(_sha((t or b"").split())), text.append(None)
    columns = [texts.column("block"), texts.column("doc_id"), pa.array(text, pa.binary()).cast(pa.string()), *(texts.column(c) for c in KEY), pa.array(masks, pa.binary()), pa.array(counts), pa.array(kept, pa.string())]
    return pa.Table.from_arrays(columns, names=["block", "doc_id", "text", *KEY, "mask", "n_words", "kept_sha256"])


def _window_names(data: list, masks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and names (64 and 32 bits) of the windows that the masks mark, and words per text."""
    words, other, counts = hash_words(data, lower=False, second=True)
    marked = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(masks, counts)]) if len(masks) else np.zeros(0)
    at = np.flatnonzero(marked)
    check = (range_hash(other, at, at + WINDOW, _WHOLE) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return at, range_hash(words, at, at + WINDOW, _WHOLE).view(np.int64), check, counts


def _finish(texts: pa.Table, back: pa.Table) -> pa.Table:
    data = [t.as_buffer().to_pybytes() for t in texts.column("text").cast(pa.binary())]
    at, name, check, counts = _window_names(data, texts.column("mask").to_pylist())
    shared = np.stack([back.column("name").to_numpy(), back.column("check").to_numpy().astype(np.int64)], 1)
    mine = np.stack([name, check.astype(np.int64)], 1)
    both = np.unique(np.concatenate([shared, mine]), axis=0, return_inverse=True)[1].ravel()
    hit = at[np.isin(both[len(shared):], both[: len(shared)])]
    cover = np.zeros(counts.sum() + WINDOW + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    gone = np.cumsum(cover) > 0
    removed, kept = [], []
    for t, a, n in zip(data, (np.cumsum(counts) - counts).tolist(), counts.tolist()):
        out = gone[a: a + n]
        removed.append(int(out.sum()))
        kept.append(_sha([w for w, o in zip(t.split(), out.tolist()) if not o]))
    return pa.Table.from_arrays([texts.column("doc_id"), texts.column("n_words"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of `docs`.

    A word goes when a window of 35 words over it stands in another place of any text as well, the
    same text and repeated rows included. Null and empty texts have no words, texts shorter than a
    window lose none. Extra columns are ignored.
    """
    counts = stage(count_in_blocks(docs, _anchor_counts, "anchor bigint, n bigint"))
    back = totals(counts, ["anchor"], ["n"]).where("t_n > 1").select("block", "kind", "anchor")
    back = back.unionByName(counts.where("kind = -1").select("block", "kind", "anchor"))
    row = "block bigint, doc_id bigint, text string, _d bigint, _k bigint, mask binary, n_words bigint, kept_sha256 string"
    seen = stage(beside(in_blocks(docs), back, _suspects, row))
    open_ = seen.where("mask IS NOT NULL")

    def count_windows(batches):
        for batch in batches:
            _, name, check, _ = _window_names(column_bytes(batch), batch.column("mask").to_pylist())
            of = np.repeat(batch.column("block").to_numpy(), [np.unpackbits(np.frombuffer(m, np.uint8)).sum() for m in batch.column("mask").to_pylist()])
            order = np.lexsort((check, name, of))
            of, name, check = of[order], name[order], check[order]
            new = np.append(True, (of[1:] != of[:-1]) | (name[1:] != name[:-1]) | (check[1:] != check[:-1]))[: len(of)]
            n = np.diff(np.append(np.flatnonzero(new), len(of)))
            yield pa.RecordBatch.from_arrays([pa.array(of[new]), pa.array(np.zeros(new.sum(), np.int32)), pa.array(name[new]), pa.array(check[new]), pa.array(n)], names=["block", "kind", "name", "check", "n"])

    counted = open_.select("block", "text", "mask").mapInArrow(count_windows, "block bigint, kind int, name bigint, check int, n bigint")
    back = totals(counted, ["name", "check"], ["n"]).where("t_n > 1").select("block", "kind", "name", "check")
    present = open_.select("block").distinct().select("block", F.lit(-1).alias("kind"), F.lit(0).cast("bigint").alias("name"), F.lit(0).alias("check"))
    done = beside(open_, back.unionByName(present), _finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return seen.where("mask IS NULL").select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256").unionByName(done)
