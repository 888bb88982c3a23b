"""Toxicity by weak supervision.

Many weak voters, words and word parts that labelled texts single out beside patterns of
shouting, masking and address, vote or abstain on every text of a bounded sample. A generative label model learns by
expectation-maximisation how often each fires on toxic and clean texts and how far voters repeat
each other, and turns votes into posterior labels. A linear classifier is trained on those and
scores every whole text in the scan.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.llm.common import column_bytes, crc_mod, give_back_memory, slices
from datarights.llm.quality import sample_by_label, segments
from datarights.session import stage_unsized as stage

WORD = re.compile(r"[^\W\d_]+")
STARTS, ENDS = (4, 5, 6, 7, 8), (5,)
#: Pattern voters: shouted signs, masked words, direct address, runs of capitals.
PATTERNS = tuple(re.compile(p) for p in (r"[!?]{3}", r"\b[A-Za-z]+[*#@$%]+[A-Za-z]+\b", r"\b[Yy]ou(?:r|'re| are)\b", r"\b[A-Z]{4,}(?: [A-Z]{4,}){2}\b"))


def word_features(word: str) -> list[str]:
    """A word between blanks, its beginnings and its ends; a blank marks where the word begins or ends."""
    found = [f" {word} "]
    found += [f" {word[:n]}" for n in STARTS if len(word) > n]
    return found + [f"{word[-n:]} " for n in ENDS if len(word) > n]


def plain_words(text: bytes | None) -> list[str]:
    return [w for part in segments(text) for w in WORD.findall(part.decode("utf-8", "replace").lower())]


def pattern_votes(text: bytes | None) -> list[int]:
    parts = [p.decode("utf-8", "replace") for p in segments(text)]
    return [i for i, p in enumerate(PATTERNS) if any(p.search(x) for x in parts)]


class Lexicon:
    """The lexicon voters, found all at once in one walk over a text; the pattern voters come after them."""

    def __init__(self, features: list[str]):
        self.features = features
        self._machine = None

    @property
    def width(self) -> int:
        return len(self.features) + len(PATTERNS)

    def votes(self, text: bytes | None) -> list[int]:
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for i, f in enumerate(self.features):
                self._machine.add_word(f, i)
            self._machine.make_automaton()
        found = {i for _, i in self._machine.iter(f" {' '.join(plain_words(text))} ")} if self.features else set()
        return sorted(found) + [len(self.features) + i for i in pattern_votes(text)]

    def __getstate__(self):
        return {"features": self.features, "_machine": None}


def _unlike(rows: DataFrame) -> DataFrame:
    """One row for each least word hash, so that copies of one text do not make its words look telling."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            low = [min((zlib.crc32(w.encode()) * 0x9E3779B1 & 0xFFFFFFFF for w in set(plain_words(t))), default=-1) for t in column_bytes(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text")), batch.column("label").cast(pa.int32()), pa.array(low, pa.int64())], names=["doc_id", "text", "label", "low"])

    staged = stage(rows.select("doc_id", "text", "label").mapInArrow(least, "doc_id bigint, text string, label int, low bigint"))
    first = staged.groupBy("low", "label").agg(F.min("doc_id").alias("doc_id"))
    return staged.join(F.broadcast(first), ["doc_id", "low", "label"])  # no more rows than the sample


def mine_lexicon(rows: DataFrame, size: int, least: int = 8) -> Lexicon:
    """The `size` word features that tell toxic from clean labelled texts best, each in `least` toxic texts or more.

    With under four times `least` toxic texts a quarter of them, three at least, is enough, and the limit of surprise falls with it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=8 << 20):
            bad, good = Counter(), Counter()
            for text, label in zip(column_bytes(batch), batch.column("label").to_pylist(), strict=True):
                found: set[str] = set()
                for word in set(plain_words(text)):
                    found.update(word_features(word))
                (bad if label else good).update(found)
            names = list(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[n] for n in names], pa.int64()), pa.array([good[n] for n in names], pa.int64())], names=["f", "bad", "good"])

    totals = rows.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    if not n.get(1) or not n.get(0):
        return Lexicon([])
    enough = min(least, max(3, n[1] // 4))
    counts = rows.select("text", "label").mapInArrow(count, "f string, bad bigint, good bigint").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("good") + 0.5) / (n[0] + 1))
    surprise = F.col("bad") * ratio  # the part of the log-likelihood ratio that toxic texts make
    strong = counts.where((F.col("bad") >= enough) & (ratio > 2.5) & (surprise > 30 - 4 * (least - enough))).orderBy(surprise.desc(), F.length("f").desc(), "f").limit(size)
    kept: list[str] = []
    pure: list[str] = []  # what contains one of these adds nothing
    for r in strong.collect():
        if not any(p in r["f"] for p in pure):
            kept.append(r["f"])
            if r["good"] <= 0.01 * r["bad"]:
                pure.append(r["f"])
    return Lexicon(kept)


def _distinct(votes: np.ndarray, features: list[str]) -> list[int]:
    """One column for each set of lexicon voters that always vote alike: the longest, so that it claims least."""
    kept: dict[bytes, int] = {}
    for i, f in enumerate(features):
        key = np.packbits(votes[:, i] > 0).tobytes()
        if key not in kept or len(f) > len(features[kept[key]]):
            kept[key] = i
    return sorted(kept.values())


class LabelModel:
    """Posterior of a hidden label from voters that fire or abstain; the given label is one of them.

    rates[y, j]: how often voter j fires on label y. Not firing says nothing, but for one voter that
    fires where no other lexicon voter does. Voters that go together beyond what the label explains
    share their weight: each counts by one over the sum of its absolute correlations. `trust` is
    how often the given label is taken to be right.
    """

    def fit(self, votes: np.ndarray, given: np.ndarray, trust: float = 0.95, rounds: int = 20) -> np.ndarray:
        post = np.where(given > 0.5, trust, 1 - trust)
        say = np.log(trust / (1 - trust)) * np.sign(given - 0.5)
        for _ in range(rounds):
            prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
            weight = np.stack([1 - post, post])
            self.rates = (weight @ votes + 0.5) / (weight.sum(1)[:, None] + 1)
            left = votes - post[:, None] * self.rates[1] - (1 - post)[:, None] * self.rates[0]
            size = np.sqrt((left**2).sum(0)) + 1e-9
            shared = np.abs((left.T @ left) / size[:, None] / size)
            self.share = 1 / np.maximum(1, np.where(shared > 0.1, shared, 0).sum(0))
            odds = np.log(prior / (1 - prior)) + say + votes @ (np.log(self.rates[1] / self.rates[0]) * self.share)
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            if np.abs(new - post).max() < 1e-4:
                return new
            post = new
        return post


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray  # of the lexicon and pattern voters, and last of the silence of the lexicon
    bias: float

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        votes = [self.lexicon.votes(t) for t in texts]
        odds = np.array([self.weights[v].sum() for v in votes]) + self.bias
        odds[[not v or v[0] >= len(self.lexicon.features) for v in votes]] += self.weights[-1]
        none = [not v for v in votes]  # mostly toxic labels are no reason to reject a text on which all voters abstain
        odds[none] = np.minimum(odds[none], -1e-3)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _linear(votes: np.ndarray, target: np.ndarray, rounds: int = 1_500, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on soft labels."""
    w, b = np.zeros(votes.shape[1]), -1.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        out = 1 / (1 + np.exp(-np.clip(votes @ w + b, -30, 30)))
        d = (out - target) / len(target)
        grad = np.append(votes.T @ d + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 8_000, size: int = 2_000) -> ToxicityModel | None:
    """A model from at most `most` labelled texts and `size` lexicon voters; None if either label is missing.

    Of a rare label an eighth of `most` is drawn, or all its texts. Where no word tells, the pattern voters and the given label make the model.
    """
    sample, shift = sample_by_label(docs, labels, "toxic", 5, 0, most, ["text"])
    rows = _unlike(sample)
    lexicon = mine_lexicon(rows, size)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            votes = [np.array(lexicon.votes(t), np.int32).tobytes() for t in column_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array(votes, pa.binary())], names=["doc_id", "label", "v"])

    got = rows.mapInArrow(vote, "doc_id bigint, label int, v binary").toPandas().sort_values(["doc_id", "v"])
    if got["label"].nunique() < 2:
        return None
    votes = np.zeros((len(got), lexicon.width), np.float32)
    for i, v in enumerate(got["v"]):
        votes[i, np.frombuffer(v, np.int32)] = 1
    given = got["label"].to_numpy(float)
    kept = _distinct(votes, lexicon.features)
    lexicon = Lexicon([lexicon.features[i] for i in kept])
    votes = votes[:, kept + list(range(votes.shape[1] - len(PATTERNS), votes.shape[1]))]
    silent = (votes[:, : len(kept)].sum(1) == 0)[:, None].astype(np.float32)
    votes = np.concatenate([votes, silent], 1)
    weights, bias = _linear(votes, LabelModel().fit(votes, given))
    del votes, got
    give_back_memory()
    return ToxicityModel(lexicon, weights, bias + shift)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null text counts as empty.

    Without a model (no labels of one kind) every score is 0, so nothing is rejected. Repeated rows
    get the same score, extra columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = column_bytes(batch)
            out = model.score(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below the threshold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(model.score(column_bytes(batch)) < threshold))

    return docs.mapInArrow(keep, docs.schema) if model else docs
