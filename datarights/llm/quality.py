"""Text quality by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Every passage is encoded, a gated attention learnt from
text labels says how much it matters, and the weighted sum of the passage codes is scored. The fit
sees a bounded number of labelled texts; scoring reads every passage of every text, in the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.llm.common import column_bytes, crc_mod, give_back_memory, range_hash, slices

WORDS = 64
SEGMENT = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Byte classes: every ASCII sign its own, letters, digits and white space by kind, the rest one."""
    out, signs = np.zeros(256, np.int64), 6
    for c in range(256):
        char = chr(c)
        if c >= 128:
            out[c] = 0
        elif char in " \t\r\v\f":
            out[c] = 1
        elif char == "\n":
            out[c] = 2
        elif char.islower():
            out[c] = 3
        elif char.isupper():
            out[c] = 4
        elif char.isdigit():
            out[c] = 5
        else:
            out[c] = signs if 33 <= c < 127 else 0
            signs += 33 <= c < 127
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
#: Fewer classes for pairs of neighbouring bytes: the first six and one for all signs.
COARSE = np.minimum(CLASS, 6)
N_FEATURES = N_CLASSES + 49 + 6


def segments(text: bytes | None) -> Iterator[bytes]:
    """A long text in parts cut at blanks, so that memory does not follow its length."""
    text, at = text or b"", 0
    while len(text) - at > SEGMENT:
        stop = max(text.rfind(b" ", at, at + SEGMENT), text.rfind(b"\n", at, at + SEGMENT)) + 1
        stop = stop if stop > at else at + SEGMENT
        yield text[at:stop]
        at = stop
    yield text[at:]


def encode(part: bytes, words: int = WORDS) -> np.ndarray:
    """One row of features per passage; a part without words is one passage of zeros."""
    data = np.frombuffer(part, np.uint8)
    kind = CLASS[data]
    word = (kind != 1) & (kind != 2)
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    n = -(-len(starts) // words)
    if not n:
        return np.zeros((1, N_FEATURES), np.float32)
    passage = np.zeros(len(data), np.int64)
    passage[starts[words::words]] = 1
    passage = np.cumsum(passage)
    size = np.bincount(passage, minlength=n)[:, None]
    single = np.bincount(passage * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, -1)
    pair = np.bincount(passage[1:] * 49 + COARSE[data[:-1]] * 7 + COARSE[data[1:]], minlength=n * 49).reshape(n, -1)
    of = np.arange(len(starts)) // words
    per = np.bincount(of, minlength=n)
    length = (ends - starts).astype(float)
    mean = np.bincount(of, length, n) / per
    spread = np.sqrt(np.maximum(0, np.bincount(of, length**2, n) / per - mean**2))
    name = range_hash(data.astype(np.uint64) + np.uint64(1), starts, ends, _BASE)
    again = np.zeros(len(name), bool)
    again[1:] = name[1:] == name[:-1]
    order = np.lexsort((name, of))
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[order][1:] != name[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order], fresh, n) / per
    shape = np.stack([np.log1p(per), mean / 10, spread / 10, distinct, np.bincount(of, again, n) / per, np.log1p(size[:, 0])], 1)
    return np.concatenate([np.sqrt(single / size), np.sqrt(pair / size), shape], 1).astype(np.float32)


class GatedAttention:
    """tanh codes, attention by tanh times a sigmoid gate, a logistic score of the attended code."""

    def __init__(self, n_features: int, width: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": draw(n_features, width), "b": np.zeros(width), "V": draw(width, width), "U": draw(width, width),
                  "w": draw(width) * 0.1, "c": draw(width), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(n_features), np.ones(n_features)

    def _codes(self, x):
        p = self.p
        h = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return h, t, g, (t * g) @ p["w"]

    @staticmethod
    def _attend(e, first, bag):
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        return a / np.add.reduceat(a, first)[bag]

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        first, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        h, _, _, e = self._codes(x)
        z = np.add.reduceat(self._attend(e, first, bag)[:, None] * h, first)
        return 1 / (1 + np.exp(-np.clip(z @ self.p["c"] + self.p["d"], -30, 30)))

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.02, decay: float = 1e-4) -> None:
        """Adam on the log loss; both labels weigh by their share, so a score is a probability."""
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        first, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        p = self.p
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        scaled = np.clip((x - self.mean) / self.scale, -6, 6)
        for step in range(1, rounds + 1):
            h, t, g, e = self._codes(x)
            a = self._attend(e, first, bag)
            z = np.add.reduceat(a[:, None] * h, first)
            out = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
            dz = ((out - y) / len(y))
            grad = {"c": z.T @ dz, "d": np.array([dz.sum()])}
            dz = (dz[:, None] * p["c"])[bag]
            da = (dz * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, first)[bag])
            grad["w"] = (t * g).T @ de
            dt, dg = de[:, None] * p["w"] * g * (1 - t**2), de[:, None] * p["w"] * t * g * (1 - g)
            grad["V"], grad["U"] = h.T @ dt, h.T @ dg
            dh = (dz * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
            grad["W"], grad["b"] = scaled.T @ dh, dh.sum(0)
            for k in p:
                grad[k] = grad[k] + decay * p[k] * (k not in "bd")
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def labelled_ids(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """doc_id and label, none of them held out."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), modulus) != held))
    return ids.groupBy("doc_id").agg(F.max(label).alias("label"))


def _first(ids: DataFrame, most: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sample_by_label(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, columns: list[str]) -> tuple[DataFrame, float]:
    """At most `most` labelled rows for a fit, none of them held out, in an order that ids alone decide; a rare label (1 or 0) has an eighth of `most` or all its rows.

    Also what to add to log odds that the sample gives, so that they hold for all labelled rows."""
    ids = labelled_ids(labels, label, modulus, held)
    n = {int(r["label"]): r["count"] for r in ids.groupBy("label").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    take = min(bad, max(round(most * bad / max(1, bad + good)), most // 8), most - min(good, most // 8))
    rest = min(good, most - take)
    first = _first(ids.where("label = 1"), take).unionAll(_first(ids.where("label = 0"), rest))
    shift = np.log(bad / good) - np.log(take / rest) if take and rest else 0.0
    return docs.select("doc_id", *columns).join(F.broadcast(first), "doc_id"), float(shift)  # `most` rows of two numbers


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 4_000) -> GatedAttention | None:
    """A model from every passage of at most `most` labelled texts; None without labels.

    A rare label has an eighth of `most` or all its rows; the model's scores are for the shares that all labelled rows have."""
    rows, shift = sample_by_label(docs, labels, "quality", 4, 2, most, ["text"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in column_bytes(batch):
                out.append(np.concatenate([encode(s) for s in segments(text)]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "label", "x"])

    got = rows.mapInArrow(features, "doc_id bigint, label int, x binary").toPandas().sort_values(["doc_id", "x"])
    if got["label"].nunique() < 2:
        return None
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in got["x"]]
    model = GatedAttention(N_FEATURES)
    model.fit(np.concatenate(bags), np.array([len(b) for b in bags]), got["label"].to_numpy(float))
    model.p["d"] = model.p["d"] + shift
    del bags, got
    give_back_memory()
    return model


def score_quality(docs: DataFrame, model: GatedAttention | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null text counts as empty.

    Without a model (no labels, or labels of one kind) every score is 0.5. Repeated rows get the
    same score, extra columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = column_bytes(batch)
            if model is None:
                out = np.full(len(texts), 0.5)
            else:
                bags = [np.concatenate([encode(s) for s in segments(t)]) for t in texts]
                out = model.score(np.concatenate(bags), np.array([len(b) for b in bags]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
