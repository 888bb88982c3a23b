"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of postings (term, document, sorted positions) of the training texts. An
exact phrase is found by shifting each term's positions by the term's place in the phrase and
intersecting the lists, from the rarest term on: the rarest gives the possible starts, the second
rarest thins them, and a start stays if all other terms confirm it. Proximity search walks the
same lists with a distance instead of a shift.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from datarights.llm.common import KEY, LOWER, UPPER, ascii_lower, column_bytes, keyed, slices
from datarights.session import stage_unsized as stage

WINDOW = 13
#: How many neighbouring words must be neighbours in some phrase for a position to be stored.
CHAIN = 3
#: Words are runs of digits, ASCII letters and anything beyond ASCII.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing
#: Up to so many terms the list of those asked for travels to the tasks (some 20 MB); beyond, a join picks them.
SENT_TERMS = 500_000


def words_of(text: Column) -> Column:
    """The lower-cased words of a text; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def text_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def postings(docs: DataFrame, phrases: DataFrame | None = None, chain: int = 1, sent: int = SENT_TERMS) -> DataFrame:
    """The positional index: term, _d, _k (the row's key), positions.

    phrases (column `words`) restricts the index to their terms. With chain > 1 it also leaves out
    positions that no phrase of that many words can use: those outside runs of `chain` words whose
    neighbours are neighbours in some phrase; only exact phrases may be looked up then. Up to
    `sent` terms and neighbours are looked up while texts are read; of more, a join picks the terms.
    """
    terms = lookup = pairs = None
    if phrases is not None:
        terms = phrases.select(F.explode("words").alias("term")).distinct()
        few = [r[0] for r in terms.limit(sent + 1).collect()]
        if len(few) <= sent:
            lookup = {t.encode(): i for i, t in enumerate(few)}
            next_to = F.transform(F.slice("words", 2, F.greatest(F.lit(0), F.size("words") - 1)), lambda w, i: F.struct(F.get("words", i).alias("a"), w.alias("b")))
            near = phrases.select(F.explode(next_to).alias("p")).select("p.*").distinct().limit(sent + 1).collect() if chain > 1 else []
            if 0 < len(near) <= sent:
                pairs = np.sort(np.array([lookup[a.encode()] * len(lookup) + lookup[b.encode()] for a, b in near], np.int64))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _index_batch(batch, lookup, pairs, chain)

    found = keyed(docs).select("text", *KEY).mapInArrow(index, "term string, _d bigint, _k bigint, positions array<int>")
    return found.join(terms, "term", "left_semi") if terms is not None and lookup is None else found


def _chained(ids: np.ndarray, row: np.ndarray, pairs: np.ndarray, n_terms: int, chain: int) -> np.ndarray:
    """Which words stand in a run of at least `chain` words joined by known pairs."""
    code = ids[:-1] * n_terms + ids[1:]
    found = pairs[np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)] == code
    joined = np.concatenate([[False], found & (ids[:-1] >= 0) & (ids[1:] >= 0) & (row[:-1] == row[1:])])[: len(ids)]
    run = np.cumsum(~joined)
    return np.bincount(run, minlength=1)[run] >= chain


def _index_batch(batch: pa.RecordBatch, lookup: dict[bytes, int] | None, pairs: np.ndarray | None, chain: int) -> pa.RecordBatch:
    lists = [text_words(t) for t in column_bytes(batch)]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = [w for words in lists for w in words]
    if lookup is None:
        lookup = {}
        ids = np.fromiter((lookup.setdefault(w, len(lookup)) for w in flat), np.int64, len(flat))
    else:
        ids = np.fromiter((lookup.get(w, -1) for w in flat), np.int64, len(flat))
    row = np.repeat(np.arange(len(lists)), sizes)
    position = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wanted = ids >= 0
    if pairs is not None:
        wanted &= _chained(ids, row, pairs, len(lookup), chain)
    keep = np.flatnonzero(wanted)
    keep = keep[np.argsort(row[keep] * (len(lookup) + 1) + ids[keep], kind="stable")]
    group = row[keep] * (len(lookup) + 1) + ids[keep]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    used, where = np.unique(ids[keep[first]], return_inverse=True)
    names = list(lookup)
    term = pa.DictionaryArray.from_arrays(pa.array(where.astype(np.int32)), pa.array([names[i].decode("utf-8", "replace") for i in used], pa.string())).cast(pa.string())
    of = pa.array(row[keep[first]])
    at = pa.ListArray.from_arrays(pa.array(np.append(first, len(keep)).astype(np.int32)), pa.array(position[keep].astype(np.int32)))
    return pa.RecordBatch.from_arrays([term, batch.column("_d").take(of), batch.column("_k").take(of), at], names=["term", *KEY, "positions"])


def phrases_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words) of the items, and (wid, item_id). A shorter item is one window, one without words none."""
    words = words_of(F.col("text"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    cut = items.select("item_id", words.alias("w")).where(F.size("w") > 0).select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("words"))
    both = stage(cut.withColumn("wid", F.sha2(F.concat_ws(" ", "words"), 256)).distinct())
    return both.select("wid", "words").distinct(), both.select("wid", "item_id")


def exact_phrases(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """wid, _d, _k, start, length of every place where a phrase (wid, words) stands."""
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    terms = phrases.select("wid", F.size("words").alias("n"), F.posexplode("words").alias("at", "term")).join(frequency, "term")
    by_rarity = Window.partitionBy("wid").orderBy("df", "term", "at")
    ranked = terms.withColumn("rank", F.row_number().over(by_rarity)).withColumn("have", F.count("*").over(Window.partitionBy("wid")))
    ranked = stage(ranked.where("have = n"))  # a phrase with a word that no text has is nowhere
    first = ranked.where("rank = 1").select("wid", "n", "term", "at")
    starts = index.join(first, "term").select("wid", "n", *KEY, F.explode("positions").alias("p"), "at")
    starts = starts.select("wid", "n", *KEY, (F.col("p") - F.col("at")).alias("start")).where("start >= 0")
    second = ranked.where("rank = 2").select("wid", "term", "at")
    thinned = starts.where("n > 1").join(second, "wid").join(index, ["term", *KEY])
    thinned = stage(thinned.where(F.array_contains("positions", F.col("start") + F.col("at"))).select("wid", "n", *KEY, "start"))
    rest = thinned.where("n > 2").join(ranked.where("rank > 2").select("wid", "term", "at"), "wid").join(index, ["term", *KEY])
    rest = rest.where(F.array_contains("positions", F.col("start") + F.col("at")))
    whole = rest.groupBy("wid", "n", *KEY, "start").agg(F.count_distinct("at").alias("met")).where("met = n - 2").drop("met")
    found = whole.unionByName(thinned.where("n = 2")).unionByName(starts.where("n = 1"))
    return found.select("wid", *KEY, "start", F.col("n").alias("length")).distinct()


def near_phrases(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """wid, _d, _k, anchor: places of a phrase's rarest word with all its other words, in any order,
    at most `slop` places further away than in the phrase."""
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    terms = phrases.select("wid", F.posexplode("words").alias("at", "term")).join(frequency, "term", "left")
    by_rarity = Window.partitionBy("wid").orderBy(F.coalesce("df", F.lit(0)), "term", "at")
    ranked = stage(terms.withColumn("rank", F.row_number().over(by_rarity)))
    first = ranked.where("rank = 1").select("wid", "term", F.col("at").alias("own"))
    anchors = index.join(first, "term").select("wid", "own", *KEY, F.explode("positions").alias("anchor"))
    others = ranked.where("rank > 1").select("wid", "term", "at")
    wanted = ranked.groupBy("wid").agg((F.count("*") - 1).alias("others"))
    reach = F.abs(F.col("at") - F.col("own")) + slop
    met = anchors.join(others, "wid").join(index, ["term", *KEY]).where(F.exists("positions", lambda p: (F.abs(p - F.col("anchor")) <= reach) & (p != F.col("anchor"))))
    met = met.groupBy("wid", *KEY, "anchor").agg(F.count_distinct("at").alias("met"))
    return anchors.select("wid", *KEY, "anchor").join(met, ["wid", *KEY, "anchor"], "left").join(wanted, "wid").where(F.coalesce("met", F.lit(0)) == F.col("others")).select("wid", *KEY, "anchor").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and item_ids, and the row key) for every row of `docs`.

    A word inside any occurrence of a window is hit; a text is contaminated when hit words are a
    twentieth or more of it. Null and empty texts have no words and are clean; so are all texts if
    there are no items. Null item ids hit but are not listed. Equal rows get equal results. Extra
    columns are ignored.
    """
    phrases, owners = phrases_of(items.select("item_id", "text"), window)
    shortest = phrases.agg(F.min(F.size("words"))).first()[0] or 1
    index = stage(postings(docs, phrases, chain=min(CHAIN, shortest)))
    hits = stage(exact_phrases(index, phrases))
    spans = F.array_sort(F.collect_set(F.struct("start", "length")))
    ends = F.aggregate("spans", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("hit")),
                       lambda a, s: F.struct(F.greatest(a["upto"], s["start"] + s["length"]).alias("upto"),
                                             (a["hit"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["upto"], s["start"]))).alias("hit")))
    covered = hits.groupBy(*KEY).agg(spans.alias("spans")).select(*KEY, ends["hit"].alias("hit"))
    listed = hits.select("wid", *KEY).distinct().join(owners, "wid").groupBy(*KEY).agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    found = stage(covered.join(listed, KEY, "left"))
    sizes = keyed(docs).select("doc_id", *KEY, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("n_words"))
    items_of = F.array_sort(F.coalesce("item_ids", F.array().cast("array<string>")))
    n_hit = F.coalesce("hit", F.lit(0)).cast("bigint")
    return sizes.join(found, KEY, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), items_of.alias("item_ids"), *KEY)
