"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> the documents that stay, or packed pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datarights.llm.common import KEY, NO_ID, ascii_lower, labels
from datarights.llm.decontaminate import contamination
from datarights.llm.exact import exact_groups
from datarights.llm.minhash import near_groups
from datarights.llm.packing import pack
from datarights.llm.toxicity import clean_rows, fit_toxicity
from datarights.session import stage_unsized as stage

_ROW = ["__row_d", "__row_k"]


def _without(docs: DataFrame, d, k, dropped: DataFrame, once: bool = False) -> DataFrame:
    """Rows of `docs` whose key (d, k) is not in `dropped`; with `once`, one row for each key."""
    marked = docs.withColumns({_ROW[0]: d, _ROW[1]: k}).join(dropped.toDF(*_ROW), _ROW, "left_anti")
    return (marked.dropDuplicates(_ROW) if once else marked).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not call toxic."""
    return clean_rows(docs, fit_toxicity(docs, labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, of equal rows one."""
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)
    gone = stage(exact_groups(docs).where("NOT kept").select(F.coalesce("doc_id", F.lit(NO_ID)), "text_sha256").distinct())
    return _without(docs, F.coalesce("doc_id", F.lit(NO_ID)), sha, gone, once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id."""
    gone = stage(near_groups(docs).where("NOT kept").select("doc_id", F.lit(0).alias("k")).distinct())
    return _without(docs, F.col("doc_id"), F.lit(0), gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = stage(contamination(docs, items).where("contaminated").select(*KEY).distinct())
    return _without(docs, F.coalesce("doc_id", F.lit(NO_ID)), F.xxhash64("text"), gone)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed; the executors still hold what earlier stages took, so fewer words are kept."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), known_words=300_000)
