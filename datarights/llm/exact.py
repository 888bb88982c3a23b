"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Every text is cut where its content says so, chunks become verified identifiers, and texts are
compared as ordered lists of identifiers: the lists travel, the long texts do not. A chunk's
identifier is its 64-bit digest; a digest that two different chunks share is found by grouping
the distinct chunks themselves, and those chunks get an ordinal beside the digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from datarights.llm.common import ascii_lower
from datarights.session import stage_unsized as stage

#: A chunk ends after white space before a letter of the first half of the alphabet, from 1024
#: characters on, and at 4096 at the latest.
CUT = r"(?s).{1024,4095}?[ \n](?=[a-m])|.{1,4096}"


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    Texts are equal when identical after lower-casing A-Z. Null counts as the empty text, which is
    a text like any other. The largest doc_id of a group stays; null ids come last, and in a group
    of null ids only, all stay. A row given twice counts twice and both are kept. Extra columns
    are ignored; an empty table gives an empty one.
    """
    base = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("t"))
    recipes = stage(base.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"),
                                F.transform(chunks_of(F.col("t")), lambda c: digest(c)).alias("recipe")))
    chunks = base.select(F.explode(chunks_of(F.col("t"))).alias("c")).select(digest(F.col("c")).alias("h"), "c").distinct()
    shared = stage(chunks.groupBy("h").count().where("count > 1").select("h"))
    if shared.isEmpty():
        recipes = recipes.withColumn("ordinals", F.array().cast("array<int>"))
    else:
        recipes = _with_ordinals(base, recipes, chunks, shared, digest)
    groups = stage(recipes.groupBy("recipe", "ordinals").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
                   .where("group_size > 1"))
    joined = recipes.join(groups, ["recipe", "ordinals"], "left")
    alone = F.col("group_size").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                         F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
                         (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def _with_ordinals(base: DataFrame, recipes: DataFrame, chunks: DataFrame, shared: DataFrame, digest) -> DataFrame:
    """Adds, for chunks whose digest is shared, which of the chunks it is; 0 elsewhere."""
    order = Window.partitionBy("h").orderBy("c")
    named = stage(chunks.join(shared, "h").select("h", "c", (F.row_number().over(order) - 1).alias("n")).where("n > 0"))
    sha = F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")
    placed = base.select("doc_id", sha, F.posexplode(chunks_of(F.col("t"))).alias("pos", "c")).withColumn("h", digest(F.col("c"))).distinct()
    found = placed.join(named, ["h", "c"]).groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("found"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "found")
    flat = F.coalesce(F.flatten(F.transform("found", lambda x: F.array(x["pos"], x["n"]))), F.array().cast("array<int>"))
    on = recipes["doc_id"].eqNullSafe(found["_id"]) & (recipes["text_sha256"] == found["_sha"])
    return stage(recipes.join(found, on, "left").select("doc_id", "text_sha256", "recipe", flat.alias("ordinals")))
