"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from datarights.llm import stages
from datarights.session import stage_unsized as stage

STAGES = [("toxicity", stages.drop_toxic), ("exact dedup", stages.drop_copies), ("minhash near-dedup", stages.drop_near_copies),
          ("benchmark decontamination", stages.drop_contaminated), ("best-fit packing", stages.pack_sequences)]

#: Toxicity is a fitted model and packing a fitted plan, which SQL does not have; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
