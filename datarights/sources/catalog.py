"""Stores and fields from table schemas, and the tables written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F


def scan_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """store, kind, field, data_type, position for every column of every table (schemas only)."""
    rows = [(name, "relational", f.name, f.dataType.simpleString(), i)
            for name in sorted(tables) for i, f in enumerate(tables[name].schema.fields)]
    return spark.createDataFrame(rows, "store string, kind string, field string, data_type string, position int")


def write_inventory(df: DataFrame, path: str, fmt: str = "parquet", buckets: int = 64, draft: bool = False) -> None:
    """Write an inventory table, laid out by a hash bucket of the repository.

    A rejected record goes beside the accepted ones, under `state=draft`, never over them.
    """
    out = df.withColumn("state", F.lit("draft" if draft else "accepted")).withColumn("bucket", F.pmod(F.xxhash64("repo_id"), F.lit(buckets)))
    out.repartition("bucket").write.mode("append").partitionBy("state", "bucket").format(fmt).save(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines (`repo_id`, `ord`, `text`) as text, each repository's lines in order."""
    (lines.repartitionByRange("repo_id", "ord").sortWithinPartitions("repo_id", "ord")
     .select(F.concat_ws("\t", "repo_id", "text").alias("value")).write.mode("overwrite").text(path))
