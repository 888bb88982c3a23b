"""Token usage priced against a caller-given price list; money stays decimal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.functions.text import plain_model_name, undated_model_name


def resolve_model(df: DataFrame, name: str, prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds `model`: exact name, alias, undated name, alias of that; null where none is known."""
    known = prices.select(F.col("model").alias("_k"), F.col("model").alias("_to"), F.lit(0).alias("_o"))
    named = aliases.select(F.col("alias").alias("_k"), F.col("model").alias("_to"), F.lit(1).alias("_o"))
    # one small look-up table: a name that is both a model and an alias is the model
    look = known.unionByName(named).groupBy("_k").agg(F.min_by("_to", "_o").alias("_to"))
    plain = plain_model_name(name)
    first = look.select(F.col("_k").alias("_k1"), F.col("_to").alias("_m1"))
    second = look.select(F.col("_k").alias("_k2"), F.col("_to").alias("_m2"))
    return (df.join(first, plain == F.col("_k1"), "left")
            .join(second, undated_model_name(plain) == F.col("_k2"), "left")
            .withColumn("model", F.coalesce("_m1", "_m2")).drop("_k1", "_k2", "_m1", "_m2"))


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds `micro_usd` (tokens x USD per million). Unknown model: null, never zero.

    A cache read costs a tenth of input, a five-minute cache write 1.25 times, a one-hour
    cache write twice.
    """
    def dec(col):
        return F.coalesce(F.col(col), F.lit(0)).cast("decimal(18,0)")

    hourly = F.least(dec("cache_write_1h"), dec("cache_write"))
    rate = F.col("price_in")
    micro = (dec("input") * rate + dec("output") * F.col("price_out")
             + dec("cache_read") * rate * F.lit("0.1").cast("decimal(2,1)")
             + (dec("cache_write") - hourly) * rate * F.lit("1.25").cast("decimal(3,2)")
             + hourly * rate * F.lit("2").cast("decimal(1,0)"))
    return (usage.join(prices, "model", "left")
            .withColumn("micro_usd", micro.cast("decimal(30,6)")).drop("price_in", "price_out"))
