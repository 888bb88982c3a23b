"""Order-dependent columns over runs of any length.

A window over a whole run would sort one run in one task, and one run may hold a third of
all rows. Here a run is cut into buckets along its order: windows work inside a bucket, and
what a bucket inherits from the ones before it comes from one summary row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datarights.session import cut


def _windows(keys: list[str], order: list[str]):
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    between = Window.partitionBy(*keys).orderBy("_bucket")
    return inside, between


def in_order(df: DataFrame, keys: list[str], order: list[str], bucket: Column, *,
             number: str | None = None, sums: dict[str, Column] | None = None,
             previous: dict[str, str] | None = None, upcoming: dict[str, Column] | None = None, latest: dict[str, Column] | None = None) -> DataFrame:
    """Adds running columns per `keys` in `order`; `bucket` must not decrease along the order.

    number: name for a 1-based position. sums: name -> value summed up to and including the row.
    previous: name -> column whose value on the row before is wanted (null on the first row).
    upcoming: name -> value whose smallest non-null among this and later rows is wanted.
    latest: name -> value whose last non-null among this and earlier rows is wanted.
    """
    sums, previous, upcoming, latest = sums or {}, previous or {}, upcoming or {}, latest or {}
    kept = df.columns
    df = df.withColumn("_bucket", bucket)
    for i, value in enumerate(sums.values()):
        df = df.withColumn(f"_v{i}", value)
    for i, value in enumerate(upcoming.values()):
        df = df.withColumn(f"_u{i}", value)
    for i, value in enumerate(latest.values()):
        df = df.withColumn(f"_t{i}", value)
    inside, between = _windows(keys, order)
    before = between.rowsBetween(Window.unboundedPreceding, -1)
    after = between.rowsBetween(1, Window.unboundedFollowing)
    place = F.struct(*order)
    stats = [F.count("*").alias("_n")]
    stats += [F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(sums))]
    stats += [F.max_by(F.struct(F.col(c).alias("x")), place).alias(f"_l{i}") for i, c in enumerate(previous.values())]
    stats += [F.min(f"_u{i}").alias(f"_m{i}") for i in range(len(upcoming))]
    stats += [F.max_by(f"_t{i}", F.when(F.col(f"_t{i}").isNotNull(), place)).alias(f"_k{i}") for i in range(len(latest))]
    carried = df.groupBy(*keys, "_bucket").agg(*stats)
    carried = carried.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *[F.sum(f"_s{i}").over(before).alias(f"_os{i}") for i in range(len(sums))],
        *[F.lag(f"_l{i}").over(between).alias(f"_ol{i}") for i in range(len(previous))],
        *[F.min(f"_m{i}").over(after).alias(f"_om{i}") for i in range(len(upcoming))],
        *[F.last(f"_k{i}", ignorenulls=True).over(before).alias(f"_ok{i}") for i in range(len(latest))])
    here = {"_rn": F.row_number().over(inside)}
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    for i in range(len(sums)):
        here[f"_c{i}"] = F.sum(f"_v{i}").over(upto)
    for i, column in enumerate(previous.values()):
        here[f"_p{i}"] = F.lag(F.struct(F.col(column).alias("x"))).over(inside)
    for i in range(len(upcoming)):
        here[f"_q{i}"] = F.min(f"_u{i}").over(on)
    for i in range(len(latest)):
        here[f"_h{i}"] = F.last(f"_t{i}", ignorenulls=True).over(upto)
    joined = df.withColumns(here).join(carried, [*keys, "_bucket"])
    out = {}
    if number:
        out[number] = (F.col("_rn") + F.col("_off")).cast("bigint")
    for i, name in enumerate(sums):
        out[name] = F.coalesce(F.col(f"_os{i}"), F.lit(0)) + F.coalesce(F.col(f"_c{i}"), F.lit(0))
    for i, name in enumerate(previous):
        out[name] = F.when(F.col("_rn") > 1, F.col(f"_p{i}.x")).otherwise(F.col(f"_ol{i}.x"))
    for i, name in enumerate(upcoming):
        out[name] = F.least(F.col(f"_q{i}"), F.col(f"_om{i}"))
    for i, name in enumerate(latest):
        out[name] = F.coalesce(f"_h{i}", f"_ok{i}")
    return joined.withColumns(out).select(*kept, *out)


def placed(df: DataFrame, keys: list[str], order: list[str], *, number: str | None = None, sums: dict[str, Column] | None = None,
           previous: dict[str, str] | None = None, upcoming: dict[str, Column] | None = None) -> DataFrame:
    """`in_order` for data with no natural bucket, or with buckets that one key may fill: a range
    sort over (keys, order) makes them.

    The sorted layout is written before its parts are used as buckets, so that a recomputed
    task cannot cut it elsewhere.
    """
    spread = df.repartitionByRange(*keys, *order) if keys or order else df
    laid = cut(spread.withColumn("_part", F.spark_partition_id()))
    wanted = {"number": number, "sums": sums, "previous": previous, "upcoming": upcoming}
    if keys:
        return in_order(laid, keys, order, F.col("_part"), **wanted).drop("_part")
    one = laid.withColumn("_all", F.lit(0))
    return in_order(one, ["_all"], order, F.col("_part"), **wanted).drop("_part", "_all")


def hour_bucket(ts: str) -> Column:
    return F.struct(F.to_date(ts).alias("d"), F.hour(ts).alias("h"))


def line_bucket(line: str, size: int = 4096) -> Column:
    return F.floor(F.col(line) / size).cast("bigint")
