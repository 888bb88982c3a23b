"""Written tables and how they are joined."""

import time

from pyspark.sql import functions as F

from datarights.llm.components import components
from datarights.session import CLEANUP, cut, stage, stage_all
from datarights.sources import facts as fa


def joined(table, other, capsys):
    table.join(other, "name").explain()
    return capsys.readouterr().out


def test_small_files_of_many_rows_are_not_broadcast(spark, capsys):
    """Forty thousand rows of one long name are a file of some kilobytes."""
    many = spark.range(40_000).withColumn("name", F.lit("app.models." + "x" * 400))
    for table in (stage(many), stage(many.withColumn("part", F.lit(1)), ["part"]).drop("part"), cut(stage(many))):
        assert "Broadcast" not in joined(table.where("id < 40000").groupBy("name").count(), stage(many).select("name"), capsys)
        assert table.count() == 40_000
    few = stage(many.limit(10))
    assert "BroadcastHashJoin" in joined(few, stage(many.limit(5)).select("name"), capsys) and few.count() == 10
    assert stage(many.where("false")).count() == cut(many.where("false")).count() == 0


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}


def test_what_is_written_leaves_no_shuffle_files(spark):
    """Rounds of small jobs do not fill the disks until the driver collects its garbage; the caller's setting stays."""
    was, before = spark.conf.get(CLEANUP), shuffle_files(spark)
    many = spark.range(1000).withColumn("k", F.col("id") % 100).groupBy("k").count()
    tables = [stage(many), *stage_all([many, many.where("k < 50")]), components(many.select(F.col("k").alias("a"), (F.col("k") + 1).alias("b")))]
    until = time.time() + 20  # they are removed beside the next job
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEANUP) == was
    assert [t.count() for t in tables] == [100, 100, 50, 100]
