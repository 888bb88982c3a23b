"""How sources are dealt to tasks."""

from pyspark.sql import functions as F

from datarights.session import stage
from datarights.sources import facts as fa


def test_sources_are_dealt_by_their_text(spark, monkeypatch):
    """A thousand equal files compress to one small file; they are parsed by as many tasks as their text asks for."""
    monkeypatch.setattr(fa, "TASK_BYTES", 4096)
    files = stage(spark.range(1000).select(F.concat(F.lit("r"), "id").alias("repo_id"), F.lit("a.py").alias("path"), F.lit("x = 1  # " + "y" * 50 + "\n").alias("text")).coalesce(1))
    rows = fa.fact_rows(files)
    assert rows.rdd.getNumPartitions() > 10
    assert rows.where("fact = 'assign'").count() == 1000
    assert fa.fact_rows(files.where("false")).count() == 0
