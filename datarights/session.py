"""Session helpers: one place for lineage cuts, staged tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

def local_session(app: str = "datarights", cpus: str | int = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only in local mode."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="datarights-ckpt-"))


#: Written tables of more rows are joined by sort and merge. Spark judges them by the size of their files, and
#: names that repeat in every repository are a hundred times larger in memory than in a file.
SMALL_ROWS = 10_000


def _sized(df: DataFrame, write) -> DataFrame:
    """What `write` makes of `df`, kept from being sent whole to every executor because its files are small."""
    rows = Observation()
    table = write(df.observe(rows, F.count(F.lit(1)).alias("rows")))
    return table.hint("merge") if rows.get["rows"] > SMALL_ROWS else table


def cut_unsized(df: DataFrame) -> DataFrame:
    """`cut`, whose joins are left to Spark's estimate."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` on shared storage and forget how it was made.

    Iterative operators call this so that plans stay small and a lost executor costs
    a re-read, never a re-run of every earlier round.
    """
    return _sized(df, cut_unsized)


def rule_table(spark: SparkSession, rows: list, schema: str, limit: int = 5_000) -> DataFrame:
    """A table of rule rows, to join by broadcast as long as it is no longer than `limit`."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= limit else table


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path beside the checkpoints, where driver and executors both reach it."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    return f"{base}/{kind}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning, _cleaning_lock = {}, threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of a table written inside go when its job ends, not when the driver happens to collect its garbage.

    Many small rounds else leave some files for each task of each round on the disks. What is written is read back from
    storage, so its shuffles are not needed again (checkpoints keep theirs). Threads may overlap; the last one out puts
    the setting back."""
    with _cleaning_lock:
        threads, was = _cleaning.get(spark, (0, None))
        if not threads:
            was = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _cleaning[spark] = (threads + 1, was)
    try:
        yield
    finally:
        with _cleaning_lock:
            threads, was = _cleaning.pop(spark)
            if threads > 1:
                _cleaning[spark] = (threads - 1, was)
            else:
                spark.conf.set(CLEANUP, was)


def stage_unsized(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """`stage`, whose joins are left to Spark's estimate."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_removed(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` as a Parquet table beside the checkpoints and read it back.

    Where a result is read several times for a few of its columns, this serves better than a
    checkpoint: readers prune columns and partitions and know the table's size.
    """
    return _sized(df, lambda rows: stage_unsized(rows, partition_by))


@contextmanager
def bucketed(df: DataFrame, parts: int, keys: list[str]):
    """`df` dealt to a table of `parts` buckets by `keys`: aggregations and joins by them read it without a shuffle.

    Cached behind a shuffle, it would leave the shuffle's files beside it; these go when the table is written."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    try:
        with shuffles_removed(spark):
            df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", scratch_path(spark, "buckets")).saveAsTable(name, format="parquet")
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def stage_all(frames: list[DataFrame], threads: int = 6) -> list[DataFrame]:
    """Stage independent tables side by side, so that small jobs fill the cluster together."""
    if not frames:
        return []
    ensure_checkpoint_dir(frames[0].sparkSession)
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(stage, frames))
