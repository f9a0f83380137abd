"""Table access and the shared folder for written intermediates."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that may be collected for a table that a parameter or a fixed schema bounds.
SMALL_ROWS = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows whose files make fewer tasks than there are cores, dealt out to all cores; others as
    they are.  A large table always makes more tasks, so nothing of one is moved."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder named in ``spark.checkpoint.dir``.  Only a local master may go without:
    it gets a temporary folder.  A cluster without a named folder is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(?:\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loam-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared checkpoint folder and read them from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def collect_bounded(df: DataFrame, bound: int = SMALL_ROWS) -> list:
    """The rows of a result that a parameter bounds; raises beyond the bound and never truncates."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} rows, where fewer were promised")
    return rows


#: A key is hot if more than one in so many rows has it, so there are at most so many hot keys.
HOT_SHARE = 10_000


def skew_join(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """The inner join on ``key``, of which no single key can stall a task.

    ``right`` has one row for each key, and in ``count`` how many rows of ``left`` have it.
    Keys that more than one in ``HOT_SHARE`` of these rows has number at most ``HOT_SHARE``:
    they are broadcast, and their rows stay where they are.  All others meet by a shuffle.
    Both sides are read twice, so they should be written tables.  Null keys match nothing."""
    least = right.agg(F.sum(count) / HOT_SHARE).scalar()
    hot, cold = right.where(F.col(count) > least), right.where(F.col(count) <= least)
    return left.join(F.broadcast(hot), key).unionByName(left.join(cold, key))
