"""Reliable checkpoints, and numbers over a total order."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a folder of our own only in a local run that names none. On a cluster executors would not see that one, so there the setting is asked for."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="spark-checkpoint-")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def with_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Number the rows from 0 in a total order without sorting them in one task.

    Rows are dealt into ranges and sorted inside each; a row's number is its
    place in its range plus the rows of earlier ranges, a table with one row
    for each range. Rows that are equal in the order get adjacent numbers.
    The result is cut from its lineage, so the numbers never change. It is
    meant for narrow rows: carry keys, not texts.
    """
    place = F.monotonically_increasing_id()
    dealt = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    part = F.shiftright("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        dealt.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + inside)
        .drop("_part", "_place", "_start")
    )
