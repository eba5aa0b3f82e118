"""Tables written between rounds of a loop, in the folder that the cluster's executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set and all runs in one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="ledgerline-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def writer(spark: SparkSession):
    """checkpoint(df, name): df written as Parquet and reread, which cuts its lineage and outlives executors."""
    root = f"{shared_folder(spark)}/ledgerline-{uuid.uuid4().hex}"

    def checkpoint(df: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return checkpoint


def numbered(rows: DataFrame, order: list[str], pos: str, checkpoint) -> DataFrame:
    """rows with `pos` counted from 0 without gaps by order: sorted ranges, and the number of rows before each range.

    checkpoint(df, name) keeps the ranges; one number for each partition comes to the driver.
    """
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranges = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": part, "_place": place}), "ranges")
    before, total = [], 0
    for r in sorted(ranges.groupBy("_part").agg(F.count("*").alias("n"), F.min("_place").alias("low")).collect()):
        before.append((r["_part"], total - r["low"]))
        total += r["n"]
    shifts = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _shift long"))  # a row for each partition
    return ranges.join(shifts, "_part").withColumn(pos, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")
