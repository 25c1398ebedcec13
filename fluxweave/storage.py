"""Lineage cuts and dense indexes that hold on a cluster: everything goes through the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, where that is unset, a folder of our own. A cluster must name one that all share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='fluxweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """Where this application's tables go; llm's go there too."""
    return f"{shared_dir(spark)}/fluxweave/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> bool:
    """Deletes what this application has written there. DataFrames made before can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Writes a table and reads it again, so that it is computed once and survives lost executors."""
    path = f"{scratch_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_index(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """Adds a dense index by a total order without bringing all rows into one task.

    Rows are range-partitioned and numbered within their partition; the partitions' sizes, a row each, give the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "index")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    index = (F.col("__before") + within - 1 + start).cast("long")
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, index).drop("__part", "__before")  # a row for each partition
