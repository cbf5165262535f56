"""Folders that the driver and all executors share, and what else the operators need of the session."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.storage import base_dir, remove, work_dir, written

__all__ = ["base_dir", "numbered", "posix", "release", "remove", "work_dir", "written"]


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is no longer referred to; it does so when the driver's JVM collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def posix(path: str) -> str:
    """The mounted path of a shared folder, for files that workers map into memory."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a shared folder that is mounted on every machine, not {path}")
    return path


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the rows' numbers from 0 in that order, as the column `name`. A range sort: rows are numbered in their
    partition, and each partition starts after the rows before it, so that no task sees all rows."""
    s = df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__k": F.monotonically_increasing_id()})
    s = written(s, work_dir(df.sparkSession, "numbered"))
    n = s.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row a partition
    before = n.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__k")) - 1
    return s.join(before, "__part").withColumn(name, (F.col("__before") + own).cast("bigint")).drop("__part", "__k", "__before")
