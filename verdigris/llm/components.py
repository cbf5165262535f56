"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.shared import remove, work_dir, written


def _large(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to the smallest of its neighbours and itself."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, point to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    near = e.join(least, "u")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of each node that is no root itself; links: two columns of type long.
    Links of a node to itself, in both directions or repeated are fine; without links the result is empty."""
    spark, (a, b) = links.sparkSession, links.columns
    home, k, last = work_dir(spark, "components"), 0, None
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e, f"{home}/0")
    while True:
        total = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not total[0] or tuple(total) == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last, k = tuple(total), k + 1
        e = written(_small(_large(e)), f"{home}/{k}")
        remove(spark, f"{home}/{k - 1}")
