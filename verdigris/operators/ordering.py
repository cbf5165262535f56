"""Fail-fast order of tests and the first failing member of a monotone sequence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.history import recently_failed
from verdigris.storage import work_dir, written

#: Ranges of keys in a round of search_failing().
WAYS = 64


def _order():
    """Recently failed first, latest failure first (never failed last), fastest first (unknown counts as 0), then by id."""
    return [F.col("recently_failed").desc(), F.col("last_fail").desc_nulls_last(), F.col("duration").asc(), F.col("id").asc()]


def ranked(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """The candidates' sort keys; candidates without history and repeated candidates are kept."""
    both = candidates.select("id").join(history.select("id", "recent", "last_fail", "last_duration_ms"), "id", "left")
    return both.select("id", F.coalesce(recently_failed(F.col("recent")), F.lit(False)).alias("recently_failed"), "last_fail", F.coalesce("last_duration_ms", F.lit(0)).alias("duration"))


def fail_fast(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """ranked(), sorted: a distributed range sort."""
    return ranked(candidates, history).orderBy(*_order())


def fail_fast_rank(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """id, rank from 1. Ranks come from a range sort: rows are numbered in their partition, and each partition starts
    after the rows before it, so no task sees all rows."""
    s = fail_fast(candidates, history).withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id())
    s = written(s, work_dir(s.sparkSession, "ranked"))
    n = s.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("k"))
    return s.join(before, "part").select("id", rank.alias("rank"))


def first_failing(rows: DataFrame, order: str, failing: str) -> DataFrame:
    """One row, first: the smallest order at which the condition holds; null if it never does."""
    return rows.agg(F.min(F.when(F.expr(failing), F.col(order))).alias("first"))


def bisect(n: int, failing: Callable[[int], bool]) -> int | None:
    """The smallest i below n at which the monotone predicate holds, with at most about log2(n) + 1 calls; each call may
    be a Spark job. None if it never holds."""
    if n <= 0 or not failing(n - 1):
        return None
    passes, fails = -1, n - 1
    while fails - passes > 1:
        mid = (passes + fails) // 2
        if failing(mid):
            fails = mid
        else:
            passes = mid
    return fails


def search_failing(rows: DataFrame, order: str, failing: str, ways: int = WAYS) -> DataFrame:
    """As first_failing(), for a condition that is dear and monotone: in a round the keys still in question are cut into
    `ways` ranges of equal width, the condition is evaluated for the last row of each only, and what is left lies above the
    last range where it does not hold before the first where it does. Rounds are the logarithm of the keys' width, a
    whole number, to base `ways`; of a round the driver sees `ways` rows at most. Where the condition is not monotone the
    result is a key at which it holds while it does not at the end of the range before it, or null."""
    key = F.col(order).cast("bigint")
    known = rows.where(F.col(order).isNotNull())
    ends = known.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    none = rows.sparkSession.createDataFrame([(None,)], "first long")
    if ends["low"] is None:
        return none
    low, high, sure = ends["low"] - 1, ends["high"], False  # keys above low, up to high
    while not sure or high - low > 1:
        width = -(-(high - low) // ways)
        inside = known.where((key > low) & (key <= high)).select(F.expr(f"(cast({order} as bigint) - {low} - 1) div {width}").alias("range"), F.struct(*known.columns).alias("row"), key.alias("key"))
        last = inside.groupBy("range").agg(F.max_by("row", "key").alias("row")).select(F.col("range").alias("__range"), "row.*")
        tops = last.select("__range", key.alias("__at"), F.expr(failing).alias("__fails")).orderBy("__range").collect()
        first = next((r for r in tops if r["__fails"]), None)
        if first is None:
            return none if not sure else rows.sparkSession.createDataFrame([(high,)], "first long")
        low, high, sure = low + first["__range"] * width, first["__at"], True
    return rows.sparkSession.createDataFrame([(high,)], "first long")
