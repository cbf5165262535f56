"""Selecting tests by the lines they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import ranges
from verdigris.operators.history import historically_flaky
from verdigris.storage import work_dir, written


def covered_by(coverage: DataFrame, impacts: DataFrame) -> DataFrame:
    """test_id of each test with an impacted line, once. Both have lines (file, line), and meet by equality, or one or both
    have ranges of lines (file, first, last)."""
    if "line" in coverage.columns and "line" in impacts.columns:
        return coverage.join(impacts.where("line is not null").select("file", "line").distinct(), ["file", "line"], "left_semi").select("test_id").distinct()
    if "line" in coverage.columns:
        # different lines are held against the ranges, once each however many tests cover them
        home = work_dir(coverage.sparkSession, "covered")
        lines, hit = written(coverage.select("file", "line").distinct(), f"{home}/lines"), written(ranges.united(impacts.where("first is not null"), ["file"]), f"{home}/ranges")
        return coverage.join(ranges.stabbed(lines, hit, ["file"]).select("file", "line"), ["file", "line"], "left_semi").select("test_id").distinct()
    return ranges.overlapping(coverage, ranges.as_ranges(impacts), ["file"], ["test_id"])


def valid(coverage: DataFrame, base: str | None) -> DataFrame:
    """Coverage taken at the base revision; rows of another base say nothing about today's lines."""
    return coverage if base is None else coverage.where(F.col("base").eqNullSafe(F.lit(base)))


def select(impacts: DataFrame, coverage: DataFrame, tests: DataFrame, base: str | None = None) -> DataFrame:
    """tests and must_run: any impact on a whole file runs all; a test without coverage runs; otherwise a test runs if it
    covers an impacted line. Repeated tests are kept."""
    coverage = valid(coverage, base)
    if impacts.where("whole").limit(1).count():
        return tests.withColumn("must_run", F.lit(True))
    known = coverage.select("test_id", F.lit(False).alias("hit"))
    marks = known.union(covered_by(coverage, impacts).withColumn("hit", F.lit(True))).groupBy("test_id").agg(F.max("hit").alias("hit"))
    return tests.join(marks, "test_id", "left").withColumn("must_run", F.coalesce("hit", F.lit(True))).drop("hit")


def with_flaky(selection: DataFrame, history: DataFrame) -> DataFrame:
    """selection in which tests that have both passed and failed always run."""
    risky = historically_flaky(history).select(F.col("id").alias("test_id")).distinct().withColumn("risky", F.lit(True))
    return selection.join(risky, "test_id", "left").withColumn("must_run", F.col("must_run") | F.coalesce("risky", F.lit(False))).drop("risky")

