"""Impact of a diff on functions: touched lines, the functions around them, and the users of touched constants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import fnselect, ranges, refgraph
from verdigris.sources.diff import touched_lines
from verdigris.storage import work_dir, written


class Impact:
    """whole_crate: some touched line is in no function and no constant, static or type, so everything is impacted;
    otherwise ranges (file, whole, first, last) are the impacted lines, and lines (file, whole, line) the same one by one."""

    def __init__(self, whole_crate: bool, impacted: DataFrame):
        self.whole_crate, self.ranges = whole_crate, impacted

    @property
    def lines(self) -> DataFrame:
        return self.ranges.select("file", "whole", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("line"))


def analyze(items: DataFrame, aliases: DataFrame | None, hunks: DataFrame) -> Impact:
    """items and aliases of the base revision, hunks (file, old_start, old_count). A function is tried first, even where
    a smaller item of another kind encloses the line. Without hunks nothing is impacted."""
    home = work_dir(items.sparkSession, "impact")
    touched = written(touched_lines(hunks), f"{home}/touched")
    in_fn = written(refgraph.enclosing(touched, items, True).withColumnRenamed("item_id", "fn"), f"{home}/in_fn")
    both = refgraph.enclosing(in_fn.where("fn is null").select("file", "line"), items, False).withColumnRenamed("item_id", "other")
    kinds = items.select(F.col("item_id").alias("other"), "kind")
    outside = written(both.join(kinds, "other", "left"), f"{home}/outside")
    soft = F.col("kind").isin(refgraph.CONST, refgraph.STATIC, refgraph.TYPE)
    whole = bool(outside.where(F.col("kind").isNull() | ~soft).limit(1).count())
    spans = items.select("item_id", "file", "start", "end")
    empty = items.sparkSession.createDataFrame([], "file string, whole boolean, first long, last long")
    if whole:
        return Impact(True, empty)
    seeds = outside.where(soft).select(F.col("other").alias("item_id")).distinct()
    used = refgraph.users(items, refgraph.reference_edges(items, aliases), seeds).select("item_id")
    hit = in_fn.where("fn is not null").select(F.col("fn").alias("item_id")).union(used).distinct()
    impacted = spans.join(hit, "item_id", "left_semi").select("file", F.col("start").alias("first"), F.col("end").alias("last"))
    once = written(ranges.united(impacted, ["file"]), f"{home}/impacted")  # several steps read them
    return Impact(False, once.select("file", F.lit(False).alias("whole"), "first", "last"))


def run_set(impact: Impact, coverage: DataFrame, tests: DataFrame, history: DataFrame | None = None, base: str | None = None) -> DataFrame:
    """tests and must_run, with tests that history shows as flaky."""
    chosen = tests.withColumn("must_run", F.lit(True)) if impact.whole_crate else fnselect.select(impact.ranges, coverage, tests, base)
    return chosen if history is None else fnselect.with_flaky(chosen, history)
